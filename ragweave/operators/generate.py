"""Context blocks and grounded answers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.functions import text as T
from ragweave.operators.embed import lots, model_udf
from ragweave.providers import ChatModel

PROMPT = "Answer the question from the passages alone and name the sources you used at the end. If they do not hold the answer, say: I could not find an answer in the passages."


def ordered_hits(hits: DataFrame, rank: str = "final_rank", *more: str) -> DataFrame:
    """(query_id, hits): each query's hits in order."""
    fields = [F.col(rank).alias("rank"), "text", "source", *more]
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("hits"))


def answer_context(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda h: F.concat(F.lit("Source: "), T.source_title(h["source"]), F.lit("\nContent: "), h["text"])), "\n\n")


def judge_context(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda h, i: F.concat(F.lit("Chunk ID: "), (i + 1).cast("string"), F.lit("\nSource: "), h["source"], F.lit("\nContent: "), h["text"])), "\n\n")


def recall_context(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda h, i: F.concat(F.lit("Passage "), (i + 1).cast("string"), F.lit(": "), h["text"])), "\n\n")


def ask(make: Callable[[], ChatModel], system: str, user: Column, strict: bool = False) -> Column:
    """The model's reply to each text; null for null, and for calls that fail, which end the query if strict.

    Texts go to the model in batches where it has chat_batch.
    """

    def one(model, u):
        try:
            return model.chat(system, u)
        except Exception:
            if strict:
                raise
            return None

    def run(parts):
        model = make()
        for (part,) in (lot for whole in parts for lot in lots(whole)):
            given, batch = [u for u in part if u is not None], getattr(model, "chat_batch", None)
            replies = None
            if batch is not None:
                try:
                    replies = list(batch(system, given))
                except Exception:
                    if strict:
                        raise
            if replies is None:
                replies = [one(model, u) for u in given]
            found = iter(replies)
            yield pd.Series([None if u is None else next(found) for u in part], dtype=object)

    return model_udf(run, "string")(user)


def answer(queries: DataFrame, hits: DataFrame, make: Callable[[], ChatModel], skip_without_hits: bool = False, strict: bool = False) -> DataFrame:
    """Add model_answer to (query_id, query, ...); queries without hits are asked with an empty context unless skipped."""
    joined = queries.join(ordered_hits(hits), "query_id", "left")
    context = F.coalesce(answer_context(F.col("hits")), F.lit(""))
    prompt = F.concat(F.lit("Question: "), F.col("query"), F.lit("\n\nPassages:\n"), context)
    if skip_without_hits:
        prompt = F.when(F.col("hits").isNotNull(), prompt)
    return joined.withColumn("model_answer", ask(make, PROMPT, prompt, strict)).drop("hits")
