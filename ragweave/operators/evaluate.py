"""Judges' verdicts, ROUGE-L, and the averages of an experiment."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.functions.text import porter_stem
from ragweave.operators import generate
from ragweave.plans.config import REFUSAL
from ragweave.providers import ChatModel, words

RELEVANCE_PROMPT = "Does the passage help to answer the question? Reply with RELEVANT or NOT RELEVANT alone."
RECALL_PROMPT = "Do the passages together support the answer? Reply with YES or NO alone, or with UNANSWERABLE if the question lies outside what they treat."
FAITHFUL_PROMPT = "Compare the answer with the passages, claim by claim. End with the line Final Verdict: Faithful or Final Verdict: Unfaithful."


def relevance_verdict(reply: Column, compat: bool = False) -> Column:
    """RELEVANT or NOT RELEVANT; null without a reply. compat takes any reply that holds the word RELEVANT for the first."""
    said = F.upper(F.trim(reply))
    no = F.lit(False) if compat else F.contains(said, F.lit("NOT RELEVANT"))
    return F.when(~no & F.contains(said, F.lit("RELEVANT")), "RELEVANT").when(reply.isNotNull(), "NOT RELEVANT")


def recall_verdict(reply: Column) -> Column:
    """UNANSWERABLE, YES or NO; null without a reply."""
    said = F.upper(F.trim(reply))
    return F.when(F.contains(said, F.lit("UNANSWERABLE")), "UNANSWERABLE").when(F.contains(said, F.lit("YES")), "YES").when(reply.isNotNull(), "NO")


def faithfulness_verdict(report: Column) -> Column:
    """1 faithful, 0 unfaithful, -1 undecided, null without a report; an explicit final verdict comes before a bare word."""
    said = F.lower(report)
    has = lambda s: F.contains(said, F.lit(s))
    return F.when(has("final verdict: faithful"), 1).when(has("final verdict: unfaithful"), 0).when(has("unfaithful"), 0).when(has("faithful"), 1).when(report.isNotNull(), -1)


def is_answerable(query_type: Column) -> Column:
    return ~F.contains(F.lower(F.coalesce(query_type, F.lit(""))), F.lit("unanswerable"))


def refused(answer: Column) -> Column:
    return F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lit(REFUSAL))


def _tokens(text: str | None, stem: bool) -> list[str]:
    return [porter_stem(w) if stem and len(w) > 3 else w for w in words(text or "")]


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence: bit-parallel over the shorter list."""
    if len(a) > len(b):
        a, b = b, a
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for x in b:
        match = state & places.get(x, 0)
        state = ((state + match) | (state - match)) & full
    return len(a) - state.bit_count()


def rouge_l(reference: Column, candidate: Column, stem: bool = True) -> Column:
    """F-measure of the longest common subsequence of lower-case words; 0 if either has none."""

    @F.pandas_udf("double")
    def run(ref: pd.Series, cand: pd.Series) -> pd.Series:
        out = []
        for r, c in zip(ref, cand):
            x, y = _tokens(r, stem), _tokens(c, stem)
            both = lcs_length(x, y)
            p, q = both / len(y) if y else 0.0, both / len(x) if x else 0.0
            out.append(2 * p * q / (p + q) if both else 0.0)
        return pd.Series(np.asarray(out, dtype=float))

    return run(reference, candidate)


def judge_relevance(hits: DataFrame, make: Callable[[], ChatModel], compat: bool = False, strict: bool = False) -> DataFrame:
    """Add relevance to hits that carry their query; null where the judge failed."""
    prompt = F.concat(F.lit("Question: "), F.col("query"), F.lit("\n\nPassage:\nSource: "), F.coalesce("source", F.lit("")), F.lit("\nContent: "), F.col("text"))
    asked = hits.withColumn("_reply", generate.ask(make, RELEVANCE_PROMPT, prompt, strict))
    return asked.withColumn("relevance", relevance_verdict(F.col("_reply"), compat)).drop("_reply")


def precision_at_k(queries: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, ret_precision): share of judged hits that are relevant; 0 without hits, null if no judgement came."""
    share = judged.groupBy("query_id").agg(F.avg((F.col("relevance") == "RELEVANT").cast("int")).alias("p"), F.lit(True).alias("hit"))
    found = queries.select("query_id").join(share, "query_id", "left")
    return found.select("query_id", F.when(F.col("hit").isNull(), 0.0).otherwise(F.col("p")).alias("ret_precision"))


def audit(answered: DataFrame, judged: DataFrame, make: Callable[[], ChatModel], make_faithful: Callable[[], ChatModel] | None = None, strict: bool = False) -> DataFrame:
    """Evaluated queries: precision, recall verdict, ROUGE-L, faithfulness and its report, for (query_id, query_type, query, answer, model_answer).

    `make` judges retrieval, `make_faithful` answers. Judgements that failed are null, and judge_failures counts them.
    """
    rows = answered.join(precision_at_k(answered, judged), "query_id").join(generate.ordered_hits(judged, "final_rank", "relevance"), "query_id", "left")
    question = F.concat(F.lit("Question: "), F.col("query"), F.lit("\n\nAnswer:\n"))
    gold = F.coalesce("answer", F.lit(""))
    recall = F.concat(question, gold, F.lit("\n\nPassages:\n"), F.coalesce(generate.recall_context(F.col("hits")), F.lit("")))
    faith = F.concat(question, F.col("model_answer"), F.lit("\n\nPassages:\n"), F.coalesce(generate.judge_context(F.col("hits")), F.lit("")))
    answerable, given = is_answerable(F.col("query_type")), F.coalesce("model_answer", F.lit("")) != ""
    asked = rows.withColumn("_recall", generate.ask(make, RECALL_PROMPT, recall, strict)).withColumn("_report", generate.ask(make_faithful or make, FAITHFUL_PROMPT, F.when(answerable & given, faith), strict))
    rejected = refused(F.col("model_answer"))
    unjudged = F.coalesce(F.size(F.filter("hits", lambda h: h["relevance"].isNull())), F.lit(0))
    return asked.withColumns(
        {
            "judge_failures": unjudged + F.col("_recall").isNull().cast("int") + (answerable & given & F.col("_report").isNull()).cast("int"),
            "ret_recall": recall_verdict(F.col("_recall")),
            "rouge_score": F.when(~answerable, F.lit(0.0)).when(given, rouge_l(gold, F.coalesce("model_answer", F.lit("")))),
            "faithfulness_verdict": F.when(~answerable, rejected.cast("int")).when(given, faithfulness_verdict(F.col("_report"))),
            "faithfulness_report": F.when(~answerable, F.when(rejected, "CORRECTLY REJECTED").otherwise("NOT REJECTED")).otherwise(F.col("_report")),
        }
    ).drop("_recall", "_report", "hits")


def averages(evaluated: DataFrame) -> DataFrame:
    """One row: averages over queries. Unanswerable recalls and undecided verdicts are left out; ROUGE-L is also given without unanswerable queries."""
    recall = F.col("ret_recall")
    verdict = F.coalesce("faithfulness_verdict", F.lit(0))
    rouge = F.coalesce("rouge_score", F.lit(0.0))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return evaluated.agg(
        mean(F.coalesce("ret_precision", F.lit(0.0))).alias("avg_precision"),
        mean(F.when(~recall.eqNullSafe("UNANSWERABLE"), F.when(recall == "YES", 1.0).otherwise(0.0))).alias("avg_recall"),
        mean(F.when(verdict != -1, verdict.cast("double"))).alias("avg_faithfulness"),
        mean(rouge).alias("avg_rouge"),
        mean(F.when(is_answerable(F.col("query_type")), rouge)).alias("avg_rouge_answerable"),
        F.count("*").alias("n_queries"),
    )


def rouge_by_type(evaluated: DataFrame) -> DataFrame:
    return evaluated.groupBy("query_type").agg(F.count("*").alias("n_queries"), F.avg(F.coalesce("rouge_score", F.lit(0.0))).alias("avg_rouge"))


def low_scores(evaluated: DataFrame, below: float = 0.3) -> DataFrame:
    return evaluated.where(F.coalesce("rouge_score", F.lit(0.0)) < below)
