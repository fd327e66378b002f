"""Reranking and the merge of several sub-queries' hits."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragweave.operators import route, search
from ragweave.operators.embed import embed_column, lots, model_udf
from ragweave.plans.config import Settings
from ragweave.providers import ChatModel, Embedder, PairScorer


def rerank(hits: DataFrame, make: Callable[[], PairScorer], query: str = "query") -> DataFrame:
    """Add relevance_score of (query, source and text)."""

    def run(parts):
        scorer = make()
        for q, source, text in (lot for whole in parts for lot in lots(*whole)):
            yield pd.Series(scorer.score([(a or "", f"Source: {s or ''}\n{t or ''}") for a, s, t in zip(q, source, text)]), dtype="float64")

    return hits.withColumn("relevance_score", model_udf(run, "double")(query, "source", "text"))


def first_k(hits: DataFrame, k: int = 3, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best by relevance; equal ones keep their search rank."""
    by = Window.partitionBy(*keys).orderBy(F.desc("relevance_score"), "rank")
    return hits.withColumn("final_rank", F.row_number().over(by)).where(F.col("final_rank") <= k)


def round_robin(hits: DataFrame, k: int = 3) -> DataFrame:
    """Interleave the lists (query_id, sub_idx) by depth, keep each chunk's first place, and cut at k (one or more)."""
    depth = F.row_number().over(Window.partitionBy("query_id", "sub_idx").orderBy(F.desc("relevance_score"), "rank"))
    once = F.row_number().over(Window.partitionBy("query_id", "chunk_id").orderBy("depth", "sub_idx"))
    last = F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "sub_idx"))
    first = hits.withColumn("depth", depth).withColumn("_n", once).where("_n = 1")
    return first.withColumn("final_rank", last).where(F.col("final_rank") <= k).drop("_n")


def retrieve(queries: DataFrame, index: DataFrame, embedder: Callable[[], Embedder], scorer: Callable[[], PairScorer], chat: Callable[[], ChatModel], settings: Settings = Settings(), materialize: Callable[[DataFrame, str], DataFrame] = lambda df, name: df.persist()) -> DataFrame:
    """(query_id, query, final_rank, score, relevance_score, chunk_id, text, source) for a batch of queries.

    Simple queries are one sub-query, so one plan serves both kinds. Model calls are kept by `materialize`, so that no
    later stage repeats them.
    """
    asked = route.sub_queries(queries, chat, settings)
    sub = asked.select("query_id", "query", F.posexplode("sub_queries").alias("sub_idx", "sub_query"))
    sub = sub.withColumn("q", F.col("query_id") * 64 + F.col("sub_idx")).withColumn("query_embedding", embed_column(F.col("sub_query"), embedder, settings))
    sub = materialize(sub, "sub_queries")
    hits = search.with_text(search.top_n(sub, index, settings.top_n, settings.method, query_key="q"), index)
    kept = search.filter_hits(hits, settings.threshold, settings.min_words).withColumnRenamed("query_id", "q")
    paired = kept.join(sub.select("q", "query_id", "query", "sub_idx", "sub_query"), "q").drop("q")
    ranked = materialize(rerank(paired, scorer, "sub_query"), "reranked")
    return round_robin(ranked, settings.top_k).select("query_id", "query", "final_rank", "score", "relevance_score", "chunk_id", "text", "source")
