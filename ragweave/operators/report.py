"""Tables of an experiment: summary, detail, trace blocks and displays."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragweave.functions import text as T
from ragweave.operators import evaluate
from ragweave.plans.config import Settings


def summary(evaluated: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(Metric, Value): seven rows."""
    a = evaluate.averages(evaluated)
    # The names of the metrics.
    rows = (
        ("Iteration", F.lit(settings.iteration)),
        ("Chunking Mode", F.lit(settings.chunk_mode)),
        ("Avg Precision@K", F.col("avg_precision")),
        ("Avg Recall", F.col("avg_recall")),
        ("Avg Faithfulness (1=Strict)", F.col("avg_faithfulness")),
        ("Avg ROUGE-L", F.col("avg_rouge")),
        ("Total Queries", F.col("n_queries")),
    )
    return a.select(F.explode(F.array(*(F.struct(F.lit(k).alias("Metric"), v.cast("string").alias("Value")) for k, v in rows))).alias("r")).select("r.*")


def detail(evaluated: DataFrame) -> DataFrame:
    """One row for each query, numbered from 1 in the order of query_id (ids are dense from 0 or 1 or numbered anew by a sort)."""
    from ragweave.operators.chunk import dense_ids

    numbered = dense_ids(evaluated.withColumn("_place", F.row_number().over(Window.partitionBy("query_id").orderBy("query_id")) - 1), "query_id", "_place", "_n")
    return numbered.select(
        (F.col("_n") + 1).alias("ID"), F.col("query").alias("Question"), F.col("answer").alias("Reference"), F.col("model_answer").alias("Model Answer"), F.col("ret_recall").alias("Recall Verdict"), F.col("rouge_score").alias("ROUGE-L"), F.col("faithfulness_verdict").alias("Faithfulness Verdict"), F.col("faithfulness_report").alias("Audit Report (Raw)"), F.col("traceable_context").alias("Sources Used"),
    )


def trace_block(hit: Column, number: Column) -> Column:
    shown = lambda c: F.format_string("%s", F.round(F.coalesce(c, F.lit(0.0)), 4))
    return F.concat(
        F.lit("ID: "), number.cast("string"), F.lit(" | Similarity Score: "), shown(hit["score"]), F.lit(" | Re-Ranker Score: "), shown(hit["relevance_score"]),
        F.lit(" | Source: "), F.coalesce(hit["source"], F.lit("N/A")), F.lit(" | Verdict: "), F.coalesce(hit["relevance"], F.lit("-")), F.lit("\nContent: "), F.coalesce(hit["text"], F.lit("")),
    )


def traces(judged: DataFrame) -> DataFrame:
    """(query_id, traceable_context): a rule and the blocks of all hits in order."""
    fields = F.struct(F.col("final_rank").alias("rank"), "score", "relevance_score", "source", "relevance", "text")
    hits = judged.groupBy("query_id").agg(F.array_sort(F.collect_list(fields)).alias("hits"))
    blocks = F.array_join(F.transform("hits", lambda h, i: trace_block(h, i + 1)), "\n\n")
    return hits.select("query_id", F.concat(F.lit("\n\n" + "=" * 50), blocks).alias("traceable_context"))


def source_or_na(source: Column, metadata_source: Column) -> Column:
    return F.coalesce(F.when(source != "", source), metadata_source, F.lit("N/A"))


def display(hits: DataFrame, rank: str = "final_rank", wrapped: bool = True) -> DataFrame:
    """Ranked table for people; missing scores show as N/A."""
    text, source = F.coalesce("text", F.lit("N/A")), source_or_na(F.col("source"), F.col("metadata.source") if "metadata" in hits.columns else F.lit(None))
    return hits.select(
        F.col(rank).alias("Rank"), (T.wrap(source, 20) if wrapped else source).alias("Source"), T.display_score(F.col("score")).alias("Similarity Score"), T.display_score(F.col("relevance_score")).alias("Re-Ranker Score"), F.coalesce("relevance", F.lit("-")).alias("Precision Verdict"), (T.wrap(text, 100) if wrapped else text).alias("Text Snippet"),
    )


def run_name(settings: Settings, now: datetime | None = None) -> str:
    return f"Iteration_{settings.iteration}_Audit_{settings.chunk_mode}_K{settings.top_k}_{(now or datetime.now()):%Y%m%d_%H%M}"
