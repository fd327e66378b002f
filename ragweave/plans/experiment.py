"""Whole runs: ingest a corpus, answer queries, audit answers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ragweave.operators import chunk, embed, evaluate, generate, merge, report
from ragweave.plans.config import Settings
from ragweave.plans.tables import keep
from ragweave.providers import ChatModel, Embedder, HashEmbedder, HttpChat, OverlapScorer, PairScorer, RuleChat
from ragweave.sources import corpus, sinks


@dataclass(frozen=True)
class Providers:
    """Factories, one for each role; each worker makes its own client. `cut` splits sentences in all steps of a run."""

    embedder: Callable[[], Embedder] = HashEmbedder
    scorer: Callable[[], PairScorer] = OverlapScorer
    decomposer: Callable[[], ChatModel] = RuleChat
    generator: Callable[[], ChatModel] = RuleChat
    retrieval_judge: Callable[[], ChatModel] = RuleChat
    answer_judge: Callable[[], ChatModel] = RuleChat
    cut: chunk.Cutter | None = None


def served(url: str, settings: Settings = Settings(), scorer: Callable[[], PairScorer] = OverlapScorer, cut: chunk.Cutter | None = None) -> Providers:
    """Clients of a local model server for the models that the settings name."""
    model = partial(HttpChat, url)
    return Providers(
        partial(model, settings.embedding_model, settings.embedding_timeout), scorer, partial(model, settings.generation_model), partial(model, settings.generation_model),
        partial(model, settings.retrieval_eval_model), partial(model, settings.judge_model), cut,
    )


def ingest(spark: SparkSession, raw: str, out: str, providers: Providers = Providers(), settings: Settings = Settings()) -> DataFrame:
    """Read, clean, chunk, embed and write a corpus below out; returns the index. Raises if nothing could be embedded."""
    masters, packed = chunk.build_chunks(keep(corpus.text_documents(spark, raw), "documents"), settings, providers.cut)
    sinks.write_chunks(masters, f"{out}/master_chunks")
    sinks.write_chunks(packed, f"{out}/all_chunks")
    sinks.write_index(embed.build_index(corpus.chunks(spark, f"{out}/all_chunks"), providers.embedder, settings, providers.cut), f"{out}/index")
    index = corpus.index(spark, f"{out}/index")
    if index.isEmpty():
        raise ValueError("no chunk could be embedded")
    return index


def answer_queries(queries: DataFrame, index: DataFrame, providers: Providers = Providers(), settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(answered queries, their hits); model_answer is null for all if run_generation is off."""
    from pyspark.sql import functions as F

    hits = keep(merge.retrieve(queries, index, providers.embedder, providers.scorer, providers.decomposer, settings, keep), "hits")
    if not settings.run_generation:
        return queries.withColumn("model_answer", F.lit(None).cast("string")), hits
    return keep(generate.answer(queries, hits, providers.generator, strict=settings.strict_models), "answers"), hits


def run_experiment(queries: DataFrame, index: DataFrame, providers: Providers = Providers(), settings: Settings = Settings()) -> DataFrame:
    """Evaluated queries: retrieval, answers and, if run_audit, judgement and trace."""
    answered, hits = answer_queries(queries, index, providers, settings)
    if not settings.run_audit:
        return answered
    judged = keep(evaluate.judge_relevance(hits, providers.retrieval_judge, settings.compat_substring_verdict, settings.strict_models), "judged")
    audited = evaluate.audit(answered, judged, providers.retrieval_judge, providers.answer_judge, settings.strict_models)
    return keep(audited.join(report.traces(judged), "query_id", "left"), "audited")


def run(spark: SparkSession, raw: str, out: str, questions: list[dict], providers: Providers = Providers(), settings: Settings = Settings()) -> DataFrame:
    """The whole of an experiment: the corpus is ingested if run_ingestion is set, else its index is read; audits are reported below out."""
    index = ingest(spark, raw, out, providers, settings) if settings.run_ingestion else corpus.index(spark, f"{out}/index")
    done = run_experiment(corpus.queries(spark, questions), index, providers, settings)
    if settings.run_audit:
        sinks.write_report(done, f"{out}/reports", settings)
    return done


def main(spark: SparkSession, mode: str, out: str, raw: str | None = None, query: str | None = None, queries: list[dict] | None = None, providers: Providers = Providers(), settings: Settings = Settings()) -> DataFrame:
    """One entry for three modes: `ingest` gives the index of raw, `gen` the answer to query, `eval` the audited queries."""
    if mode == "ingest":
        return ingest(spark, raw, out, providers, settings)
    if mode == "gen":
        return answer_queries(corpus.single_query(spark, query), corpus.index(spark, f"{out}/index"), providers, settings)[0]
    if mode == "eval":
        return run_experiment(corpus.queries(spark, queries or []), corpus.index(spark, f"{out}/index"), providers, settings)
    raise ValueError(f"unknown mode {mode!r}")
