"""Embedding with retries and part-wise recovery, pooling and normalisation."""

from __future__ import annotations

import time
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.operators.chunk import Cutter, Pieces, rule_sentences
from ragweave.plans.config import Settings
from ragweave.providers import Embedder


#: Characters of text that go to a model at once, beside their copies and replies.
LOT_CHARS = 1 << 20


def lots(*columns: pd.Series) -> Iterator[tuple[pd.Series, ...]]:
    """The same rows in runs of about LOT_CHARS characters, one row at least; freed Arrow memory goes back after each."""
    start = total = 0
    for i, row in enumerate(zip(*columns)):
        size = sum(len(x) for x in row if isinstance(x, str))
        if i > start and total + size > LOT_CHARS:
            yield tuple(c.iloc[start:i] for c in columns)
            pa.default_memory_pool().release_unused()
            start, total = i, 0
        total += size
    yield tuple(c.iloc[start:] for c in columns)
    pa.default_memory_pool().release_unused()


def weighted_mean(vectors: list[list[float]], weights: list[int]) -> list[float]:
    return np.average(np.asarray(vectors, dtype=float), axis=0, weights=np.asarray(weights, dtype=float)).tolist()


def parts_of(text: str, limit: int, cut: Cutter = rule_sentences) -> list[str]:
    """Runs of sentences shorter than limit when joined; a longer sentence is a part of its own.

    The first run counts a space before it.
    """
    pieces, start, lead, out = Pieces(text, cut), 0, 1, []
    while start < len(pieces.parts):
        stop = max(start + 1, bisect_left(pieces.ends, limit + pieces.ends[start] + 2 - lead) - 1)
        out.append(pieces.join(start, stop))
        start, lead = stop, 0
    return [p for p in out if p]


def embed_with_recovery(embedder: Embedder, text: str, settings: Settings, cut: Cutter = rule_sentences) -> list[float] | None:
    """The text's vector; if that keeps failing, the length-weighted mean of its parts' vectors; None if all fail."""

    def attempt(t: str) -> list[float] | None:
        for _ in range(settings.embedding_attempts):
            try:
                return list(embedder.embed(t))
            except Exception:
                time.sleep(settings.embedding_pause)
        return None

    if (whole := attempt(text)) is not None:
        return whole
    found = [(v, len(p)) for p in parts_of(text, settings.part_chars, cut) if (v := attempt(p)) is not None]
    return weighted_mean([v for v, _ in found], [n for _, n in found]) if found else None


def embed_many(embedder: Embedder, texts: list[str], settings: Settings, cut: Cutter = rule_sentences) -> list[list[float] | None]:
    """Vectors of texts, embedding_batch in a call where the embedder has embed_batch; a batch that fails goes one by one."""
    out: list[list[float] | None] = []
    for start in range(0, len(texts), settings.embedding_batch):
        part = texts[start : start + settings.embedding_batch]
        try:
            out += [list(v) for v in embedder.embed_batch(part)]
        except Exception:
            out += [embed_with_recovery(embedder, t, settings, cut) for t in part]
    return out


def embed_column(texts: Column, make: Callable[[], Embedder], settings: Settings = Settings(), cut: Cutter | None = None) -> Column:
    """array<float>; the client is made once for each task. Null texts have none."""

    def run(parts):
        embedder = make()
        for (part,) in (lot for whole in parts for lot in lots(whole)):
            given = [t for t in part if t is not None]
            found = iter(embed_many(embedder, given, settings, cut or rule_sentences))
            yield pd.Series([None if t is None else next(found) for t in part], dtype=object)

    return model_udf(run, "array<float>")(texts)


def model_udf(func, kind: str):
    """A scalar iterator pandas UDF that Catalyst neither repeats nor merges."""
    from pyspark.sql.pandas.functions import PandasUDFType

    return F.pandas_udf(func, kind, PandasUDFType.SCALAR_ITER).asNondeterministic()


def l2_normalize(v: Column) -> Column:
    """Unit length, computed in double; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def mean_pool(parts: DataFrame, key: str = "chunk_id", vector: str = "embedding", weight: str = "weight") -> DataFrame:
    """(key, embedding): weighted mean of the vectors of each key."""
    flat = parts.select(key, F.col(weight).cast("double").alias("w"), F.posexplode(vector).alias("pos", "x"))
    means = flat.groupBy(key, "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("embedding"))


def build_index(chunks: DataFrame, make: Callable[[], Embedder], settings: Settings = Settings(), cut: Cutter | None = None) -> DataFrame:
    """Index rows of the chunks that could be embedded. The caller writes them before reading them twice."""
    rows = chunks.select("chunk_id", "text", F.col("metadata.source").alias("source"), F.col("metadata.path").alias("path"))
    embedded = rows.withColumn("embedding", embed_column(F.col("text"), make, settings, cut)).where("embedding is not null")
    return embedded.withColumn("norm_embedding", l2_normalize(F.col("embedding")).cast("array<float>"))
