"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Rows are spread over stripes of about `stripe_rows`; each stripe keeps postings (row, weight) for every term (vector
component). Blocks of queries stream past every stripe: each non-zero term of a sparse query row scatters its
weighted postings into a dense score array, partition selection keeps k rows for each query and stripe, and a window
merges the stripes. A task holds one stripe and one block of queries, whatever the table's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

#: Rows of a stripe at most; small tables have smaller ones, a few for each core.
STRIPE_ROWS, LEAST_ROWS = 131_072, 2048
QUERY_BLOCK = 256


def _usable(column: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of usable vectors and their integer components."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)
    flat = column.flatten()  # null lists have no values
    values = np.floor(scale * np.asarray(pc.fill_null(flat.cast(pa.float64()), np.nan), dtype=np.float64))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    at = np.flatnonzero(np.asarray(column.is_valid()) & (bad[bounds[1:]] == bad[bounds[:-1]]))
    out = []
    for a, b in zip(bounds[at].tolist(), bounds[at + 1].tolist()):
        x = values[a:b]
        if b > a and np.abs(x).max() > np.sqrt((2**63 - 1) / (b - a)) / 2:
            raise OverflowError("components are too large for scores of 64 bits")
        out.append(x.astype(np.int64))
    return at, out


def _packed(stripe: int, kind: int, ids: np.ndarray, vectors: list[np.ndarray]) -> tuple:
    """One row for many sparse vectors: their term counts, terms and weights."""
    terms = [np.flatnonzero(v) for v in vectors]
    return (stripe, kind, ids.astype(np.int64).tobytes(), np.asarray([len(t) for t in terms], dtype=np.int32).tobytes(), np.concatenate([np.zeros(0, np.int32), *terms]).astype(np.int32).tobytes(), np.concatenate([np.zeros(0, np.int64), *(v[t] for v, t in zip(vectors, terms))]).astype(np.int64).tobytes())


PACKED = "stripe int, kind int, ids binary, counts binary, terms binary, weights binary"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["stripe", "kind", "ids", "counts", "terms", "weights"])


class _Stripe:
    """Postings of one stripe and the dense scores of the query at hand."""

    def __init__(self, parts: list[dict]):
        self.ids = np.concatenate([np.frombuffer(p["ids"], np.int64) for p in parts])
        counts = np.concatenate([np.frombuffer(p["counts"], np.int32) for p in parts])
        terms = np.concatenate([np.frombuffer(p["terms"], np.int32) for p in parts])
        weights = np.concatenate([np.frombuffer(p["weights"], np.int64) for p in parts])
        rows = np.repeat(np.arange(len(self.ids)), counts)
        order = np.argsort(terms, kind="stable")
        terms, rows, weights = terms[order], rows[order], weights[order]
        heads = np.flatnonzero(np.diff(terms, prepend=-1))
        self.postings = {int(terms[a]): (rows[a:b], weights[a:b]) for a, b in zip(heads, [*heads[1:], len(terms)])}
        self.scores = np.zeros(len(self.ids), dtype=np.int64)
        self.scratch = np.zeros(len(self.ids), dtype=np.int64)

    def search(self, query_id: int, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores, n = self.scores, len(self.ids)
        scores[:] = 0
        for term, weight in zip(terms.tolist(), weights.tolist()):
            if (posting := self.postings.get(term)) is None:
                continue
            rows, values = posting
            part = np.multiply(values, weight, out=self.scratch[: len(rows)])
            if len(rows) == n:  # every row has the term, in order
                scores += part
            else:
                scores[rows] += part
        others = np.flatnonzero(self.ids != query_id)
        if len(others) > k:
            own = scores[others]
            others = others[own >= np.partition(own, len(own) - k)[len(own) - k]]
        best = others[np.lexsort((self.ids[others], -scores[others]))[:k]]
        return self.ids[best], scores[best]


def top_k(vectors: DataFrame, k: int = 5, key: str = "vec_id", value: str = "embedding", is_query: Column | None = None, scale: int = 256, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query row, ties to the smaller id.

    Components become floor(scale * x). Vectors that are null or hold a null or non-finite component take no part.
    Vectors of unlike length meet in the terms they share. Rows that repeat an id are all candidates, but never of a
    query with that id; repeated query ids share one list. Fewer than k others give fewer rows; an empty table none.
    Finite components so large that a score could pass 64 bits raise OverflowError.
    """
    is_query = F.col(key) % 50 == 0 if is_query is None else is_query
    rows = vectors.select(F.col(key).cast("long").alias("_id"), F.col(value).cast("array<double>").alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q")).where("_id is not null")
    count, cores = rows.count(), vectors.sparkSession.sparkContext.defaultParallelism
    stripes = max(1, -(-count // max(1, min(stripe_rows, max(LEAST_ROWS, count // (2 * cores))))))

    def pack(batches):
        for batch in batches:
            at, vectors = _usable(batch.column(1), scale)
            if not len(at):
                continue
            ids = np.asarray(batch.column(0), dtype=np.int64)[at]
            queries = np.flatnonzero(np.asarray(batch.column(2).to_numpy(zero_copy_only=False))[at])
            stripe = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(stripes)
            found = [_packed(int(s), 0, ids[m], [vectors[i] for i in m]) for s in np.unique(stripe) for m in [np.flatnonzero(stripe == s)]]
            found += [_packed(-1, 1, ids[m], [vectors[i] for i in m]) for a in range(0, len(queries), QUERY_BLOCK) for m in [queries[a : a + QUERY_BLOCK]]]
            yield _rows(found)

    def score(batches):
        stripe, parts, index = None, [], None
        for batch in batches:
            found: list[list[np.ndarray]] = []
            for row in batch.to_pylist():
                if row["stripe"] != stripe:
                    stripe, parts, index = row["stripe"], [], None
                if row["kind"] == 0:
                    parts.append(row)
                    continue
                if not parts and index is None:
                    continue  # an empty stripe
                if index is None:
                    index, parts = _Stripe(parts), []
                ids, counts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int32)
                terms, weights, at = np.frombuffer(row["terms"], np.int32), np.frombuffer(row["weights"], np.int64), 0
                for query_id, count in zip(ids.tolist(), counts.tolist()):
                    best, scores = index.search(query_id, terms[at : at + count], weights[at : at + count], k)
                    found.append([np.full(len(best), query_id), best, scores])
                    at += count
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)], ["query_id", "vec_id", "score"])

    packed = rows.mapInArrow(pack, PACKED)
    stripe_of = F.explode(F.when(F.col("kind") == 0, F.array("stripe")).otherwise(F.sequence(F.lit(0), F.lit(stripes - 1))))
    dealt = packed.select(stripe_of.alias("stripe"), "kind", "ids", "counts", "terms", "weights").repartition("stripe").sortWithinPartitions("stripe", "kind")
    found = dealt.mapInArrow(score, "query_id long, vec_id long, score long")
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
