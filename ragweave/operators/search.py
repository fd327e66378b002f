"""Exact similarity search of query batches: every task keeps the best rows of each query, a window merges them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragweave.functions import text as T

#: Queries up to which all are sent to every task; more are dealt out against groups of index rows.
QUERY_BLOCK = 4096
#: Index rows of a group, about, and their bytes at most; small tables have smaller groups, one for each core, of so many rows at least.
GROUP_ROWS, GROUP_BYTES, LEAST_ROWS = 131_072, 64 << 20, 8192
#: Queries and index rows whose scores a worker holds at once.
TILE_QUERIES, TILE_ROWS = 256, 4096
#: Bytes of vectors in a packed row.
PACK_BYTES = 1 << 20
#: Decimals of a score: equal vectors tie, wherever they are computed.
DECIMALS = 12
_FOUND = "query_id long, chunk_id long, score double"


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(positions, vectors) of the non-null vectors; they share one length."""
    at = np.flatnonzero(np.asarray(column.is_valid()))
    if not len(at):
        return at, np.zeros((0, 0))
    flat = np.asarray(column.filter(column.is_valid()).flatten(), dtype=np.float64)
    return at, flat.reshape(len(at), -1)


def _unit(data: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(data, axis=1, keepdims=True)
    return np.divide(data, size, out=np.zeros_like(data), where=size > 0)


class _Best:
    """The n best rows of each of a tile's queries so far, ties to the smaller id. Scores that are no numbers take no part.

    A query with n rows has a floor, the last of them by score and id; only rows before it are kept.
    """

    def __init__(self, ids: np.ndarray, unit: np.ndarray, n: int):
        self.ids, self.unit, self.n, self.found, self.size = ids, unit, n, [], 0
        self.floor, self.last = np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max)

    def add(self, keys: np.ndarray, data: np.ndarray) -> None:
        for a in range(0, len(keys), TILE_ROWS):
            self._add(keys[a : a + TILE_ROWS], data[a : a + TILE_ROWS])

    def _add(self, keys: np.ndarray, data: np.ndarray) -> None:
        scores = self.unit @ data.T
        floor = self.floor
        over = scores >= self._under(floor)
        if len(keys) > self.n and np.count_nonzero(over) > 2 * self.n * len(self.ids):
            floor = np.fmax(floor, -np.partition(-scores, self.n - 1, axis=1)[:, self.n - 1])
            over = scores >= self._under(floor)
        q, k = np.nonzero(over)
        scores, keys = np.round(scores[q, k], DECIMALS), keys[k]
        kept = (scores > self.floor[q]) | ((scores == self.floor[q]) & (keys < self.last[q]))
        self.found.append((q[kept], keys[kept], scores[kept]))
        self.size += int(kept.sum())
        if self.size > 2 * self.n * len(self.ids):
            self.prune()

    @staticmethod
    def _under(floor: np.ndarray) -> np.ndarray:
        """What no score lies under that may be rounded to the floor."""
        return (floor - 1e-11 * np.maximum(1.0, np.abs(floor)))[:, None]

    def prune(self) -> None:
        q, keys, scores = (np.concatenate(c) for c in zip(*self.found))
        order = np.lexsort((keys, -scores, q))
        q, keys, scores = q[order], keys[order], scores[order]
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.ids)))[q]
        nth = place == self.n - 1
        self.floor[q[nth]], self.last[q[nth]] = scores[nth], keys[nth]
        kept = place < self.n
        self.found, self.size = [(q[kept], keys[kept], scores[kept])], int(kept.sum())

    def batch(self) -> pa.RecordBatch:
        if self.found:
            self.prune()
        q, keys, scores = self.found[0] if self.found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(keys.astype(np.int64)), pa.array(scores)], ["query_id", "chunk_id", "score"])


def top_n(queries: DataFrame, index: DataFrame, n: int = 100, method: str = "faiss", query_key: str = "query_id", query_vector: str = "query_embedding", key: str = "chunk_id") -> DataFrame:
    """(query_id, rank, chunk_id, score): the n best rows of each query, ties to the smaller id.

    method `base` takes the cosine of raw vectors, `faiss` the inner product of norm_embedding with the normalised
    query. Queries without a vector, or with a zero one, have no hits.
    """
    if method not in ("base", "faiss"):
        raise ValueError(f"unknown search method {method!r}")
    cosine = method == "base"
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    asked = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_key).cast("long").alias("k"), F.col(query_vector).alias("v")).where(norm > 0)
    rows = index.select(F.col(key).cast("long").alias("k"), F.col("embedding" if cosine else "norm_embedding").alias("v"))
    some = asked.limit(QUERY_BLOCK + 1).toArrow()
    if some.num_rows <= QUERY_BLOCK:
        found = rows.mapInArrow(_scan(queries.sparkSession.sparkContext.broadcast(some), n, cosine), _FOUND)
    else:
        width = len(some.column(1)[0])
        found = _grid(asked, rows, n, cosine, min(GROUP_ROWS, max(1, GROUP_BYTES // (8 * width))))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n).select("query_id", "rank", "chunk_id", "score")


def _scan(sent, n: int, cosine: bool):
    """All queries against the rows of a task."""

    def run(batches):
        asked = sent.value.combine_chunks()
        if not asked.num_rows:
            return
        ids, unit = np.asarray(asked.column(0)), _unit(_matrix(asked.column(1).combine_chunks())[1])
        tiles = [_Best(ids[a : a + TILE_QUERIES], unit[a : a + TILE_QUERIES], n) for a in range(0, len(ids), TILE_QUERIES)]
        for batch in batches:
            at, data = _matrix(batch.column(1))
            if len(at):
                keys, data = np.asarray(batch.column(0))[at], _unit(data) if cosine else data
                for best in tiles:
                    best.add(keys, data)
        for best in tiles:
            yield best.batch()

    return run


def _grid(asked: DataFrame, rows: DataFrame, n: int, cosine: bool, group_rows: int) -> DataFrame:
    """Packed tiles of queries stream past every group of index rows; a task holds one group and one tile."""
    count, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-count // group_rows), min(cores, count // LEAST_ROWS))

    def packed(cell: int, kind: int, keys: np.ndarray, data: np.ndarray, most: int):
        step = max(1, min(most, PACK_BYTES // (8 * data.shape[1])))
        for a in range(0, len(keys), step):
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([kind], pa.int32()), pa.array([keys[a : a + step].astype(np.int64).tobytes()], pa.binary()), pa.array([data[a : a + step].tobytes()], pa.binary())], ["cell", "kind", "ids", "vectors"])

    def pack_rows(batches):
        for batch in batches:
            at, data = _matrix(batch.column(1))
            if not len(at):
                continue
            keys = np.asarray(batch.column(0))[at]
            data = _unit(data) if cosine else data
            cells = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(groups)
            for cell in np.unique(cells).tolist():
                m = cells == cell
                yield from packed(cell, 0, keys[m], data[m], TILE_ROWS)

    def pack_queries(batches):
        for batch in batches:
            at, data = _matrix(batch.column(1))
            if len(at):
                yield from packed(-1, 1, np.asarray(batch.column(0))[at], _unit(data), TILE_QUERIES)

    def score(batches):
        now, held, more = None, [], []

        def tile():
            held.append(tuple(np.concatenate(c) for c in zip(*more)))
            more.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                cell, kind = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids = np.frombuffer(batch.column(2)[i].as_py(), np.int64)
                data = np.frombuffer(batch.column(3)[i].as_py(), np.float64).reshape(len(ids), -1)
                if cell != now:
                    now, held, more = cell, [], []
                if kind == 0:
                    more.append((ids, data))
                    if sum(len(x) for x, _ in more) >= TILE_ROWS:
                        tile()
                    continue
                if more:
                    tile()
                best = _Best(ids, data, n)
                for keys, part in held:
                    best.add(keys, part)
                yield best.batch()

    shape = "cell int, kind int, ids binary, vectors binary"
    tiles = asked.mapInArrow(pack_queries, shape).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = rows.mapInArrow(pack_rows, shape).union(tiles).repartitionById(groups, F.col("cell")).sortWithinPartitions("cell", "kind")
    return dealt.mapInArrow(score, _FOUND)


def with_text(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Join text and source to hits by chunk id, after the cut."""
    return hits.join(index.select("chunk_id", "text", "source"), "chunk_id").select("query_id", "rank", "score", "chunk_id", "text", "source")


def filter_hits(hits: DataFrame, threshold: float = 0.5, min_words: int = 10) -> DataFrame:
    """Hits over the threshold with more than min_words words; applied after the top-N, whose slots dropped hits use up."""
    return hits.where((F.col("score") > threshold) & (T.word_count(F.col("text")) > min_words))
