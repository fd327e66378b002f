"""Quality scores from histogram gradient-boosted trees over statistics of whole documents.

Trees are grown level by level on binned statistics of a bounded labelled sample and flattened into arrays, so that
scoring is a few gathers for each tree level over all documents of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.llm.common import map_slices, share_by_hash
from ragweave.llm.repeats import raw_texts

#: Labelled rows that are fitted: those of smallest hash.
FIT_ROWS = 20_000
BINS, ROUNDS, DEPTH, RATE, SHRINK = 64, 80, 5, 0.15, 1.0
THRESHOLD = 0.7
NAMES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "letters", "capitals", "digits", "punctuation", "symbols", "spaces", "lines_per_kb", "high_bytes", "distinct_words",
    "distinct_lines", "compressed", "longest_word", "short_words", "stops_per_word", "byte_entropy", "top_byte", "capital_words", "words_ending_odd", "line_length", "commas_per_word",
)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_ALPHA[128:] = True
_PUNCT, _SYMBOLS = np.frombuffer(b".,;:!?'\"()-", np.uint8), np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8)
_END = np.zeros(256, dtype=bool)
_END[_SYMBOLS] = True
_squeeze = zstandard.ZstdCompressor(level=1)


def statistics(text: bytes) -> list[float]:
    """One number for each of NAMES; zeros for the empty text."""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    data = np.frombuffer(text, np.uint8)
    counts = np.bincount(data, minlength=256)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]  # of the words
    sizes = ends - starts
    words = text.split()
    m = max(1, len(words))
    lines = text.split(b"\n")
    share = counts[counts > 0] / n
    mean = sizes.mean() if len(sizes) else 0.0
    return [
        np.log1p(n), np.log1p(len(words)), mean, sizes.std() if len(sizes) else 0.0, counts[_ALPHA].sum() / n, counts[65:91].sum() / n, counts[48:58].sum() / n, counts[_PUNCT].sum() / n, counts[_SYMBOLS].sum() / n, counts[_SPACE].sum() / n, 1000 * counts[10] / n, counts[128:].sum() / n, len(set(words)) / m,
        len(set(lines)) / len(lines), len(_squeeze.compress(text)) / n, float(sizes.max()) if len(sizes) else 0.0, (sizes <= 3).sum() / m, (counts[46] + counts[33] + counts[63]) / m, float(-(share * np.log2(share)).sum()), counts.max() / n, ((data[starts] >= 65) & (data[starts] <= 90)).sum() / m, _END[data[ends - 1]].sum() / m if len(ends) else 0.0, n / len(lines), counts[44] / m,
    ]


class Trees:
    """Boosted trees as arrays: feature, cut and value of node i of tree t; node i's children are 2i + 1 and 2i + 2."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.cut, self.value = base, feature, cut, value

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                node = 2 * node + 1 + (x[rows, f] > cut[node])
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Newton boosting of the logistic loss with histograms of BINS quantile bins; deterministic."""
    nodes = 2 ** (DEPTH + 1) - 1
    feature, cut, value = np.zeros((rounds, nodes), np.int64), np.full((rounds, nodes), np.inf), np.zeros((rounds, nodes))
    if not len(y):
        return Trees(0.0, feature[:0], cut[:0], value[:0])
    n, m = x.shape
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return Trees(base, feature[:0], cut[:0], value[:0])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)])
    score, offsets = np.full(n, base), (np.arange(m) * BINS)[:, None]
    for t in range(rounds):
        prob = 1 / (1 + np.exp(-score))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(n, dtype=np.int64)
        for depth in range(DEPTH):
            first, wide = 2**depth - 1, 2**depth
            local = node - first
            keys = (local * (m * BINS) + (binned + offsets)).ravel()
            shape = (wide, m, BINS)
            hist = [np.bincount(keys, np.broadcast_to(w, (m, n)).ravel(), wide * m * BINS).reshape(shape) for w in (g, h)]
            gl, hl = (np.cumsum(v, axis=2) for v in hist)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + SHRINK) + (gt - gl) ** 2 / (ht - hl + SHRINK) - gt**2 / (ht + SHRINK)
            gain[(hl < 1) | (ht - hl < 1)] = -1
            gain[:, :, -1] = -1
            for i in range(wide):
                j, b = np.unravel_index(int(gain[i].argmax()), (m, BINS))
                if gain[i, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, first + i], cut[t, first + i] = j, edges[j][b]
            f, c = feature[t, node], cut[t, node]
            node = 2 * node + 1 + (x[np.arange(n), f] > c)
        first = 2**DEPTH - 1
        gs, hs = (np.bincount(node - first, w, 2**DEPTH) for w in (g, h))
        value[t, first:] = -RATE * gs / (hs + SHRINK)
        score += value[t, node]
    return Trees(base, feature, cut, value)


def _stats(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    rows = docs.select(*keys, F.col(text).alias("_text"))
    kinds = ", ".join(f"{k} {t}" for k, t in rows.dtypes[:-1])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = np.asarray([statistics(t) for t in raw_texts(batch, len(keys))], dtype=np.float64)
        offsets = np.arange(0, stats.size + 1, len(NAMES), dtype=np.int32)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets), pa.array(stats.ravel()))], [*keys, "stats"])

    return map_slices(rows, run, f"{kinds}, stats array<double>", "_text")


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """Fit on the FIT_ROWS labelled rows of smallest hash for which `allowed`, a condition on the key, holds.

    Labels of a document that is labelled repeatedly are averaged (a half or more counts as 1); null labels do not count.
    """
    some = share_by_hash(F.xxhash64(key), F.lit(max(1, labels.count())), FIT_ROWS)
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & allowed & some).groupBy(key).agg((F.avg(label) >= 0.5).cast("double").alias("_y"))
    chosen = marked.orderBy(F.xxhash64(key), key).limit(FIT_ROWS)
    rows = docs.select(F.col(key), F.col(text)).join(F.broadcast(chosen), key)  # at most FIT_ROWS rows
    found = _stats(rows, [key, "_y"], text).collect()
    found.sort(key=lambda r: (r[0], r["stats"]))
    x = np.asarray([r["stats"] for r in found], dtype=np.float64).reshape(-1, len(NAMES))
    return fit_trees(x, np.asarray([r["_y"] for r in found], dtype=np.float64))


def score(docs: DataFrame, trees: Trees, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, score, predicted) of every row.

    Null and empty texts are scored by their zero statistics. Without labels every score is 0.5. Repeated rows stay;
    extra columns are ignored; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.asarray([statistics(t) for t in raw_texts(batch, 1)], dtype=np.float64)
        found = sent.value.probability(x)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["_key", "score", "predicted"])

    return map_slices(rows, run, f"_key {dict(rows.dtypes)['_key']}, score double, predicted int", "_text").withColumnRenamed("_key", key)
