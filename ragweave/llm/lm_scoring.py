"""Language-model scores: a small causal self-attention model over subword ids, beside a smoothed unigram base.

One pass over the texts splits them into words and subword ids, and asks for the corpus counts of its distinct words
in packed parts, so that counting needs neither a row for each word nor a vocabulary on the driver. Subwords are the
longest matching pieces of a fixed public vocabulary. The model predicts a class of the next id from a window of ids
(attention weights learned in numpy: begun on a sample, then carried over all training texts on the executors, and
averaged) and the id within its class from the counts, over the whole training corpus, of ids after each id, smoothed
by those after each of BUCKETS groups of ids. Long texts are cut into overlapping windows; every token is scored once, with
at least OVERLAP tokens before it but at the start.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.llm import repeats as R
from ragweave.llm.common import buckets, materialize, share_by_hash, slices
from ragweave.llm.sentencepiece_codec import MARK, default_model

WIDTH, CLASSES, SPAN, OVERLAP = 16, 48, 16, 4
#: Texts and windows the attention weights begin with, and steps of that; all training texts follow.
TRAIN_TEXTS, TRAIN_WINDOWS, STEPS, BATCH = 5000, 240_000, 1500, 384
#: Windows in a step over all training texts, its rate, and runs that the weights are cut into to be summed.
ALL_BATCH, ALL_RATE, RUNS = 768, 0.002, 64
#: Groups of ids, by hash, whose followers are counted; the weight of the class's own distribution in a group's.
BUCKETS, SMOOTH = 1024, 8.0
#: Windows worked on at once.
BLOCK = 64
_SLOTS, _MULTIPLY, _LONGEST = 17, np.uint64(0x9E3779B97F4A7C15), 7
_MASKS = [np.uint64((1 << (8 * n)) - 1) for n in range(_LONGEST + 1)]
ADD = 0.1
#: White space to spaces, A-Z to a-z.
_FOLD = bytes(32 if c in b" \t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Subwords:
    """Longest-match segmentation of words into vocabulary pieces of 2 to 7 bytes, or else single bytes."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.keys, self.ids, n = np.zeros(1 << _SLOTS, np.uint64), np.zeros(1 << _SLOTS, np.int32), 256
        for i in range(model.get_piece_size()):
            raw = model.id_to_piece(i).replace(MARK, " ").encode()
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or not 2 <= len(raw) <= _LONGEST or raw != raw.lower() or b" " in raw[1:]:
                continue
            key = np.frombuffer(raw.ljust(8, b"\0"), np.uint64)[0]
            slot = int(self._slots(np.asarray([key]))[0])
            if not self.keys[slot]:  # of pieces with one slot the more frequent is kept
                self.keys[slot], self.ids[slot] = key, n
                n += 1
        self.end, self.size = n, n + 1

    @staticmethod
    def _slots(keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLY) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def split(self, text: bytes) -> np.ndarray:
        """Ids of words that each follow one space; a word's first piece holds its space."""
        at = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
        return self.split_at(text, at, np.append(at[1:], len(text)))[0]

    def split_at(self, text: bytes, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their places of the words in text[at:ends], all words a piece further at a time."""
        n = len(text)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        data = np.frombuffer(text + bytes(8), np.uint8)
        eight = np.ndarray((n,), np.uint64, data, 0, (1,))
        out = np.zeros(n, np.int32)
        while len(at):
            raw, room = eight[at], ends - at
            size, ids = np.ones(len(at), np.int64), data[at].astype(np.int32)
            for length in range(2, _LONGEST + 1):
                key = raw & _MASKS[length]
                slot = self._slots(key)
                hit = np.flatnonzero((self.keys[slot] == key) & (room >= length))
                size[hit] = length
                ids[hit] = self.ids[slot[hit]]
            out[at] = ids + 1
            at = at + size
            more = at < ends
            at, ends = at[more], ends[more]
        places = np.flatnonzero(out)
        return out[places] - 1, places


def spread(ids: np.ndarray, places: np.ndarray, starts: np.ndarray, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of a run of words, bounds of its texts in them), from the ids and places of each distinct word, which begins
    at starts; words numbers the run's words, bounds cuts it into texts."""
    order = np.argsort(starts)
    heads = np.searchsorted(places, starts[order])
    head, count = np.empty_like(heads), np.empty_like(heads)
    head[order], count[order] = heads, np.diff(np.append(heads, len(places)))
    sizes = count[words]
    ends = np.cumsum(sizes)
    at = np.repeat(head[words] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    return ids[at], np.concatenate([[0], ends])[bounds]


@lru_cache(maxsize=2)
def subwords(model_path: str) -> Subwords:
    return Subwords(model_path)


# The attention model.


def _shapes(vocabulary: int) -> dict[str, tuple]:
    return {"E": (vocabulary, WIDTH), "P": (SPAN, WIDTH), "Q": (WIDTH, WIDTH), "K": (WIDTH, WIDTH), "V": (WIDTH, WIDTH), "O": (WIDTH, WIDTH), "U": (WIDTH, CLASSES), "b": (CLASSES,)}


_PAST = np.tri(SPAN, dtype=np.float32)
_TINY, _ONES, _ROWS = np.float32(1e-30), np.ones(BLOCK * SPAN, np.float32), np.arange(BLOCK * SPAN)


def _joint(w: dict) -> np.ndarray:
    """Weights of queries, keys and values side by side; those of values times O, as mixing them commutes with O."""
    return np.concatenate([w["Q"] * np.float32(WIDTH**-0.5), w["K"], w["V"] @ w["O"]], axis=1)


def _attend(w: dict, joint: np.ndarray, x: np.ndarray, first: int = 0) -> tuple[np.ndarray, ...]:
    """(inputs, queries, keys, values, attention, hidden states) for windows of ids x (windows, SPAN); the last two of
    the positions from first on. Rows are summed by products with ones, which take a sixth of the time of sum()."""
    wide = np.take(w["E"], x, axis=0)
    wide += w["P"]
    flat = wide.reshape(-1, WIDTH)
    mapped = flat @ joint
    q, k, v = (mapped[:, i * WIDTH : (i + 1) * WIDTH].reshape(-1, SPAN, WIDTH) for i in range(3))
    s = q[:, first:] @ k.transpose(0, 2, 1)
    np.exp(np.clip(s, -30, 30, out=s), out=s)
    s *= _PAST[first:]
    s /= (s.reshape(-1, SPAN) @ _ONES[:SPAN]).reshape(len(s), -1, 1)
    hidden = s @ v
    hidden += wide[:, first:]
    return flat, q, k, v, s, hidden.reshape(-1, WIDTH)


def log_classes(w: dict, x: np.ndarray, target: np.ndarray, first: int = 0) -> np.ndarray:
    """log P(target class | ids up to the position) for every position from first on; BLOCK windows at a time, which
    caches hold."""
    out, joint, rates = np.empty((len(x), SPAN - first), np.float32), _joint(w), np.exp(w["b"])
    for a in range(0, len(x), BLOCK):
        part = target[a : a + BLOCK, first:].ravel()
        z = _attend(w, joint, x[a : a + BLOCK], first)[-1] @ w["U"]
        chosen = np.minimum(z.ravel()[_ROWS[: len(z)] * CLASSES + part] + w["b"][part], 80)
        if z.max() > 80 - w["b"].max():
            np.minimum(z, 80 - w["b"], out=z)
        np.exp(z, out=z)
        out[a : a + BLOCK] = (chosen - np.log(z @ rates + _TINY)).reshape(-1, SPAN - first)
    return out


def log_windows(w: dict, classes: np.ndarray, before: np.ndarray, target: np.ndarray, scored: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Sum of log P(target's class) over each text's windows (as of windows_of). A text's later windows begin with
    OVERLAP positions that the one before scores; these are attended to, but no class is computed for them."""
    total = np.zeros(texts)
    for windows, first in ((np.flatnonzero(scored[:, 0]), 0), (np.flatnonzero(~scored[:, 0]), OVERLAP)):
        for a in range(0, len(windows), 1024):
            pick = windows[a : a + 1024]
            logs = log_classes(w, before[pick], classes[target[pick]], first)
            total += np.bincount(text[pick], np.where(scored[pick, first:], logs, 0).sum(axis=1, dtype=np.float64), texts)
    return total


def learn(windows: np.ndarray, targets: np.ndarray, valid: np.ndarray, vocabulary: int) -> dict:
    """Adam on the mean cross-entropy of the classes; deterministic."""
    rng = np.random.default_rng(11)
    w = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in _shapes(vocabulary).items()}
    adam = Adam(w)
    for step in range(1, STEPS + 1 if len(windows) else 1):
        pick = rng.integers(0, len(windows), min(BATCH, len(windows)))
        adam.update(w, gradient(w, windows[pick], targets[pick], valid[pick]), 0.02 * min(1.0, step / 10) * (1 - step / (STEPS + 1)))
    return w


class Adam:
    """Running means of gradients and their squares, which scale the steps; embeddings move where an id occurs."""

    def __init__(self, w: dict):
        self.first, self.second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
        self.step = 0

    def update(self, w: dict, g: dict, rate: float) -> None:
        self.step += 1
        rate = np.float32(rate / (1 - 0.9**self.step))
        level = np.float32(1 / (1 - 0.99**self.step))
        for name, grad in g.items():
            at, grad = grad if name == "E" else (slice(None), grad)
            first = self.first[name][at] * np.float32(0.9) + np.float32(0.1) * grad
            second = self.second[name][at] * np.float32(0.99) + np.float32(0.01) * grad * grad
            self.first[name][at], self.second[name][at] = first, second
            w[name][at] -= rate * first / (np.sqrt(second * level) + np.float32(1e-8))


def gradient(w: dict, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> dict:
    """Gradient of the mean cross-entropy of the classes y at the positions m of windows x; that of E as (ids, rows)."""
    share, weights = np.float32(1 / max(1, m.sum())), _joint(w)
    g = {k: np.zeros_like(w[k]) for k in "PUb"}
    joint, inputs = np.zeros_like(weights), np.empty((x.size, WIDTH), weights.dtype)
    for a in range(0, len(x), BLOCK):
        flat, q, k, v, s, hidden = _attend(w, weights, x[a : a + BLOCK])
        z = hidden @ w["U"]
        z += w["b"]
        if z.max() > 80:
            np.minimum(z, 80, out=z)
        np.exp(z, out=z)
        mask = m[a : a + BLOCK].ravel() * share
        z *= (mask / (z @ _ONES[:CLASSES] + _TINY))[:, None]
        z.ravel()[_ROWS[: len(z)] * CLASSES + y[a : a + BLOCK].ravel()] -= mask
        g["U"] += hidden.T @ z
        g["b"] += _ONES[: len(z)] @ z
        d = np.matmul(z, w["U"].T, out=inputs[a * SPAN : a * SPAN + len(z)])
        dm = d.reshape(-1, SPAN, WIDTH)
        ds = dm @ v.transpose(0, 2, 1)
        ds *= s
        ds -= s * (ds.reshape(-1, SPAN) @ _ONES[:SPAN]).reshape(-1, SPAN, 1)
        parts = np.empty((len(ds), SPAN, 3 * WIDTH), weights.dtype)
        for i, (left, right) in enumerate(((ds, k), (ds.transpose(0, 2, 1), q), (s.transpose(0, 2, 1), dm))):
            np.matmul(left, right, out=parts[:, :, i * WIDTH : (i + 1) * WIDTH])
        parts = parts.reshape(-1, 3 * WIDTH)
        joint += flat.T @ parts
        d += parts @ weights.T
        g["P"] += (_ONES[: len(d) // SPAN] @ d.reshape(-1, SPAN * WIDTH)).reshape(SPAN, WIDTH)
    flat = x.ravel().astype(np.uint16)
    order = np.argsort(flat, kind="stable")
    ids = flat[order]
    heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    rows = np.add.reduceat(np.take(inputs, order, axis=0), heads, axis=0)
    values = joint[:, 2 * WIDTH :]  # of V times O
    return g | {"Q": joint[:, :WIDTH] * np.float32(WIDTH**-0.5), "K": joint[:, WIDTH : 2 * WIDTH], "V": values @ w["O"].T, "O": w["V"].T @ values, "E": (ids[heads], rows)}


def learn_all(texts: DataFrame, w: dict, classes: np.ndarray, end: int) -> tuple[dict, int]:
    """(w, tokens): w carried over every token of all texts (ids), by each partition from the same start, and averaged
    with the tokens as weights. Steps grow with the texts. Each run of the weights is summed whole in one task, so one
    set of weights comes to the driver, however many partitions there are."""
    names, shapes = list(w), {k: v.shape for k, v in w.items()}
    begun = texts.sparkSession.sparkContext.broadcast((w, classes, end))

    def carry(batches):
        start, classes, end = begun.value
        w = {k: v.copy() for k, v in start.items()}
        adam, tokens = Adam(w), 0
        for part in slices(batches, "ids", 1 << 20):
            own = [np.frombuffer(x, np.uint16) for x in part.column(0).to_pylist()]
            before, target, scored, _ = windows_of(np.cumsum([0, *map(len, own)]), end, np.concatenate(own).astype(np.int64), 0)
            order = np.random.default_rng(len(before)).permutation(len(before))
            for a in range(0, len(order), ALL_BATCH):
                pick = order[a : a + ALL_BATCH]
                adam.update(w, gradient(w, before[pick], classes[target[pick]], scored[pick]), ALL_RATE * min(1.0, (adam.step + 1) / 50) * len(pick) / ALL_BATCH)
            tokens += int(scored.sum())
        if tokens:  # how far each weight moved; zeros, as of embeddings of ids that are absent here, take little room
            moved = np.concatenate([((w[k] - start[k]) * np.float32(tokens)).ravel() for k in names])
            yield batch(TaskContext.get().partitionId(), {run: (tokens, x) for run, x in enumerate(np.array_split(moved, RUNS))})

    def batch(part, runs):
        tokens, moved = zip(*runs.values())
        return pa.RecordBatch.from_arrays([pa.array([part] * len(runs), pa.int32()), pa.array(list(runs), pa.int32()), pa.array(tokens, pa.int64()), pa.array([x.tobytes() for x in moved], pa.binary())], ["part", "run", "tokens", "moved"])

    def add(batches):
        runs = {}
        for b in batches:
            for r in b.to_pylist():
                tokens, moved = runs.get(r["run"], (0, 0.0))
                runs[r["run"]] = tokens + r["tokens"], moved + np.frombuffer(r["moved"], np.float32).astype(np.float64)
        if runs:
            yield batch(0, runs)

    schema = "part int, run int, tokens long, moved binary"
    carried = texts.select("ids").mapInArrow(carry, schema)
    found = sorted(carried.repartition(RUNS, "run").sortWithinPartitions("part").mapInArrow(add, schema).collect(), key=lambda r: r.run)
    if not found:
        return w, 0
    tokens = found[0].tokens
    moved = (np.concatenate([np.frombuffer(r.moved, np.float64) for r in found]) / tokens).astype(np.float32)
    cuts = np.cumsum([0, *(int(np.prod(shapes[k])) for k in names)])
    return {k: w[k] + moved[a:b].reshape(shapes[k]) for k, a, b in zip(names, cuts[:-1], cuts[1:])}, tokens


def windows_of(bounds: np.ndarray, end: int, ids: np.ndarray, overlap: int = OVERLAP) -> tuple[np.ndarray, ...]:
    """(inputs, targets, scored, text) of the overlapping windows of texts whose tokens, end id included, are ids."""
    sizes = np.diff(bounds)
    step = SPAN - overlap
    counts = 1 + np.maximum(0, -(-(sizes - SPAN) // step))
    text = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = (number * step).astype(np.int32)[:, None] + np.arange(SPAN, dtype=np.int32)
    inside = place < sizes[text].astype(np.int32)[:, None]
    at = np.minimum(bounds[text].astype(np.int32)[:, None] + place, np.int32(max(0, len(ids) - 1)))
    fresh = inside & ((number == 0)[:, None] | (np.arange(SPAN) >= overlap))
    return previous_of(bounds, end, ids)[at], ids[at], fresh, text


def previous_of(bounds: np.ndarray, end: int, ids: np.ndarray) -> np.ndarray:
    """The id before each; the end id before a text's first."""
    out = np.concatenate([[end], ids[:-1]])
    out[bounds[:-1]] = end
    return out.astype(ids.dtype)


def classes_of(counts: np.ndarray) -> np.ndarray:
    """Class of every id: frequent ids have one each, the rest share classes of about equal mass."""
    order = np.argsort(-counts, kind="stable")
    own = CLASSES * 3 // 4
    out = np.zeros(len(counts), dtype=np.int64)
    out[order[:own]] = np.arange(len(order[:own]))
    rest = order[own:]
    mass = np.cumsum(counts[rest] + ADD)
    out[rest] = own + np.minimum(CLASSES - own - 1, (mass / mass[-1] * (CLASSES - own)).astype(np.int64)) if len(rest) else 0
    return out


def group_of(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.int64) * 40503 % 65536 * BUCKETS // 65536


def within_classes(keys: np.ndarray, counts: np.ndarray, classes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """log P(id | its class, group of the id before), BUCKETS by ids, in half precision; keys are group * ids + id."""
    size = len(seen)
    own = (seen + ADD) / np.bincount(classes, seen + ADD, CLASSES)[classes]
    out = np.zeros((BUCKETS, size), dtype=np.float16)
    cuts = np.searchsorted(keys, np.arange(BUCKETS + 1) * size)
    for b in range(BUCKETS):
        row = np.zeros(size)
        row[keys[cuts[b] : cuts[b + 1]] - b * size] = counts[cuts[b] : cuts[b + 1]]
        out[b] = np.log((row + SMOOTH * own) / (np.bincount(classes, row, CLASSES)[classes] + SMOOTH))
    return out


def followers(keys: np.ndarray, counts: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(keys, counts, counts of classes) of what follows each id; keys are id before * ids + id, in order."""
    size = len(classes)
    mass = np.bincount(keys // size * CLASSES + classes[keys % size], counts, size * CLASSES)
    return keys.astype(np.uint32), counts.astype(np.float32), mass.reshape(size, CLASSES).astype(np.float32)


def log_within(exact: tuple, within: np.ndarray, classes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """log P(id y | its class, the id x before), smoothed by the group of x."""
    keys, counts, mass = exact
    p = np.float32(SMOOTH) * np.exp(within[group_of(x), y].astype(np.float32))
    if len(keys):
        asked = (x * len(classes) + y).astype(np.uint32)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        p += np.where(keys[at] == asked, counts[at], np.float32(0))
    return np.log(p / (mass[x, classes[y]] + np.float32(SMOOTH)))


def score_texts(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", model_path: str | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Tokens are lower-cased (A-Z) words and one end for each text; counts are those of all rows that are not held out.
    A null or empty text is its end alone. Without training rows N, V and all counts are 0 (base_score is then that
    of the smoothing alone). Repeated rows each count and are each scored; extra columns are ignored; an empty table
    gives an empty one.
    """
    spark, path = docs.sparkSession, model_path or default_model()
    n = buckets(spark)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(held_out, F.lit(False)).alias("_held"), F.col(text).alias("text"))
    kind_of_key = dict(rows.dtypes)["_key"]

    def split(batches):
        sub = subwords(path)
        row = TaskContext.get().partitionId() << 32
        for part in slices(batches, "text", 4 << 20):
            held = np.asarray(part.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            raw = R.raw_texts(part, 2)
            sizes = [0, *map(len, raw)]
            text = b" ".join([b"", *raw, b""]).translate(_FOLD)
            tokens, bounds, first, last = R.words_in(text, sizes)
            bounds = bounds[1:]
            hashes, where, flat = np.unique(tokens, return_index=True, return_inverse=True)
            doc = np.repeat(np.arange(len(raw)), np.diff(bounds))
            train = np.bincount(flat[~held[doc]], minlength=len(hashes)).astype(np.uint32)
            pairs, times = np.unique(flat * len(raw) + doc, return_counts=True)
            word, of = pairs // len(raw), (pairs % len(raw)).astype(np.uint32)
            part_of = R.bucket_of(hashes, n)
            flat_ids, cuts = spread(*sub.split_at(text, first[where] - 1, last[where]), first[where] - 1, flat, bounds)
            ids = [flat_ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            follow = np.concatenate([[sub.end], *(np.append(i, sub.end) for i, h in zip(ids, held) if not h)])
            pair, often = np.unique(follow[:-1].astype(np.uint32) * np.uint32(sub.size) + follow[1:].astype(np.uint32), return_counts=True)
            often = often.astype(np.uint32)
            pair_of = pair % n
            out = []
            by_word, by_pair = np.argsort(part_of, kind="stable"), np.argsort(part_of[word], kind="stable")
            word_cuts, pair_cuts = np.searchsorted(part_of[by_word], np.arange(n + 1)), np.searchsorted(part_of[word][by_pair], np.arange(n + 1))
            local = np.zeros(len(hashes), np.int64)
            for b in range(n):
                mine, posts = by_word[word_cuts[b] : word_cuts[b + 1]], by_pair[pair_cuts[b] : pair_cuts[b + 1]]
                local[mine] = np.arange(len(mine))
                out.append((b, R.pack(hashes[mine], train[mine]), R.pack(np.diff(local[word[posts]], prepend=0).astype(np.uint32), of[posts], times[posts].astype(np.uint32)), R.pack(np.diff(pair[pair_of == b], prepend=np.uint32(0)), often[pair_of == b])))
            m = len(out)
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip((*[[x[0] for x in out]], [row] * m, *([x[i] for x in out] for i in (1, 2, 3))), kinds)), pa.nulls(m, part.column(0).type), pa.array(held[:0].tolist() + [None] * m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary())], NAMES)
            m = len(raw)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.array(row + np.arange(m)), *[pa.nulls(m, pa.binary())] * 3, part.column(0), pa.array(held), pa.array(np.diff(bounds) + 1), pa.array([np.append(i, sub.end).astype(np.uint16).tobytes() for i in ids], pa.binary())], NAMES)
            row += m

    NAMES = ["bucket", "row", "words", "posts", "pairs", "_key", "_held", "n_tokens", "ids"]
    taken = materialize(rows.mapInArrow(split, f"bucket int, row long, words binary, posts binary, pairs binary, _key {kind_of_key}, _held boolean, n_tokens long, ids binary"), "split", "zstd")

    def count(batches):
        now, found = None, []
        for batch in [*batches, None]:
            for r in batch.to_pylist() if batch is not None else [{"bucket": None}]:
                if r["bucket"] != now:
                    if found:
                        yield answer(now, found)
                    now, found = r["bucket"], []
                found.append(r)

    def answer(bucket, found):
        asked = [R.unpack(r["words"], np.uint64, np.uint32) for r in found]
        hashes, place = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([a[1] for a in asked]), minlength=len(hashes))
        logs, at, rows, data = np.log10(counts + ADD), 0, [], []
        for r, (h, _) in zip(found, asked):
            mine = place[at : at + len(h)]
            at += len(h)
            steps, doc, times = R.unpack(r["posts"], np.uint32, np.uint32, np.uint32)
            local = np.cumsum(steps, dtype=np.int64)
            docs, which = np.unique(doc, return_inverse=True)
            known = np.bincount(which, times * (counts[mine[local]] > 0), len(docs))
            rows.append(r["row"])
            data.append(R.pack(docs.astype(np.uint32), known.astype(np.uint32), np.bincount(which, times * logs[mine[local]], len(docs))))
        pair, often = (np.concatenate(x) for x in zip(*((np.cumsum(p, dtype=np.int64), o) for p, o in (R.unpack(r["pairs"], np.uint32, np.uint32) for r in found))))
        pair, which = np.unique(pair, return_inverse=True)
        often = np.bincount(which, often, len(pair))
        total = R.pack(*(np.concatenate(x).astype(np.int64) for x in (([counts.sum()], pair), ([(counts > 0).sum()], often))))
        return pa.RecordBatch.from_arrays([pa.array([*rows, -1], pa.int64()), pa.array([*data, total], pa.binary())], ["row", "data"])

    asked = taken.where("bucket is not null").select("bucket", "row", "words", "posts", "pairs")
    answers = materialize(asked.repartition(n, "bucket").sortWithinPartitions("bucket", "row").mapInArrow(count, "row long, data binary"), "counts")

    sub = subwords(path)
    found, tokens, distinct = [], 0, 0
    for r in answers.where("row = -1").collect():  # one row for each bucket; together a count for each pair of ids that occurs
        pair, often = R.unpack(r.data, np.int64, np.int64)
        tokens, distinct = tokens + int(pair[0]), distinct + int(often[0])
        found.append((pair[1:], often[1:]))
    pair, often = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else ((), ())))
    order = np.argsort(pair)
    pair, often = pair[order], often[order]
    seen = np.bincount(pair % sub.size, often, sub.size)
    ends = int(seen[sub.end])
    tokens, distinct = tokens + ends, distinct + (ends > 0)

    def gather(batches):
        now, sums = None, None
        for batch in [*batches, None]:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if batch is not None else [(None, None)]:
                if row != now:
                    if sums is not None:
                        docs = np.concatenate([s[0] for s in sums])
                        unique, which = np.unique(docs, return_inverse=True)
                        yield pa.RecordBatch.from_arrays([pa.array(now + unique.astype(np.int64)), *(pa.array(np.bincount(which, np.concatenate([s[i] for s in sums]), len(unique)).astype(np.float64)) for i in (1, 2))], ["row", "known", "logs"])
                    now, sums = row, []
                if data is not None:
                    sums.append(R.unpack(data, np.uint32, np.uint32, np.float64))

    replies = answers.where("row >= 0").repartition(n, "row").sortWithinPartitions("row").mapInArrow(gather, "row long, known double, logs double")

    texts = taken.where("bucket is null").select("row", "_key", "_held", "n_tokens", "ids")
    some = share_by_hash(F.xxhash64("row"), F.lit(max(1, ends)), TRAIN_TEXTS)
    chosen = texts.where(~F.col("_held") & some).select("row").orderBy(F.xxhash64("row"), "row").limit(TRAIN_TEXTS)
    sample = texts.join(F.broadcast(chosen), "row").orderBy("row").select("ids").collect()  # TRAIN_TEXTS rows
    classes = classes_of(seen)
    grouped, which = np.unique(group_of(pair // sub.size) * sub.size + pair % sub.size, return_inverse=True)
    within = within_classes(grouped, np.bincount(which, often, len(grouped)), classes, seen)
    exact = followers(pair, often, classes)
    del found, pair, often, grouped, which
    own = [np.frombuffer(r.ids, np.uint16).astype(np.int64) for r in sample]
    before, target, scored, _ = windows_of(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64), sub.end, np.concatenate([np.zeros(0, np.int64), *own])) if own else (np.zeros((0, SPAN), np.int64),) * 2 + (np.zeros((0, SPAN), bool), None)
    pick = np.random.default_rng(5).permutation(len(before))[:TRAIN_WINDOWS]
    weights = learn(before[pick], classes[target[pick]], scored[pick], sub.size)
    weights, _ = learn_all(texts.where(~F.col("_held")), weights, classes, sub.end)
    sent = spark.sparkContext.broadcast((weights, classes, within, exact, sub.end))  # grows with pairs of ids that occur

    def score(batches):
        weights, classes, within, exact, end = sent.value
        for part in slices(batches, "ids", 1 << 20):
            own = [np.frombuffer(x, np.uint16) for x in part.column(4).to_pylist()]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
            ids = np.concatenate(own).astype(np.int64)
            before, target, scored, text = windows_of(bounds, end, ids)
            total = log_windows(weights, classes, before, target, scored, text, len(own))
            pair, which = np.unique((previous_of(bounds, end, ids) * len(classes) + ids).astype(np.uint32), return_inverse=True)
            pair = pair.astype(np.int64)
            logs = log_within(exact, within, classes, pair // len(classes), pair % len(classes))[which]
            total += np.add.reduceat(logs, bounds[:-1], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(total / np.log(10))], ["row", "_key", "_held", "n_tokens", "score"])

    scores = texts.mapInArrow(score, f"row long, _key {kind_of_key}, _held boolean, n_tokens long, score double")
    below = float(np.log10(tokens + ADD * (distinct + 1)))
    joined = scores.join(replies, "row", "left")
    base = F.coalesce("logs", F.lit(0.0)) + F.lit(float(np.log10(ends + ADD))) - F.col("n_tokens") * F.lit(below)
    known = F.coalesce("known", F.lit(0.0)).cast("long") + F.lit(int(ends > 0))
    return joined.select(F.col("_key").alias(key), F.col("_held").alias("held_out"), "n_tokens", known.alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
