"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces (forward algorithm); a text's is the product over its words. The piece
probabilities are fitted by expectation maximisation over the word counts of a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.llm.common import map_slices, share_by_hash, texts_of
from ragweave.llm.sentencepiece_codec import MARK, default_model

#: Labelled rows of each language that are fitted (the ones of smallest hash), rounds of fitting.
SAMPLE_ROWS = 400
ROUNDS = 3
#: Of texts without a letter.
UNDETERMINED = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: Longest run of letters scored as one word; longer runs are cut there and every part is scored.
LONGEST = 48
CACHE_WORDS = 150_000
#: Text bytes and new words worked on at once.
_SLICE = 1 << 20
_AT_ONCE = 5_000


@lru_cache(maxsize=2)
def vocabulary(model_path: str):
    """(pieces, automaton): the vocabulary's lower-case letter pieces, with and without the word mark."""
    import ahocorasick
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = set()
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)):
            p = model.id_to_piece(i).lower()
            if p.removeprefix(MARK).isalpha() or p == MARK:
                pieces.add(p)
    pieces = sorted(pieces)
    automaton = ahocorasick.Automaton()
    for i, p in enumerate(pieces):
        automaton.add_word(p, (i, len(p)))
    automaton.make_automaton()
    return pieces, automaton


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters, cut at LONGEST letters."""
    found = _WORD.findall(text.lower())
    if not all(map(str.isalpha, found)):  # numbers such as ½ and ² count as word characters, but are no letters
        found = [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]
    if max(map(len, found), default=0) <= LONGEST:
        return found
    return [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]


class Model:
    """languages, their log priors, and a row of piece probabilities for each piece (a column for each language)."""

    def __init__(self, languages: list[str], priors: np.ndarray, probabilities: np.ndarray, rare: float, model_path: str):
        self.languages, self.priors, self.rare, self.model_path = languages, priors, rare, model_path
        self.table = probabilities

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("languages", "priors", "rare", "model_path", "table")}

    def ready(self) -> "Model":
        if not hasattr(self, "index"):
            self.automaton = vocabulary(self.model_path)[1]
            self._forget()
        return self

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.languages)))

    def marginals(self, words: list[str]) -> np.ndarray:
        """log P(word | language), a row for each word: forward sums over all segmentations of all words at once.

        The words stand in one string; the automaton lists every piece in it, and the sums advance by one character
        of all words at a time.
        """
        if not words:
            return np.zeros((0, len(self.languages)))
        text = "\n".join(MARK + w for w in words)
        sizes = np.asarray([len(w) + 1 for w in words])
        heads = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])  # one entry more than characters for each word
        found = list(self.automaton.iter(text))
        ends = np.fromiter((f[0] for f in found), np.int64, len(found)) + 1
        pieces = np.fromiter((f[1][0] for f in found), np.int64, len(found))
        starts = ends - np.fromiter((f[1][1] for f in found), np.int64, len(found))
        level = ends - heads[np.searchsorted(heads, ends - 1, "right") - 1]
        order = np.lexsort((ends, level))
        starts, ends, pieces, level = starts[order], ends[order], pieces[order], level[order]
        cuts = np.searchsorted(level, np.arange(sizes.max() + 2))
        alpha = np.zeros((len(text) + 1, len(self.languages)))
        alpha[heads] = 1.0
        longest_first = heads[np.argsort(-sizes, kind="stable")]
        counts = len(words) - np.searchsorted(np.sort(sizes), np.arange(sizes.max() + 2))
        for step in range(1, sizes.max() + 1):
            at = longest_first[: counts[step]] + step
            alpha[at] = alpha[at - 1] * self.rare  # any character may stand alone, at the floor probability
            lo, hi = cuts[step], cuts[step + 1]
            if hi > lo:
                first = np.flatnonzero(np.diff(ends[lo:hi], prepend=-1))
                alpha[ends[lo:hi][first]] += np.add.reduceat(alpha[starts[lo:hi]] * self.table[pieces[lo:hi]], first, axis=0)
        return np.log(alpha[heads + sizes])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if len(self.index) > CACHE_WORDS:
            self._forget()
        index, split = self.index, [words_of(x) for x in texts]
        fresh = list(dict.fromkeys(w for words in split for w in words if w not in index))
        parts = [self.logs]
        for a in range(0, len(fresh), _AT_ONCE):
            part = fresh[a : a + _AT_ONCE]
            index.update(zip(part, range(len(index), len(index) + len(part))))
            parts.append(self.marginals(part))
        self.logs = np.concatenate(parts)
        out = []
        for words in split:
            if not words:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.priors + self.logs[np.fromiter(map(index.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(np.argmax(total))
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None, model_path: str | None = None) -> Model:
    """Fit on SAMPLE_ROWS rows of each language, on all their words; the counts of those reach the driver."""
    from pyspark.sql import window as W

    path = model_path or default_model()
    pieces, automaton = vocabulary(path)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), (F.xxhash64(text) if order is None else order).alias("o"))
    by = W.Window.partitionBy("lang").orderBy("o")
    sizes = labelled.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("rows"))  # a row for each language
    some = rows.join(F.broadcast(sizes), "lang").where(share_by_hash(F.col("o"), F.col("rows"), SAMPLE_ROWS))
    sample = some.withColumn("n", F.row_number().over(by)).where(F.col("n") <= SAMPLE_ROWS).select("lang", "text")

    def count(batches):
        from collections import Counter

        for batch in batches:
            counts: dict[str, Counter] = {}
            for name, x in zip(batch.column(0).to_pylist(), texts_of(batch)):
                counts.setdefault(name, Counter()).update(words_of(x))
            out = [(name, w, c) for name, found in counts.items() for w, c in found.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["lang", "word", "n"])

    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found: dict[str, list[tuple[str, int]]] = {}
    for r in counted.collect():  # words of SAMPLE_ROWS rows of each language
        found.setdefault(r.lang, []).append((r.word, r.n))
    languages = sorted(found)
    rare = 1e-6
    table = np.full((len(pieces), max(1, len(languages))), rare)
    for j, name in enumerate(languages):
        lattice = []
        for w, n in sorted(found[name]):
            spans = [(e + 1 - l, e + 1, i) for e, (i, l) in automaton.iter(MARK + w)]
            lattice.append((len(w) + 1, n, spans))
        p = np.full(len(pieces), 1.0 / len(pieces))
        for _ in range(ROUNDS):
            gained, values = np.zeros(len(pieces)), p.tolist()
            for size, n, spans in lattice:
                ahead = [1.0] + [0.0] * size
                for end in range(1, size + 1):
                    ahead[end] = ahead[end - 1] * rare
                for start, end, i in spans:  # ordered by end: what leads to start is complete, but for single rare steps
                    ahead[end] += ahead[start] * values[i]
                behind = [0.0] * size + [1.0]
                for start, end, i in reversed(spans):
                    behind[start] += behind[end] * values[i]
                if ahead[size] > 0 and behind[0] > 0:
                    for start, end, i in spans:
                        gained[i] += n * ahead[start] * values[i] * behind[end] / ahead[size]
            p = gained / max(gained.sum(), 1e-300)
        table[:, j] = np.maximum(p, rare)
    return Model(languages, np.zeros(max(1, len(languages))), table, rare, path)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, lang_pred and score of every row; score is the posterior of the prediction, from 0 to 1.

    Null texts and texts without a letter are `und` with score 0, as is every text if nothing was learned. Repeated
    rows stay; columns not in keep are ignored; an empty table gives an empty one. keep may name the text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), *([] if text in keep else [F.col(text).alias("_text")]))
    at = f"_k{keep.index(text)}" if text in keep else "_text"  # a text that is kept is sent once
    kept = rows.dtypes[: len(keep)]
    kinds = ", ".join(f"{c} {t}" for c, t in kept)
    names = [*(c for c, _ in kept), "lang_pred", "score"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value.ready()
        texts = texts_of(batch, at)
        found = m.predict(texts) if m.languages else [(UNDETERMINED, 0.0)] * len(texts)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names)

    out = map_slices(rows, run, f"{kinds}, lang_pred string, score double", at, _SLICE)
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score")
