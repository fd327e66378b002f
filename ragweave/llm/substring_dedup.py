"""Removal of word windows that already begin in an earlier document, by level-wise doubling.

Lengths double from a few words up to the window. At each length one run of every window that is still a candidate is
compared: the one of smallest hash, its anchor, which a repeated window has at the same offset in all its places. Only
windows whose anchor occurs in two documents are candidates at twice the length; the levels end early when none is
left. Of the windows that reach the full length those that occur in two documents are repeats. Two windows are equal
when both their anchor's and their own hash are, 128 bits together. Texts are never compared pairwise, and no group of
equal windows is gathered: every mapper sends one row of each group of equal windows it has read, the one of the
smallest document id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragweave.llm import repeats as R
from ragweave.llm.common import buckets, materialize, rows_and_bytes, slices

WINDOW = 50
#: Words of the first level at least.
SHORTEST = 12
_SLICE = 2 << 20


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_removed, kept) of every row; kept is the words left, joined by one space.

    A word goes when a window of `window` words that covers it also begins in a document of smaller id; windows are
    judged on the input. Null and empty texts have no words; texts shorter than a window keep all. Keys are taken to
    be unique whole numbers: rows that repeat a key count as the same document. Extra columns are ignored; an empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    n = buckets(spark, rows_and_bytes(docs, text)[1])
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))

    def anchors_of(gram: int, earlier: int | None):
        """(document ids, hashes) of the anchors of windows whose anchor of the level before also occurs elsewhere."""

        def run(batches):
            for part in slices(batches, "text", _SLICE):
                ids = np.asarray(part.column(0), dtype=np.int64)
                tokens, bounds = R.word_tokens(R.raw_texts(part, 1))
                _, first, last, doc, hashes = R.anchor_spans(tokens, bounds, gram, window)
                if earlier:
                    before = np.concatenate([[0], np.cumsum(still(tokens, bounds, earlier, part.column(2).to_pylist()))])
                    some = before[last + 1] > before[first]
                    doc, hashes = doc[some], hashes[some]
                yield ids[doc], hashes

        return run

    def still(tokens, bounds, gram, hits):
        """Mask of the window starts that are candidates after the level `gram`."""
        _, first, last, doc, hashes = R.anchor_spans(tokens, bounds, gram, window)
        keep = R.surviving(doc, hashes, hits)
        mask = np.zeros(len(tokens), bool)
        mask[R.expand(first[keep], last[keep])[0]] = True
        return mask

    levels = [window]
    while levels[0] >= 2 * SHORTEST:
        levels.insert(0, -(-levels[0] // 2))
    whole = rows.where(F.col("doc").isNotNull() & (F.length("text") >= 2 * window - 1))
    survivors, gram = whole, None
    for longer in levels[:-1]:
        mapper, reducer = R.candidates(anchors_of(longer, gram), n, within=False)
        found = materialize(R.exchange(survivors.mapInArrow(mapper, R.PACKED), n, reducer, np.uint64), "level")
        survivors, gram = whole.join(found, "doc").select("doc", "text", "hits"), longer
        if found.isEmpty():
            break

    def settle(hashes, anchors, docs, places):
        """Equal windows: all but those of the smallest document are marked here, those are to be sent."""
        order = np.lexsort((docs, hashes, anchors))
        hashes, anchors, docs, places = hashes[order], anchors[order], docs[order], places[order]
        group = np.cumsum(np.concatenate([[False], (hashes[1:] != hashes[:-1]) | (anchors[1:] != anchors[:-1])])[: len(hashes)])
        least = docs[np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))][group]
        return docs > least, hashes, anchors, docs, places

    def send(found):
        late, hashes, anchors, docs, places = settle(*(np.concatenate(c) for c in zip(*found)))
        out = R.cut(R.bucket_of(anchors[~late], n), 0, hashes[~late], anchors[~late], docs[~late], places[~late])
        if late.any():
            out += [(b, 1, data) for b, _, data in R.to_documents(docs[late], places[late], n)]
        return R.packed_rows(out)

    def extend(batches):
        found, size = [], 0
        for part in slices(batches, "text", _SLICE):
            ids = np.asarray(part.column(0), dtype=np.int64)
            tokens, bounds = R.word_tokens(R.raw_texts(part, 1))
            if gram is None:
                doc = np.repeat(np.arange(len(ids)), np.diff(bounds))
                first = last = np.flatnonzero(np.arange(len(tokens)) + window <= bounds[doc + 1])
                doc, anchor, keep = doc[first], R.gram_hashes(tokens, window)[first], slice(None)
            else:
                _, first, last, doc, anchor = R.anchor_spans(tokens, bounds, gram, window)
                keep = R.surviving(doc, anchor, part.column(2).to_pylist())
            at, which = R.expand(first[keep], last[keep])
            doc, anchor = doc[keep][which], anchor[keep][which]
            found.append((R.gram_hashes(tokens, window)[at], anchor, ids[doc], (at - bounds[doc]).astype(np.uint32)))
            size += len(at)
            if size >= R.FLUSH:
                yield from send(found)
                found, size = [], 0
        if size:
            yield from send(found)

    def compare(batches):
        for bucket, found in R.by_bucket(batches):
            out = R.passed_on(bucket, found)
            if found:
                late, _, _, docs, places = settle(*(np.concatenate(c) for c in zip(*(R.unpack(x, np.uint64, np.uint64, np.int64, np.uint32) for x in found[0]))))
                out += R.to_documents(docs[late], places[late], n)
            yield from R.packed_rows(out)

    marks = materialize(R.exchange(survivors.mapInArrow(extend, R.PACKED), n, compare, np.uint32), "marks")

    def finish(batches):
        for part in slices(batches, "text", _SLICE):
            counts, removed, kept = [], [], []
            for x, hits in zip(R.raw_texts(part, 1), part.column(2).to_pylist()):
                words = x.split()
                counts.append(len(words))
                if hits:
                    tokens, _ = R.word_tokens([x])
                    windows = R.gram_hashes(tokens, window)[: max(0, len(words) - window + 1)]
                    marked = np.frombuffer(hits, np.uint32)
                    starts = np.flatnonzero(np.isin(windows, windows[marked]))
                    gone = R.covered(len(words), starts, window)
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    removed.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc", "n_words", "n_removed", "kept"])

    joined = rows.join(marks, "doc", "left").select("doc", "text", "hits")
    return joined.mapInArrow(finish, "doc long, n_words long, n_removed long, kept string").withColumnRenamed("doc", key)
