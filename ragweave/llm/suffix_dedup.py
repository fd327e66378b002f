"""Removal of byte strings that already begin earlier in the corpus, by a range-partitioned suffix array.

1. Candidates: every 100-byte window has an anchor, the 32-byte gram of smallest hash in it. A repeated window has
   the same anchor at the same offset in all its places, so windows whose anchor occurs once are settled unsorted.
2. Suffixes that begin at repeated anchors, with the windows around them, are range-partitioned by their leading
   bytes; the splitters are quantiles of a sample. Equal windows have equal anchors, so their suffixes share 32
   leading bytes and always meet in one range: at a boundary the two neighbours differ in their leading bytes.
3. Every range sorts its windows by multikey quicksort, eight bytes a key, keeping only parts of two or more strings,
   and marks all windows of a part of equal ones but the earliest.

Before sending, a mapper settles repetitions among what it has read, so a passage of very many documents stays small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragweave.llm import repeats as R
from ragweave.llm.common import buckets, materialize, rows_and_bytes, slices

WINDOW = 100
GRAM = 32
#: Documents read to choose the splitters; they change the balance of the ranges, never the result.
SPLITTER_DOCUMENTS = 4000
#: Strings of a part up to which it is sorted by whole keys.
SMALL = 4096
_SLICE = 1 << 20
_FLUSH = 150_000


def _leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each offset as a big-endian number; data has eight bytes to spare."""
    if len(data) < 8:
        return np.zeros(len(at), np.uint64)
    return np.ndarray((len(data) - 7,), ">u8", np.ascontiguousarray(data), 0, (1,))[at].astype(np.uint64)


def _split_three_ways(key: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, firsts, counts): every part split around its pivot, the median of its first, middle and last keys, into
    smaller, equal and greater keys; firsts and counts have a row for each part."""
    part = np.repeat(np.arange(len(sizes)), sizes)
    a, b, c = key[heads], key[heads + sizes // 2], key[heads + sizes - 1]
    pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]
    side = (key > pivot).astype(np.int8) + (key >= pivot)
    mine = [np.flatnonzero(side == k) for k in range(3)]
    counts = np.stack([np.bincount(part[m], minlength=len(sizes)) for m in mine], axis=1)
    firsts = heads[:, None] + np.cumsum(counts, axis=1) - counts
    order = np.empty(len(key), np.int64)
    for k, m in enumerate(mine):
        order[R.expand(firsts[:, k], firsts[:, k] + counts[:, k] - 1)[0]] = m
    return order, firsts, counts


def multikey_quicksort(data: np.ndarray, at: np.ndarray, length: int, small: int = SMALL) -> tuple[np.ndarray, np.ndarray]:
    """(members, part) of all parts of two or more equal strings data[i:i + length], i in at; parts are in order.

    A key is eight bytes. Parts of more than `small` strings are split three ways around a pivot, all at once; the
    equal ones go on with the next key. Smaller parts are sorted by a key at a time. A part of one string is done,
    and one whose strings agree to the end is found.
    """
    done, rest = [], []
    members, heads, sizes, depth, place = np.arange(len(at)), *(np.asarray([x], np.int64) for x in (0, len(at), 0, 0))

    def sorted_out(going, sizes, depth, place, heads):
        """Put parts that are found or small aside; the others go on."""
        for kind, out in ((going & (depth >= length), done), (going & (depth < length) & (sizes <= small), rest)):
            out.append((members[R.expand(heads[kind], heads[kind] + sizes[kind] - 1)[0]], sizes[kind], depth[kind], place[kind]))
        more = going & (depth < length) & (sizes > small)
        left = members[R.expand(heads[more], heads[more] + sizes[more] - 1)[0]]
        return left, np.cumsum(sizes[more]) - sizes[more], sizes[more], depth[more], place[more]

    members, heads, sizes, depth, place = sorted_out(sizes > 1, sizes, depth, place, heads)
    while len(sizes):
        key = _leading(data, at[members] + np.repeat(np.minimum(depth, length - 8), sizes))
        order, firsts, counts = _split_three_ways(key, heads, sizes)
        members = members[order]
        starts = place[:, None] + firsts - heads[:, None]
        depths = depth[:, None] + np.asarray([0, 8, 0])
        members, heads, sizes, depth, place = sorted_out(counts.ravel() > 1, counts.ravel(), depths.ravel(), starts.ravel(), firsts.ravel())

    members, sizes, depth, place = (np.concatenate(x) for x in zip(*rest))
    while len(sizes):
        part = np.repeat(np.arange(len(sizes)), sizes)
        key = _leading(data, at[members] + np.minimum(depth, length - 8)[part])
        mixed = np.zeros(len(sizes), bool)
        mixed[part[1:][(key[1:] != key[:-1]) & (part[1:] == part[:-1])]] = True
        todo = np.flatnonzero(mixed[part])
        order = todo[np.lexsort((key[todo], part[todo]))]
        members[todo], key[todo] = members[order], key[order]
        heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        counts = np.diff(np.append(heads, len(key)))
        starts = place[part[heads]] + heads - (np.cumsum(sizes) - sizes)[part[heads]]
        depths = depth[part[heads]] + 8
        for kind in (depths >= length, depths < length):
            kind = kind & (counts > 1)
            left = members[R.expand(heads[kind], heads[kind] + counts[kind] - 1)[0]], counts[kind], depths[kind], starts[kind]
            if (depths[kind] >= length).all() and len(depths[kind]):
                done.append(left)
                left = tuple(x[:0] for x in left)
        members, sizes, depth, place = left
    found, sizes, _, place = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(np.repeat(place, sizes), kind="stable")
    return found[order], R.heads_of(np.repeat(place, sizes)[order])


def _ranges(docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window starts as (document, start << 32 | count) of runs of neighbouring starts."""
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order].astype(np.int64)
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + 1)])[: len(docs)]
    heads = np.flatnonzero(new)
    ends = np.concatenate([heads[1:], [len(docs)]])[: len(heads)] - 1
    return docs[heads], (starts[heads].astype(np.uint64) << np.uint64(32)) | (starts[ends] - starts[heads] + 1).astype(np.uint64)


class _Suffixes:
    """Anchored pieces of text: document, first window, number of windows, bytes."""

    def __init__(self, docs, firsts, counts, texts: list[bytes]):
        self.docs, self.firsts, self.counts, self.texts = docs, firsts, counts, texts

    def settle(self) -> tuple["_Suffixes", np.ndarray, np.ndarray, np.ndarray]:
        """The earliest of each set of equal pieces, and which are the others; the chosen ones' positions too."""
        seen: dict[bytes, int] = {}
        group = np.fromiter((seen.setdefault(t, len(seen)) for t in self.texts), np.int64, len(self.texts))
        order = np.lexsort((self.firsts, self.docs, group))
        first = np.concatenate([[True], group[order][1:] != group[order][:-1]])[: len(order)]
        mine, others = order[first], order[~first]
        return _Suffixes(self.docs[mine], self.firsts[mine], self.counts[mine], [self.texts[i] for i in mine.tolist()]), mine, self.docs[others], others

    def pack(self, which: np.ndarray) -> bytes:
        head = np.asarray([len(which)], np.uint32).tobytes()
        body = b"".join([self.docs[which].tobytes(), self.firsts[which].astype(np.uint32).tobytes(), self.counts[which].astype(np.uint32).tobytes(), *(self.texts[i] for i in which.tolist())])
        return R._squeeze.compress(head + body)

    @staticmethod
    def unpack(parts: list[bytes], window: int) -> "_Suffixes":
        docs, firsts, counts, texts = [], [], [], []
        for p in parts:
            raw = R._open.decompress(p)
            n = int(np.frombuffer(raw, np.uint32, 1)[0])
            docs.append(np.frombuffer(raw, np.int64, n, 4))
            firsts.append(np.frombuffer(raw, np.uint32, n, 4 + 8 * n))
            counts.append(c := np.frombuffer(raw, np.uint32, n, 4 + 12 * n).astype(np.int64))
            ends = 4 + 16 * n + np.cumsum(c + window - 1)
            texts += [raw[a:b] for a, b in zip([4 + 16 * n, *ends[:-1].tolist()], ends.tolist())]
        return _Suffixes(np.concatenate(docs), np.concatenate(firsts), np.concatenate(counts), texts)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept binary) of every row; kept is what is left of the text's UTF-8 bytes.

    A byte goes when a string of `window` bytes that covers it also begins earlier: in a document of smaller id, or
    further left in its own. Strings are judged on the input and never cross documents. Null and empty texts have no
    bytes; texts shorter than a window stay whole. Keys are taken to be unique whole numbers; rows without one are
    left whole. Extra columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    count, size = rows_and_bytes(docs, text)
    n = buckets(spark, size)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    whole = rows.where(F.col("doc").isNotNull() & (F.octet_length("text") >= window))

    def pieces(part):
        texts = R.raw_texts(part, 1)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        return np.frombuffer(b"".join(texts), np.uint8), bounds

    def read(batches):
        for part in slices(batches, "text", _SLICE):
            data, bounds = pieces(part)
            yield np.asarray(part.column(0), dtype=np.int64), data.astype(np.uint64), bounds

    def leading_of_anchors(batches):
        for part in slices(batches, "text", _SLICE):
            data, bounds = pieces(part)
            at = R.anchor_spans(data.astype(np.uint64), bounds, gram, window)[0]
            yield pa.RecordBatch.from_arrays([pa.array((_leading(data, at) >> np.uint64(1)).astype(np.int64))], ["lead"])

    share = min(1.0, SPLITTER_DOCUMENTS / max(1, count))
    sampled = whole.sample(share, seed=7).mapInArrow(leading_of_anchors, "lead long")
    quantiles = [i / n for i in range(1, n)]
    found = sampled.agg(F.percentile_approx("lead", quantiles, max(10_000, 2 * n)).alias("q")).first().q if quantiles else []
    splitters = np.unique(np.asarray(found or [], dtype=np.int64))

    def anchors(batches):
        for ids, data, bounds in read(batches):
            _, _, _, doc, hashes = R.anchor_spans(data, bounds, gram, window)
            yield ids[doc], hashes

    mapper, reducer = R.candidates(anchors, n, within=True)

    survivors = whole.join(R.exchange(whole.mapInArrow(mapper, R.PACKED), n, reducer, np.uint64), "doc").select("doc", "text", "hits")

    def marked(docs, firsts, counts):
        return docs, (firsts.astype(np.uint64) << np.uint64(32)) | counts.astype(np.uint64)

    def send(found):
        docs, firsts, counts, leads = (np.concatenate(c) for c in list(zip(*found))[:4])
        mine, chosen, _, others = _Suffixes(docs, firsts, counts, [t for f in found for t in f[4]]).settle()
        bucket = np.searchsorted(splitters, (leads[chosen] >> np.uint64(1)).astype(np.int64), "right")
        order = np.argsort(bucket, kind="stable")
        heads = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        out = [(int(bucket[order[a]]), 0, mine.pack(order[a:b])) for a, b in zip(heads, [*heads[1:], len(order)])]
        if len(others):
            late = docs[others]
            out += [(b, 1, data) for b, _, data in R.to_documents(*marked(late, firsts[others], counts[others]), n)]
        return R.packed_rows(out)

    def suffixes(batches):
        found, size = [], 0
        for part in slices(batches, "text", _SLICE):
            ids = np.asarray(part.column(0), dtype=np.int64)
            data, bounds = pieces(part)
            anchor, first, last, doc, hashed = R.anchor_spans(data.astype(np.uint64), bounds, gram, window)
            keep = R.surviving(doc, hashed, part.column(2).to_pylist())
            anchor, first, last, doc = anchor[keep], first[keep], last[keep], doc[keep]
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(first.tolist(), (last + window).tolist())]
            found.append((ids[doc], first - bounds[doc], last - first + 1, _leading(data, anchor), texts))
            size += len(anchor)
            if size >= _FLUSH:
                yield from send(found)
                found, size = [], 0
        if size:
            yield from send(found)

    def compare(batches):
        for bucket, found in R.by_bucket(batches):
            out = R.passed_on(bucket, found)
            if found:
                every = _Suffixes.unpack(found.pop(0), window)
                mine, _, _, others = every.settle()
                out += R.to_documents(*marked(every.docs[others], every.firsts[others], every.counts[others]), n)
                sizes = np.asarray([len(t) for t in mine.texts], dtype=np.int64)
                data = np.frombuffer(b"".join(mine.texts) + bytes(8), np.uint8)
                heads = np.cumsum(sizes) - sizes
                at, which = R.expand(heads, heads + mine.counts - 1)
                docs, starts = mine.docs[which], mine.firsts[which].astype(np.int64) + at - heads[which]
                del every, mine
                members, part = multikey_quicksort(data, at, window)
                docs, starts = docs[members], starts[members]
                order = np.lexsort((starts, docs, part))
                late = order[~np.concatenate([[True], part[1:] != part[:-1]])[: len(part)]]
                if len(late):
                    out += R.to_documents(*_ranges(docs[late], starts[late]), n)
            yield from R.packed_rows(out)

    marks = materialize(R.exchange(survivors.mapInArrow(suffixes, R.PACKED), n, compare, np.uint64), "marks")

    def finish(batches):
        for part in slices(batches, "text", _SLICE):
            sizes, removed, spans, kept = [], [], [], []
            for x, hits in zip(R.raw_texts(part, 1), part.column(2).to_pylist()):
                sizes.append(len(x))
                if not hits:
                    removed.append(0)
                    spans.append(0)
                    kept.append(x)
                    continue
                ranges = np.frombuffer(hits, np.uint64)
                starts, counts = (ranges >> np.uint64(32)).astype(np.int64), (ranges & np.uint64(0xFFFFFFFF)).astype(np.int64)
                edge = np.zeros(len(x) + 1, dtype=np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + counts - 1 + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(R.runs(gone))
                kept.append(np.frombuffer(x, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, spans)), pa.array(kept, pa.binary())], ["doc", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(marks, "doc", "left").select("doc", "text", "hits")
    return joined.mapInArrow(finish, "doc long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("doc", key)
