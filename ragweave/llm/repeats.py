"""Numpy building blocks for finding repeated windows: rolling hashes, anchors, packed exchanges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Entries a mapper gathers before it combines and sends them.
FLUSH = 600_000


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ordered pairs."""
    x = a * _A
    x ^= x >> np.uint64(29)
    x += b
    x *= _B
    x ^= x >> np.uint64(32)
    return x


_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MASKS = np.asarray([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
#: Longer words are hashed one by one.
_LONG = 256


def word_tokens(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in a row, and where each text's begin and end."""
    return words_in(b" ".join([*texts, b""]), [len(t) for t in texts], lower)[:2]


def words_in(raw: bytes, sizes: list[int], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bounds, first byte of each word, byte after each word) of texts of these sizes that each end in one space.

    Words are runs of bytes other than the six ASCII white spaces; lower hashes A-Z as a-z.
    """
    if lower:
        raw = raw.translate(_LOWER)
    blank = _BLANK[np.frombuffer(raw, np.uint8)]
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(raw) else np.zeros(0, np.int64)
    edges = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64) + 1)]).astype(np.int64)
    bounds = np.searchsorted(first, edges)
    last = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return hash_runs(raw, first, last), bounds, first, last


def hash_runs(raw: bytes, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of each run raw[first:last]: its length, then eight bytes after eight, each mixed in (no sum of its parts)."""
    out = mix((last - first).astype(np.uint64), np.uint64(11))
    if not len(first):
        return out
    eight = np.ndarray((len(raw) + 1,), np.uint64, raw + bytes(8), 0, (1,))
    short = last - first <= _LONG
    which, at, ends = np.flatnonzero(short), first[short], last[short]
    while len(which):
        room = ends - at
        out[which] = mix(out[which], eight[at] & _MASKS[np.minimum(room, 8)])
        more = room > 8
        which, at, ends = which[more], at[more] + 8, ends[more]
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[first[i] : last[i]], 11)
    return out


def gram_hashes(tokens: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n tokens, by doubling; as long as tokens, with zeros where no run begins."""
    out, have, level, size = None, 0, tokens, 1
    while True:
        if n & size:
            if out is None:
                out, have = level, size
            else:
                m = max(0, len(tokens) - have - size + 1)
                out, have = mix(out[:m], level[have : have + m]), have + size
        if have == n:
            break
        m = max(0, len(tokens) - 2 * size + 1)
        level = mix(level[:m], level[size : size + m])
        size *= 2
    full = np.zeros(len(tokens), dtype=np.uint64)
    m = max(0, len(tokens) - n + 1)
    full[:m] = mix(out[:m], np.uint64(n))
    return full


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost minimum of every run of `width` values."""
    index, size = np.arange(len(values), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        if len(values) <= step:
            return index[:0]
        later = values[step:] < values[:-step]
        values = np.where(later, values[step:], values[:-step])
        index = np.where(later, index[step:], index[:-step])
        size += step
    return index


def anchor_spans(tokens: np.ndarray, bounds: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, document, hash) of every run of windows that share an anchor.

    The anchor of a window is its gram of smallest hash, the leftmost of equals, so equal windows have equal anchors
    at equal offsets. Windows never cross documents (document d has tokens bounds[d]:bounds[d + 1]).
    """
    hashes = gram_hashes(tokens, gram)
    anchors = leftmost_minima(hashes, window - gram + 1)
    sizes = np.maximum(np.diff(bounds) - window + 1, 0)
    docs = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(len(docs))
    at = anchors[starts]
    heads = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(docs, prepend=-1) != 0))
    tails = np.concatenate([heads[1:], [len(at)]])[: len(heads)] - 1
    a = at[heads].astype(np.int64)
    return a, starts[heads], starts[tails], docs[heads], hashes[a]


def expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the ranges first..last, and the range each belongs to."""
    sizes = last - first + 1
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes - first, sizes), which


def covered(length: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Mask of the positions that a window from one of starts covers."""
    edge = np.zeros(length + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, length), -1)
    return np.cumsum(edge[:length]) > 0


def runs(mask: np.ndarray) -> int:
    return int(np.count_nonzero(mask[1:] & ~mask[:-1]) + (len(mask) > 0 and mask[0]))


_squeeze, _open = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Equally long arrays as compressed bytes."""
    return _squeeze.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = _open.decompress(data)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


#: Rows of a packed exchange; kind 0 is compared in its bucket, kind 1 is passed on.
PACKED = "bucket int, kind int, data binary"


def packed_rows(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "data"])


def cut(bucket: np.ndarray, kind: int, *arrays: np.ndarray) -> list[tuple[int, int, bytes]]:
    """One packed row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    arrays = tuple(a[order] for a in arrays)
    return [(int(bucket[a]), kind, pack(*(x[a:b] for x in arrays))) for a, b in zip(heads, [*heads[1:], len(bucket)])]


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(20)) % np.uint64(n)).astype(np.int32)


def by_bucket(batches) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """Each bucket with its rows by kind; input is sorted by bucket."""
    now, found = None, {}
    for batch in batches:
        for bucket, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if bucket != now:
                if found:
                    yield now, found
                now, found = bucket, {}
            found.setdefault(kind, []).append(data)
    if found:
        yield now, found


def per_document(docs: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc, hits): the values of each document as bytes."""
    if not len(docs):
        return
    order = np.argsort(docs, kind="stable")
    docs, values = docs[order], values[order]
    heads = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    for a in range(0, len(heads), 20_000):
        part = heads[a : a + 20_000]
        ends = [*part[1:], heads[a + 20_000] if a + 20_000 < len(heads) else len(docs)]
        yield pa.RecordBatch.from_arrays([pa.array(docs[part]), pa.array([values[x:y].tobytes() for x, y in zip(part, ends)], pa.binary())], ["doc", "hits"])


HITS = "doc long, hits binary"


def to_documents(docs: np.ndarray, values: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    """Packed rows that deal values out by document."""
    return cut(bucket_of(mix(docs.astype(np.uint64), np.uint64(1)), n), 0, docs, values) if len(docs) else []


def passed_on(bucket: int, found: dict[int, list[bytes]]) -> list[tuple[int, int, bytes]]:
    """What a mapper had settled itself: rows of kind 1, dealt by document already."""
    return [(bucket, 0, data) for data in found.pop(1, [])]


def exchange(df, n: int, reduce, kind):
    """(doc, hits): compare packed rows by bucket with `reduce`, then gather what it returns by document.

    Both steps move few large rows, whatever the number of documents and hits.
    """

    def gather(batches):
        for _, found in by_bucket(batches):
            yield from per_document(*(np.concatenate(c) for c in zip(*(unpack(x, np.int64, kind) for x in found[0]))))

    def dealt(x):
        return x.repartition(n, "bucket").sortWithinPartitions("bucket")

    return dealt(dealt(df).mapInArrow(reduce, PACKED)).mapInArrow(gather, HITS)


def heads_of(keys: np.ndarray) -> np.ndarray:
    """Number of the group of each sorted key, from 0."""
    return np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def repeated(hashes: np.ndarray, docs: np.ndarray, within: bool) -> tuple[np.ndarray, ...]:
    """Sorted by hash and document: (hashes, docs, group, whether the group has two documents, or two places if within)."""
    order = np.lexsort((docs, hashes))
    hashes, docs = hashes[order], docs[order]
    if not within and len(hashes):
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])])
        hashes, docs = hashes[new], docs[new]
    group = heads_of(hashes)
    return hashes, docs, group, np.bincount(group, minlength=1)[group] > 1 if len(group) else group.astype(bool)


def candidates(anchors, n: int, within: bool):
    """Mapper and reducer that leave, for each document, the hashes of its anchors that also occur elsewhere.

    anchors(batches) yields (document ids, hashes) of anchors. A mapper sends one row of a group of equal anchors for
    all it has read, so an anchor of very many documents stays small; the others of the group it settles itself.
    """

    def send(hashes, docs):
        hashes, docs, group, many = repeated(np.concatenate(hashes), np.concatenate(docs), within)
        first = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else many
        rows = cut(bucket_of(hashes[first], n), 0, hashes[first], docs[first], many[first].astype(np.uint8))
        if many.any():
            rows += [(b, 1, data) for b, _, data in to_documents(docs[many], hashes[many], n)]
        return rows

    def mapper(batches):
        hashes, docs, size = [], [], 0
        for doc, found in anchors(batches):
            hashes.append(found)
            docs.append(doc)
            size += len(found)
            if size >= FLUSH:
                yield from packed_rows(send(hashes, docs))
                hashes, docs, size = [], [], 0
        if size:
            yield from packed_rows(send(hashes, docs))

    def reducer(batches):
        for bucket, found in by_bucket(batches):
            rows = passed_on(bucket, found)
            if found:
                parts = [unpack(x, np.uint64, np.int64, np.uint8) for x in found[0]]
                hashes, docs, many = (np.concatenate(c) for c in zip(*parts))
                order = np.argsort(hashes, kind="stable")
                hashes, docs, many = hashes[order], docs[order], many[order]
                group = heads_of(hashes)
                back = (np.bincount(group)[group] > 1) & (many == 0)
                rows += to_documents(docs[back], hashes[back], n)
            yield from packed_rows(rows)

    return mapper, reducer


def keys_of(docs: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return hashes ^ (docs.astype(np.uint64) * _A)


def surviving(doc: np.ndarray, hashes: np.ndarray, hits: list) -> np.ndarray:
    """Mask of the anchors (document number, hash) that hits, hashes as bytes for each document, holds."""
    lists = [np.frombuffer(h or b"", np.uint64) for h in hits]
    sizes = [len(x) for x in lists]
    known = keys_of(np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.zeros(0, np.uint64), *lists]))
    return np.isin(keys_of(doc, hashes), known)


def raw_texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return [x or b"" for x in pc.cast(batch.column(at), pa.binary()).to_pylist()]
