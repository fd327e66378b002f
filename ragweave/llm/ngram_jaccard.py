"""Exact Jaccard join of documents' word-shingle sets with token-combination prefixes.

Shingles are ordered rare class first, then by hash. Two similar sets share a shingle of their prefixes (the first
n - ceil(t n) + 1). A shingle that few prefixes hold is indexed alone. A set whose prefix holds a frequent one is
extended to the whole set and indexed by combinations of shingles: shingles fall into parts by hash, and those of one
part are a combination. Sets that differ in m shingles at most cannot differ in all of m + 1 parts, so similar ones
that share frequent shingles alone share a combination. Their number grows with a set's size, not with its square,
and all shingles of a combination must agree, so even frequent ones part texts that are put together from common pieces.

Equal sets are one class from the start. Sets that share a rare shingle are few; those of like size are compared by
bitmaps of their parities, whose Hamming distance is at most the number of shingles in which the sets differ, so no
link between different sets is lost; only the texts of close pairs are fetched and verified. Sets that share a
combination are not paired off: in each entry all sets of like size are verified against a central one, and what links
is one component. Only sets of different components that share an entry are left. Bitmaps of small entries are compared
in place before texts are. The sets of large entries are indexed once more, without the shingles that one of them alone
holds: the more of these two sets have, the less may differ in the rest, and the fewer and longer are the combinations
of their rests. Entries that are large even then are cut into blocks, and pairs of blocks are dealt out.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragweave.llm import repeats as R
from ragweave.llm.common import components, discard, materialize, slices

#: Prefixes that hold a shingle beyond which it is frequent and no longer indexed alone.
FREQUENT = 32
#: Most shingles that are sent to all tasks to be put last in the order; this changes the cost, never the result.
LAST_MOST = 500_000
#: Rounds in which all sets of an entry are compared with one more central set of it, before the pairs that are left.
STARS = 3
#: Sets in a block of an entry, about; those of larger entries are indexed once more.
BLOCK = 512
#: Copies of a row that many others meet.
SALTS = 16
_SLICE = 2 << 20


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    tokens, bounds = R.word_tokens(texts, lower=True)
    grams = R.gram_hashes(tokens, words)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            s = np.sort(grams[a : b - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(R.gram_hashes(tokens[a:b], b - a)[:1])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


#: Words of 64 bits of a set's bitmap: bit i is the parity of the shingles that fall on i.
BITMAP = 12


def parities(shingles: np.ndarray) -> np.ndarray:
    counts = np.bincount((shingles >> np.uint64(32)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _signature(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _shorter(n: int, percent: int) -> int:
    """Smallest overlap with a similar set: ceil(t n)."""
    return -(-n * percent // 100)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def size_classes(most: int, percent: int) -> np.ndarray:
    """First sizes of the classes up to size `most`: a set's similar larger sets are in its class or the next."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return np.asarray(out)


def combinations(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set's combinations; any two different similar sets share one.

    A set is cut for its own size class and for the one below, so that it meets sets of its class and of both beside
    it. Some parts more than needed are made, so that empty ones, which say little, can be left out; a set with more
    empty ones than that keeps them.
    """
    classes, out = size_classes(len(s), percent), []
    for level in (len(classes) - 2, len(classes) - 3):
        if level < 0:
            continue
        smaller = int(classes[level + 1]) - 1
        differ = (smaller + smaller * 100 // percent) * (100 - percent) // (100 + percent)
        spare = 2 + differ // 16
        parts = differ + 1 + spare
        mixed = R.mix(s, np.uint64(level))
        part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        there, heads = np.unique(part[order], return_index=True)
        sums = np.zeros(parts, np.uint64)
        sums[there] = np.add.reduceat(mixed[order], heads)
        chosen = there if parts - len(there) <= spare else np.arange(parts)
        out.append(R.mix(sums[chosen], (level << 32 | chosen).astype(np.uint64)))
    return np.concatenate(out)


def slack(n: int, lone: int, percent: int) -> int:
    """What a set of n shingles, `lone` of which no other holds, adds to the number of shingles in which its rest may
    differ from a similar set's: n (1 - t) / (1 + t) - lone, rounded up, in steps that grow with it."""
    most = -((lone * (100 + percent) - n * (100 - percent)) // (100 + percent))
    step = 1 << max(0, abs(most).bit_length() - 4)
    return -(-most // step) * step


def rest_combinations(rest: np.ndarray, own: int, others: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sides) of a set's rest by its own slack, for each slack that similar sets have: as many parts as the sum of
    both and one more, so that similar sets agree in one. Sides are 0 and 1 by slack, -1 where the slacks are equal."""
    keys, sides = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    for other in others:
        parts = own + other + 1
        if parts < 1:
            continue
        tag = np.uint64((min(own, other) + (1 << 20)) << 24 | (max(own, other) + (1 << 20)))
        mixed = R.mix(rest, tag)
        part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, part, mixed)
        keys.append(R.mix(R.mix(sums, np.arange(parts).astype(np.uint64)), tag))
        sides.append(np.full(parts, -1 if own == other else int(own > other), np.int32))
    return np.concatenate(keys), np.concatenate(sides)


def pairs_of(cell: np.ndarray, allowed) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one cell for which allowed(i, j) holds; rows are sorted by cell."""
    found, i, step = [], np.arange(len(cell)), 0
    while True:
        step += 1
        i = i[: np.searchsorted(i, len(cell) - step)]
        i = i[cell[i] == cell[i + step]]
        if not len(i):
            break
        j = i + step
        ok = allowed(i, j)
        found.append((i[ok], j[ok]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (i, i)


def whole_cells(batches, name: str):
    """Columns of runs of whole cells, as a dictionary; the input is sorted by the column `name`."""
    tail = None
    for part in batches:
        part = pa.Table.from_batches([part])
        part = part if tail is None else pa.concat_tables([tail, part])
        cells = part.column(name).to_numpy()
        whole = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0
        if whole:
            yield {c: part.column(c).slice(0, whole).to_numpy() for c in part.column_names}
        tail = part.slice(whole)
    if tail is not None and tail.num_rows:
        yield {c: tail.column(c).to_numpy() for c in tail.column_names}


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of every row: documents link when 100 * shared >= percent * united shingles.

    component_id is the smallest key reachable by links, the row's own included. Null, empty and blank texts have no
    shingles and link with nothing. Rows that repeat a text are one class. Rows that repeat a key are rows of their
    own; a row without one links as others do, but has no say in a component's smallest key. Extra columns are
    ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    least = next(n for n in range(1, 202) if 100 * n >= percent * (n + 1))  # smaller sets are similar to equal ones alone

    def sign(batches):
        for part in slices(batches, "text", _SLICE):
            sets = shingle_sets(R.raw_texts(part, 1), words)
            bits = np.stack([parities(s) for s in sets])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_signature(s) for s in sets], pa.int64()), *(pa.array(bits[:, i]) for i in range(BITMAP))], ["doc", "n", "sig", *bitmap])

    bitmap = [f"b{i}" for i in range(BITMAP)]
    signed = materialize(rows.mapInArrow(sign, ", ".join(f"{c} long" for c in ("doc", "n", "sig", *bitmap))), "signed")

    def in_play(batches):
        """Different sets of a slice that can link with another: (signature, set)."""
        for part in slices(batches, "text", _SLICE):
            sets = [s for s in shingle_sets(R.raw_texts(part, 1), words) if len(s) >= least]
            yield list({_signature(s): s for s in sets}.items())

    def first_tokens(batches):
        """Counts of a prefix and half as much again, as what is put last is replaced by what follows."""
        for sets in in_play(batches):
            tokens = np.concatenate([np.zeros(0, np.uint64), *(s[: (len(s) - _shorter(len(s), percent) + 1) * 3 // 2 + 4] for _, s in sets)])
            tokens, counts = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(tokens)), pa.array(counts)], ["token", "n"])

    counted = materialize(rows.mapInArrow(first_tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT), "frequent")
    if (many := counted.count()) > LAST_MOST:
        counted = counted.where(F.col("n") > counted.agg(F.percentile_approx("n", 1 - LAST_MOST / many, 100_000)).first()[0])
    top = counted.select("token").limit(LAST_MOST).toArrow()
    last = np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast(last)  # at most LAST_MOST numbers

    def index(batches):
        common = sent.value
        for sets in in_play(batches):
            keys, sigs, sizes = [], [], []
            for sig, s in sets:
                length = len(s) - _shorter(len(s), percent) + 1
                sigs.append((sig, len(s), length))
                if len(common):
                    often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                    s = np.concatenate([s[~often][:length], s[often][:length]])
                keys.append(s[:length])
            if keys:
                sig, size, times = np.asarray(sigs, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(keys))), pa.array(np.repeat(sig, times)), pa.array(np.repeat(size, times))], ["key", "sig", "n"])

    entries = materialize(rows.mapInArrow(index, "key long, sig long, n long"), "entries")
    met = entries.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi"), F.count("*").alias("met")).where("lo <> hi").select("key", (F.col("met") > FREQUENT).alias("frequent"))
    shared = materialize(entries.join(met.hint("merge"), "key").distinct(), "shared")
    discard(entries)

    # Rare shingles: at most FREQUENT sets each, whose pairs of like size are compared by bitmap.
    def like_sizes(batches):
        for c in whole_cells(batches, "key"):
            sig, n = c["sig"], c["n"]
            i, j = pairs_of(c["key"], lambda i, j: np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sig[i], sig[j])), pa.array(np.maximum(sig[i], sig[j]))], ["a", "b"])

    alone = shared.where("not frequent").select("key", "sig", "n").repartition("key").sortWithinPartitions("key")
    alike = materialize(alone.mapInArrow(like_sizes, "a long, b long").distinct(), "alike")
    hot = shared.where("frequent").select("sig").distinct()
    play = alike.select(F.col("a").alias("sig")).union(alike.select("b")).union(hot).distinct()
    sized = materialize(signed.join(play.hint("merge"), "sig").select("sig", "n", *bitmap).dropDuplicates(["sig"]), "sized")
    x, y = sized.alias("x"), sized.alias("y")
    differ = sum((F.bit_count(F.col(f"x.{b}").bitwiseXOR(F.col(f"y.{b}"))) for b in bitmap), F.lit(0))
    close = (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent) & (differ * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent))
    near = materialize(alike.join(x, F.col("a") == F.col("x.sig")).join(y, (F.col("b") == F.col("y.sig")) & close).select("a", "b"), "near")
    discard(alike)

    # The texts to verify, by signature; sets are signed again, as keys may repeat. Joins that move much are merge joins
    # at every size, so that a run on little data shows what one on much data needs.
    wanted = near.select(F.col("a").alias("sig")).union(near.select("b")).distinct().withColumn("frequent", F.lit(False)).union(hot.withColumn("frequent", F.lit(True))).groupBy("sig").agg(F.max("frequent").alias("frequent"))
    keeper = materialize(signed.join(wanted.hint("merge"), "sig").groupBy("sig", "frequent").agg(F.min("doc").alias("doc")), "keeper")
    discard(shared)

    def shrink(batches):
        for part in slices(batches, "text", _SLICE):
            raw, out = R.raw_texts(part, 1), []
            asked, often = (part.column(i).to_pylist() for i in (2, 3))
            for t, s, want, f in zip(raw, shingle_sets(raw, words), asked, often):
                sig = _signature(s)
                if want is None or want == sig:
                    out.append((sig, R._squeeze.compress(t), _signed(combinations(s, percent)) if f and len(s) else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.binary(), pa.list_(pa.int64())))], ["sig", "z", "keys"])

    shape = "sig long, z binary, keys array<long>"
    texts = rows.join(keeper.where("doc is not null").hint("merge"), "doc").select("doc", "text", "sig", "frequent").mapInArrow(shrink, shape)
    orphans = rows.where("doc is null").select("doc", "text", F.lit(None).cast("long").alias("sig"), F.lit(True).alias("frequent")).mapInArrow(shrink, shape)
    orphans = orphans.join(keeper.where("doc is null").select("sig"), "sig", "left_semi").dropDuplicates(["sig"])
    texts = materialize(texts.union(orphans), "texts")

    def overlap(batches):
        known = OrderedDict()

        def get(sig, z):
            if (s := known.get(sig)) is None:
                s = known[sig] = shingle_sets([R._open.decompress(z)], words)[0]
                if len(known) > 256:
                    known.popitem(last=False)
            return s

        for part in batches:
            linked = []
            for a, b, za, zb in zip(*(part.column(c).to_pylist() for c in ("a", "b", "za", "zb"))):
                x, y = get(a, za), get(b, zb)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(both * 100 >= (len(x) + len(y) - both) * percent)
            names = [c for c in part.schema.names if c not in ("za", "zb")]
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(c).filter(mask) for c in names], names)

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b and what else they hold) that link; pairs are distinct."""
        names = pairs.columns
        x = pairs.join(texts.select(F.col("sig").alias("a"), F.col("z").alias("za")), "a")
        x = x.join(texts.select(F.col("sig").alias("b"), F.col("z").alias("zb")), "b").select(*names, "za", "zb")
        return materialize(x.mapInArrow(overlap, ", ".join(f"{c} long" for c in names)), name)

    label = components(verify(near, "links"))
    named = label.withColumnRenamed("node", "sig")

    # Frequent shingles: combinations. The set with the most shared entries is central to its near copies.
    combined = texts.select(F.explode("keys").alias("key"), "sig")
    several = combined.groupBy("key").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("key")
    groups = materialize(combined.join(several, "key").distinct().join(sized.select("sig", "n"), "sig"), "groups")
    central = groups.groupBy("sig").agg(F.count("*").alias("met"))
    classed = materialize(groups.join(central, "sig").withColumn("class", F.floor(F.log("n") / F.lit(math.log(100 / percent) + 1e-12))), "classed")
    discard(groups)
    salts = F.explode(F.array(*(F.lit(i) for i in range(SALTS)))).alias("salt")

    def in_several() -> DataFrame:
        """Entries that sets of more than one component share."""
        own = classed.join(named, "sig", "left").withColumn("comp", F.coalesce("label", "sig")).drop("label")
        split = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
        return materialize(own.join(split, "key"), "left")

    left, links, centers, done = in_several(), None, None, None
    for _ in range(STARS):
        fresh = left if done is None else left.join(done, ["key", "class", "comp"], "left_anti")
        pivots = materialize(fresh.groupBy("key", "class").agg(F.max(F.struct("met", "sig", "comp")).alias("p")).select("key", "class", "p.sig", "p.comp"), "pivots")
        both = left.select("key", "sig", "comp", F.explode(F.array("class", F.col("class") - 1)).alias("class"))
        stars = both.join(pivots.select("key", "class", F.col("sig").alias("pivot"), F.col("comp").alias("center")), ["key", "class"]).where("comp <> center").select("sig", "pivot").distinct()
        y = sized.join(pivots.select("sig").distinct(), "sig").select("*", salts).alias("y")
        near = stars.withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(SALTS)).cast("int")).alias("s").join(x, F.col("x.sig") == F.col("s.sig")).join(y, (F.col("y.sig") == F.col("s.pivot")) & (F.col("y.salt") == F.col("s.salt")) & close)
        found = verify(near.select(F.col("s.sig").alias("a"), F.col("s.pivot").alias("b")), "stars")
        if found.isEmpty():
            break
        links = found if links is None else links.union(found)
        label = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))
        named = label.withColumnRenamed("node", "sig")
        earlier, left = left, in_several()
        discard(earlier)
        centers = pivots.select("key", "class", "sig") if centers is None else centers.union(pivots.select("key", "class", "sig"))
        done = centers.join(named, "sig", "left").select("key", "class", F.coalesce("label", "sig").alias("comp")).distinct()

    # What is left: entries of several components. The sets of large ones are indexed again, by their rests.
    crowded = left.groupBy("key").count().where(F.col("count") > BLOCK).select("key")

    def by_rests() -> DataFrame:
        """Entries of the sets that crowded ones hold."""
        crowd = materialize(left.join(crowded, "key").select("sig", "comp", "n").distinct().join(texts.select("sig", "z"), "sig").dropDuplicates(["sig"]), "crowd")

        def sets_of(part):
            return shingle_sets([R._open.decompress(z) for z in part.column("z").to_pylist()], words)

        def held_by(batches):
            """Shingles of a slice of the crowd, how many of its sets hold them, and one of these."""
            for part in slices(batches, "z", _SLICE >> 3):
                sets = sets_of(part)
                tokens, first, times = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(tokens)), pa.array(np.repeat(part.column("sig").to_numpy(), [len(s) for s in sets])[first]), pa.array(times)], ["token", "sig", "times"])

        alone = crowd.mapInArrow(held_by, "token long, sig long, times long").groupBy("token").agg(F.min("sig").alias("sig"), F.sum("times").alias("times")).where("times = 1")
        lone = alone.groupBy("sig").agg(F.collect_list("token").alias("lone"))
        crowd = materialize(crowd.join(lone, "sig", "left").withColumn("lone", F.coalesce("lone", F.array().cast("array<long>"))), "crowd")

        def slacks(batches):
            for part in batches:
                sizes, lone = (part.column(i).to_pylist() for i in (0, 1))
                classes = size_classes(max(sizes, default=0), percent)
                found = {(int(np.searchsorted(classes, n, "right")), slack(n, k, percent)) for n, k in zip(sizes, lone)}
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int32()) for i in (0, 1)], ["class", "slack"])

        there = sorted(tuple(r) for r in crowd.select("n", F.size("lone")).mapInArrow(slacks, "class int, slack int").distinct().collect())  # of each class of sizes a few

        def again(batches):
            for part in slices(batches, "z", _SLICE >> 3):
                out = []
                for sig, comp, lone, s in zip(*(part.column(c).to_pylist() for c in ("sig", "comp", "lone")), sets_of(part)):
                    size = int(np.searchsorted(size_classes(len(s), percent), len(s), "right"))
                    rest = np.setdiff1d(s, np.asarray(lone, np.int64).view(np.uint64), assume_unique=True)
                    keys, turns = rest_combinations(rest, slack(len(s), len(lone), percent), sorted({x for c, x in there if abs(c - size) <= 1}))
                    out.append((_signed(keys), turns, np.full(len(keys), sig), np.full(len(keys), comp)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["key", "turn", "sig", "comp"])

        return crowd.mapInArrow(again, "key long, turn int, sig long, comp long")

    entered = left.select("key", F.lit(-1).alias("turn"), "sig", "comp")
    if not crowded.isEmpty():  # else no text needs to be moved
        entered = materialize(entered.join(crowded, "key", "left_anti").union(by_rests()), "entered")

    # Entries in blocks; every pair of blocks, of both sides where an entry has sides, is a cell.
    def compare(batches):
        for c in whole_cells(batches, "cell"):
            side, sig, comp, n = c["side"], c["sig"], c["comp"], c["n"]
            bits = np.stack([c[b] for b in bitmap], axis=1).view(np.uint64)

            def may_link(i, j):
                ok = (comp[i] != comp[j]) & ((side[i] < 0) | (side[i] != side[j])) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
                at = np.flatnonzero(ok)
                differ = np.bitwise_count(bits[i[at]] ^ bits[j[at]]).sum(axis=1, dtype=np.int64)
                ok[at] = differ * (100 + percent) <= (n[i[at]] + n[j[at]]) * (100 - percent)
                return ok

            i, j = pairs_of(c["cell"], may_link)
            lo, hi = (np.where(sig[i] < sig[j], p, q) for p, q in ((i, j), (j, i)))
            found = np.unique(np.stack([sig[lo], sig[hi], comp[lo], comp[hi]], axis=1), axis=0) if len(i) else np.zeros((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, k]) for k in range(4)], ["a", "b", "ca", "cb"])

    sides = [F.ceil(F.count_if(x) / BLOCK).cast("int").alias(name) for x, name in ((F.col("turn") < 1, "here"), (F.col("turn") == 1, "there"))]
    blocks = entered.groupBy("key").agg(*sides, F.min("turn").alias("least"), F.max("turn").alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    blocks = blocks.where("lo <> hi and (least < 0 or least <> most)").select("key", "here", "there", salts)
    members = entered.withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(SALTS)).cast("int")).join(blocks, ["key", "salt"])
    members = members.withColumn("blocks", F.when(F.col("turn") == 1, F.col("there")).otherwise(F.col("here"))).withColumn("across", F.when(F.col("turn") == 0, F.col("there")).otherwise(F.col("here")))
    members = members.withColumn("own", F.pmod(F.xxhash64("sig", F.lit(5)), "blocks").cast("int")).select("key", "turn", "sig", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("other"))
    even, second = F.col("turn") < 0, F.when(F.col("turn") < 0, F.col("own") > F.col("other")).otherwise(F.col("turn") == 1)
    first = F.when(second, F.col("other")).otherwise(F.col("own")), F.when(second, F.col("own")).otherwise(F.col("other"))
    dealt = members.select(F.xxhash64("key", *first).alias("cell"), F.when(even & (F.col("own") == F.col("other")), -1).otherwise(second.cast("int")).alias("side"), "sig", "comp").join(sized, "sig")
    cells = dealt.repartition("cell").sortWithinPartitions("cell").select("cell", "side", "sig", "comp", "n", *bitmap)
    late = verify(cells.mapInArrow(compare, "a long, b long, ca long, cb long").distinct(), "late")
    # Links between components are links between their labels; as few as there are such pairs of components.
    merged = components(late.select("ca", "cb").distinct(), "ca", "cb").select("node", F.col("label").alias("top"))
    nodes = label.select("node", "label").union(late.select("ca", "ca").union(late.select("cb", "cb"))).distinct()
    final = nodes.join(merged.withColumnRenamed("node", "label"), "label", "left").select(F.col("node").alias("sig"), F.coalesce("top", "label").alias("comp"))

    # A set that one row alone holds and that links with none needs no lookup; neither does one without shingles.
    held = signed.where("n > 0").groupBy("sig").agg(F.min("doc").alias("doc"), F.count("*").alias("rows")).join(final, "sig", "left").where("rows > 1 or comp is not null").select("sig", "doc", F.coalesce("comp", "sig").alias("comp"))
    held = materialize(held, "held")
    smallest = held.groupBy("comp").agg(F.min("doc").alias("first")).select("comp", "first", salts)
    named = held.withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(SALTS)).cast("int")).join(smallest, ["comp", "salt"]).select("sig", "first", salts)
    salted = signed.where("n > 0").withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    out = salted.join(named.withColumn("known", F.lit(True)), ["sig", "salt"], "left").select("doc", "n", F.when(F.col("known"), F.col("first")).otherwise(F.col("doc")).alias("component_id"))
    out = out.union(signed.where("n = 0").select("doc", "n", "doc"))
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), "component_id")
