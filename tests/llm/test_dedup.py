import numpy as np
import pytest
from helpers import awkward, documents, jaccard_components, prose, removed_bytes, removed_words, rng

from ragweave.llm import ngram_jaccard, repeats, substring_dedup, suffix_dedup


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_against_brute_force(spark, seed):
    texts = awkward(rng(seed))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(documents(spark, texts)).collect()}
    assert got == removed_bytes(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_against_brute_force(spark, seed):
    texts = awkward(rng(seed))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(documents(spark, texts)).collect()}
    assert got == removed_words(texts)


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_jaccard_against_brute_force(spark, words, percent):
    r = rng(words)
    base = prose(r, 90, 10_000)
    near = [" ".join(w if r.random() > 0.02 else f"y{r.randint(0, 99)}" for w in base.split()) for _ in range(40)]
    common = prose(r, 60, 10_000)
    shared = [f"{common} {prose(r, r.randint(0, 25), 9000)}" for _ in range(40)]
    texts = awkward(r) + near + shared
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_jaccard.link(documents(spark, texts), words=words, percent=percent).collect()}
    assert got == jaccard_components(texts, words, percent)


def test_frequent_shingles_are_combined(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "FREQUENT", 1)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 3)
    r = rng(9)
    base = prose(r, 40, 10_000).split()
    texts = [" ".join(w if i != k and i != 2 * k + 1 else f"z{k}" for i, w in enumerate(base)) for k in range(20)] + [prose(r, 30, 500) for _ in range(10)]
    for words, percent in ((1, 80), (2, 90), (3, 70)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_jaccard.link(documents(spark, texts), words=words, percent=percent).collect()}
        assert got == jaccard_components(texts, words, percent)


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_share_a_combination(percent):
    r = np.random.default_rng(percent)
    for n in (3, 7, 20, 61, 200, 900):
        a = r.integers(0, 2**63, n).astype(np.uint64)
        for _ in range(30):
            b = a.copy()
            while True:  # a chain of edits, as long as the sets are similar
                b = b[r.permutation(len(b))][r.integers(0, 2) :] if r.random() < 0.5 and len(b) > 1 else np.append(b, r.integers(0, 2**63, 1).astype(np.uint64))
                both = len(np.intersect1d(a, b))
                if 100 * both < percent * (len(a) + len(b) - both):
                    break
                assert len(np.intersect1d(ngram_jaccard.combinations(a, percent), ngram_jaccard.combinations(b, percent)))
    assert len(ngram_jaccard.combinations(a, percent)) < 0.6 * len(a)


def test_texts_of_common_pieces_meet_rarely(spark):
    """Documents of 20 sentences from a pool of 60, none similar: twice as many compare fewer than three times as many pairs."""
    r, pairs = rng(4), {}
    pool = [prose(r, 8, 10_000) for _ in range(60)]
    for n in (150, 300):
        texts = [" ".join(r.sample(pool, 20)).encode() for _ in range(n)]
        met = {}
        for i, s in enumerate(ngram_jaccard.shingle_sets(texts, 3)):
            for k in ngram_jaccard.combinations(s, 90).tolist():
                met.setdefault(k, []).append(i)
        pairs[n] = sum(len(x) * (len(x) - 1) // 2 for x in met.values())
    assert pairs[300] < 3 * max(pairs[150], 300)


def test_crowds_of_near_copies_are_dealt_once(spark, monkeypatch):
    """Near copies in which too much differs to link are not dealt out in every pair of blocks."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    r, dealt = rng(21), []
    base = prose(r, 150, 10_000).split()
    edit = lambda i, k: " ".join(f"z{i}" if p in k else w for p, w in enumerate(base))
    texts = [edit(i, r.sample(range(150), r.choice((2, 3, 3, 4)))) for i in range(240)] + [edit(300 + i, r.sample(range(150), 1)) for i in range(4)]
    texts += [" ".join(base[:p] + base[p + 1 + p % 4 :]) for p in r.sample(range(150), 12)]
    docs = documents(spark, texts)
    frame = type(docs)
    repartition = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: (dealt.append(self.count()) if a == ("cell",) else None, repartition(self, *a))[1])
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_jaccard.link(docs, words=3, percent=90).collect()}
    assert got == jaccard_components(texts, 3, 90)
    assert len({c for _, c in got.values()}) > 100  # most do not link
    assert dealt[0] < 20 * len(texts)


@pytest.mark.parametrize("percent", [80, 90])
def test_similar_sets_agree_in_a_part_of_their_rests(percent):
    r = np.random.default_rng(percent)
    met = 0
    for n in (12, 61, 200, 900):
        for _ in range(150):
            a = r.integers(0, 2**63, n).astype(np.uint64)
            out, new = r.integers(0, n * (100 - percent) // 60 + 1, 2)
            b = np.append(a[out:], r.integers(0, 2**63, new).astype(np.uint64))
            if 100 * (n - out) < percent * (n + new):
                continue
            free = r.integers(0, out + 1), r.integers(0, new + 1)  # of what the other lacks
            x, y = ngram_jaccard.slack(n, int(free[0]), percent), ngram_jaccard.slack(len(b), int(free[1]), percent)
            keys, sides = zip(ngram_jaccard.rest_combinations(a[free[0] :], x, [y]), ngram_jaccard.rest_combinations(b[: len(b) - free[1]], y, [x]))
            assert len(np.intersect1d(*keys))
            assert {int(s[0]) for s in sides} == ({-1} if x == y else {0, 1})
            met += 1
    assert met > 60


def test_null_and_repeated_keys_link(spark):
    r = rng(11)
    base = prose(r, 200, 10_000).split()
    edit = lambda k: " ".join(w if i not in k else f"y{i}" for i, w in enumerate(base))
    ends = [edit(range(0, 9)), edit(range(10, 19))]  # each is similar to the base, not to the other
    schema = "doc_id long, text string"
    rows = [(0, ends[0]), (None, " ".join(base)), (1, ends[1]), (5, "other words " + prose(r, 50)), (5, ends[0] + " x")]
    got = sorted((x.doc_id is None, x.doc_id, x.component_id) for x in ngram_jaccard.link(spark.createDataFrame(rows, schema), words=1, percent=90).collect() if x.doc_id is not None)
    assert got == [(False, 0, 0), (False, 1, 0), (False, 5, 0), (False, 5, 5)]


def thue_morse(n, x, y):
    return "".join(x if bin(i).count("1") % 2 == 0 else y for i in range(n))


def test_words_do_not_collide_by_construction(spark):
    a, b = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    assert len(set(repeats.word_tokens([" ".join([a, b, a[:512], b[:512], a[:64], b[:64]]).encode()])[0].tolist())) == 6
    texts = [" ".join([a] * 60), " ".join([b] * 60), a, b]
    assert {x.doc_id: x.component_id for x in ngram_jaccard.link(documents(spark, texts), words=3, percent=90).collect()} == {i: i for i in range(4)}
    assert all(x.n_removed == 0 for x in substring_dedup.remove_repeats(documents(spark, texts)).collect() if x.doc_id == 1)


def test_empty_tables_clashing_columns_and_repeated_rows(spark):
    schema = "doc_id long, text string, doc string, hits string, sig long, label int, key string"
    rows = [(1, "a b c " * 60, "x", "y", 1, 2, "k"), (1, "a b c " * 60, "x", "y", 1, 2, "k"), (None, "a b c " * 60, None, None, None, None, None), (2, None, None, None, None, None, None)]
    for table in (spark.createDataFrame([], schema), spark.createDataFrame(rows, schema)):
        n = table.count()
        assert suffix_dedup.remove_repeats(table).count() == n
        assert substring_dedup.remove_repeats(table).count() == n
        assert ngram_jaccard.link(table).count() == n


@pytest.mark.parametrize("small", [1, 16, 10_000])
def test_multikey_quicksort(small):
    r = np.random.default_rng(4)
    for letters, length in ((2, 12), (26, 9), (1, 20), (3, 30)):
        data = r.integers(97, 97 + letters, 3000, dtype=np.uint8)
        data = np.concatenate([data, data[500:900], data[100:200]])
        at = r.permutation(len(data) - length)
        members, part = suffix_dedup.multikey_quicksort(np.concatenate([data, np.zeros(8, np.uint8)]), at, length, small)
        groups = {}
        for i, x in enumerate(at.tolist()):
            groups.setdefault(bytes(data[x : x + length]), set()).add(i)
        want = [g for _, g in sorted(groups.items()) if len(g) > 1]
        got = [set(members[part == p].tolist()) for p in range(part.max() + 1)] if len(part) else []
        assert got == want
    assert len(suffix_dedup.multikey_quicksort(np.zeros(8, np.uint8), np.zeros(0, np.int64), 8)[0]) == 0


def test_wide_windows(spark):
    text = "".join(chr(97 + x) for x in np.random.default_rng(2).integers(0, 26, 900))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(documents(spark, [text, text]), window=400).collect()}
    assert got == {0: 0, 1: 900}


@pytest.mark.parametrize("window", [5, 24, 49, 100])
def test_levels_of_any_window(spark, window):
    texts = awkward(rng(window))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(documents(spark, texts), window=window).collect()}
    assert got == removed_words(texts, window)


def test_minima_and_grams():
    r = np.random.default_rng(5)
    values = r.integers(0, 9, 300).astype(np.uint64)
    for width in (1, 2, 7, 26):
        want = [i + int(np.argmin(values[i : i + width])) for i in range(300 - width + 1)]
        assert repeats.leftmost_minima(values, width).tolist() == want
    grams = repeats.gram_hashes(values, 5)
    assert (grams[:296][:, None] == grams[:296][None, :]).sum() == sum((values[i : i + 5] == values[j : j + 5]).all() for i in range(296) for j in range(296))


def test_words():
    tokens, bounds = repeats.word_tokens([b"a B\x0bc", b"", b"  ", b"A b\x1cc a"], lower=True)
    assert bounds.tolist() == [0, 3, 3, 3, 6]
    assert tokens[0] == tokens[3] == tokens[5] and len(set(tokens.tolist())) == 4
