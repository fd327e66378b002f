import math

import pytest
from conftest import SF, compare
from helpers import documents

from ragweave.llm import common, decontam, queries, topk_search


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    got, want = compare(spark, name)
    assert got == want


def brute(rows, k=5):
    usable = {i: [math.floor(256 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q in usable:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)[:k]
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("stripe", [3, 1000])
def test_top_k(spark, stripe):
    import random

    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(120)]
    rows[7:12] = [(7, None), (8, [None, 1.0]), (9, [float("nan")] * 6), (10, [float("inf")] * 6), (11, [])]
    rows += [(200 + i, rows[20][1]) for i in range(9)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int").repartition(3)
    from numpy import float32

    exact = [(i, v if v is None else [x if x is None else float(float32(x)) for x in v]) for i, v in rows]
    got = {}
    for r in topk_search.top_k(table, stripe_rows=stripe).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got == brute(exact)
    assert topk_search.top_k(table.limit(0)).count() == 0
    assert topk_search.top_k(table.where("vec_id = 0")).count() == 0
    assert len(topk_search.top_k(table.where("vec_id in (0, 1, 2)")).collect()) == 2


def decontaminate(texts, items):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in (t or "")))
    out = {}
    for d, t in enumerate(texts):
        w = cut(t)
        hit, who = set(), set()
        for k, item in items:
            x = cut(item)
            n = min(10, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[a : a + n]:
                        hit |= set(range(p, p + n))
                        who.add(str(k))
        out[d] = (len(w), len(hit), sorted(who))
    return out


def test_decontamination(spark):
    long = " ".join(f"q{i}" for i in range(25))
    items = [(1, long), (2, "short item"), (3, None), (4, " ,."), (5, long), (6, "É Tude"), (10, "a b c d e f g h i j")]
    texts = [None, "", f"x {long.upper()} y", "q3 " + " ".join(f"q{i}" for i in range(5, 15)) + " q1", "a Short, ITEM! b short item", "é tude É TUDE", "a b c d e f g h i", "a-b c_d e f g h i j k", "q1 " * 3000 + long, "short item", "short item", long]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumnRenamed("text", "text")
    docs = documents(spark, texts).selectExpr("*", "1 as w", "2 as m", "3 as n", "4 as item")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontam.hits(docs, benchmark).collect()}
    assert got == decontaminate(texts, items)
    assert {r.n_hit for r in decontam.hits(docs, benchmark.limit(0)).collect()} == {0}
    assert decontam.hits(docs.limit(0), benchmark).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 102), (101, 102), (7, 7)]
    got = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_tables(spark):
    assert {r.query_id for r in queries.op7_topk_search(spark, SF).collect()} == set(range(0, 500, 50))


def test_discarded_tables_are_gone(spark):
    import os

    kept, gone = (common.materialize(spark.range(3), n) for n in ("kept", "gone"))
    common.discard(gone)
    assert os.path.isdir(kept.ragweave_path) and not os.path.isdir(gone.ragweave_path)
    common.discard(spark.range(3))
