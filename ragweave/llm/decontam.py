"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every run of `window` words is represented by the smallest hash of its k-word grams. Equal runs have equal
representatives, so joining the representatives of texts and items misses no shared run of `window` words. Runs whose
representative matches are then compared word for word, and the words they cover are hit. Items with fewer words have
no such run; they are looked up whole.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.llm.common import materialize

WINDOW, GRAM = 10, 4
#: Largest benchmark side, in bytes, that is sent to every executor; beyond it Spark shuffles both sides.
BROADCAST_BYTES = 32 << 20
_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_FROM, _TO = _SEPARATORS + string.ascii_uppercase, " " * len(_SEPARATORS) + string.ascii_lowercase


def words(text: Column) -> Column:
    """Lower-cased (A-Z alone) runs of ASCII letters, digits and all other characters beyond ASCII; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _FROM, _TO), " "), lambda w: w != "")


def _once(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is never inlined into its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _marked(text: Column, window: int, gram: int) -> Column:
    """struct(w, m): the words and the representative of each run, by its start from 0."""

    def least(g: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - window), lambda i: F.least(*(F.get(g, i + j) for j in range(window - gram + 1))))

    def grams(h: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - gram), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(gram))))

    def runs(w: Column) -> Column:
        n = F.size(w)
        marks = _once(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _once(grams(h, n), lambda g: least(g, n)))
        return F.struct(w.alias("w"), F.when(n >= window, marks).otherwise(F.array().cast("array<bigint>")).alias("m"))

    return _once(words(text), runs)


def _shingled(rows: DataFrame, keep: list[str], text: str, window: int, gram: int) -> DataFrame:
    """keep, w and m of every row."""
    return rows.select(*keep, F.explode(F.array(_marked(F.col(text), window, gram))).alias("_s")).select(*keep, "_s.w", "_s.m")


def _small(df: DataFrame, width: Column) -> DataFrame:
    """df, to be sent to all executors if its rows, width bytes each, are small together."""
    return F.broadcast(df) if (df.agg(F.sum(width + 32)).first()[0] or 0) <= BROADCAST_BYTES else df


def hits(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, n_words, n_hit, items) of every row: words, words inside a run shared with an item, sorted ids of the items.

    Null texts have no words, and items without words match nothing. Keys are taken to be unique: rows that repeat a
    key count as one document; a null key is never hit. Repeated items are all reported. Extra columns are ignored;
    without documents the result is empty, without items nothing is hit.
    """
    rows = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("_text"))
    wide = materialize(_shingled(items, ["item"], "_text", window, gram).where(F.size("w") > 0), "items")
    n = F.least(F.size("w"), F.lit(window))
    runs = wide.select("item", "w", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("at")).select("n", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("run"), "item")
    runs = materialize(runs.groupBy("n", "run").agg(F.sort_array(F.collect_set("item")).alias("items")), "runs")
    marks = _small(wide.select(F.explode("m").alias("mark")).distinct(), F.lit(8))

    taken = _shingled(rows, ["_doc"], "_text", window, gram)
    taken = materialize(taken.select("_doc", F.size("w").alias("n_words"), F.array_distinct("m").alias("m")), "marks")
    met = taken.select("_doc", F.explode("m").alias("mark")).join(marks, "mark").select("_doc").distinct()

    suspects = _shingled(rows.join(met, "_doc"), ["_doc"], "_text", window, gram)
    places = F.transform("m", lambda mark, i: F.struct(i.alias("at"), mark.alias("mark"), F.array_join(F.slice("w", i + 1, window), " ").alias("run")))
    found = suspects.select("_doc", F.inline(places)).join(marks, "mark").select("_doc", "at", F.lit(window).alias("n"), "run")
    for r in runs.where(F.col("n") < window).select("n").distinct().orderBy("n").collect():  # at most window - 1 lengths
        short = rows.select("_doc", F.explode(F.array(words(F.col("_text")))).alias("w"))
        each = short.where(F.size("w") >= r.n).select("_doc", "w", F.explode(F.sequence(F.lit(0), F.size("w") - r.n)).alias("at"))
        found = found.union(each.select("_doc", "at", F.lit(r.n).alias("n"), F.array_join(F.slice("w", F.col("at") + 1, r.n), " ").alias("run")))
    exact = found.join(_small(runs, F.octet_length("run") + F.size("items") * 24), ["n", "run"]).select("_doc", F.struct(F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("b")).alias("span"), "items")

    def cover(spans: Column) -> Column:
        zero = F.struct(F.lit(0).alias("b"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, s: F.struct(F.greatest(acc["b"], s["b"]).alias("b"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["b"], s["a"]))).alias("n"))
        return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])

    hit = exact.groupBy("_doc").agg(cover(F.collect_set("span")).alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = taken.select("_doc", F.col("n_words").cast("long")).join(hit, "_doc", "left")
    return out.select(F.col("_doc").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
