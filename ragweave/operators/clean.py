"""Structural cleaning of long documents: paragraphs as rows, state as windows over each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ragweave.functions import text as T


def explode_paragraphs(docs: DataFrame, key: str = "path", text: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns of keep, idx, para) for every paragraph, from 0."""
    return docs.select(key, *keep, F.posexplode(T.paragraphs(F.col(text))).alias("idx", "para"))


def seek_first_content(paras: DataFrame, key: str = "path") -> DataFrame:
    """Drop what lies over two paragraphs before the first two neighbours of more than 100 characters (from the third on)."""
    by = Window.partitionBy(key)
    following = F.lead(F.length("para")).over(by.orderBy("idx"))
    marked = paras.withColumn("_hit", F.when((F.col("idx") >= 2) & (F.length("para") > 100) & (following > 100), F.col("idx")))
    start = F.coalesce(F.min("_hit").over(by) - 2, F.lit(0))
    return marked.withColumn("_start", start).where("idx >= _start").drop("_hit", "_start")


def drop_sections(paras: DataFrame, key: str = "path") -> DataFrame:
    """Drop front matter up to the first heading or paragraph over 200 characters, and removed sections to the next heading."""
    by = Window.partitionBy(key)
    heading, removed = T.is_heading(F.col("para")), T.is_removed_heading(F.col("para"))
    marked = paras.withColumn("_front", F.min(F.when(heading | (F.length("para") > 200), F.col("idx"))).over(by)).where("idx >= _front")
    event = F.when(removed, F.lit("B")).when(heading, F.lit("S"))
    state = F.last(event, ignorenulls=True).over(by.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_state", F.coalesce(state, F.lit("-"))).where("_state <> 'B'").drop("_front", "_state")


def normalize_paragraphs(paras: DataFrame) -> DataFrame:
    return paras.withColumn("para", T.normalize_space(F.col("para"))).where("para <> ''")


def core_paragraphs(docs: DataFrame, key: str = "path", text: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, columns of keep, idx, para): all cleaning steps; one exchange by key serves every window."""
    sliced = docs.select(key, *keep, T.contents_slice(F.col(text)).alias(text))
    return drop_sections(normalize_paragraphs(seek_first_content(explode_paragraphs(sliced, key, text, keep), key)), key)


def core_text(docs: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """(key, core): the paragraphs left, joined by blank lines; a document without any has the empty text."""
    left = core_paragraphs(docs, key, text).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "para"))).alias("p"))
    joined = left.select(key, F.array_join(F.transform("p", lambda p: p["para"]), "\n\n").alias("core"))
    return docs.select(key).join(joined, key, "left").select(key, F.coalesce("core", F.lit("")).alias("core"))
