"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.llm import decontam, language_id, ngram_jaccard, secret_scan, sentencepiece_codec
from ragweave.llm.common import crc_mod, materialize, table

#: Columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Posterior below which a predicted language is taken for undetermined.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language: no text, no letter, or no language with at least SURE.

    A null lang is filled with the prediction, others stay. Of tied languages the first by name is predicted, whose
    score is then below SURE or even. Rows are independent: repeated ids and rows stay; an empty table gives an empty one.
    """
    model = language_id.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2), order=F.xxhash64("doc_id"))
    found = language_id.identify(docs, model, keep=COLUMNS)
    kept = found.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= SURE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(docs with a key of every row in _row, whether that is doc_id): where ids repeat or are null, rows are numbered and written."""
    n = docs.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    if n.rows == n.ids:
        return docs.withColumn("_row", F.col("doc_id")), True
    return materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "rows"), False


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of smallest id (null last) of each component of near-duplicates (five-word shingles, 0.8 or more).

    Of repeated rows one stays, whatever their ids. Null, empty and blank texts link with nothing and stay, as do all
    rows of an empty table.
    """
    rows, own = keyed(docs)
    found = ngram_jaccard.link(rows, "_row")
    if own:
        dropped = found.where("component_id <> _row")
    else:
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
        least = found.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min_by("_row", order).alias("kept"))
        dropped = found.join(least, "component_id").where("_row <> kept")
    return rows.join(dropped.select("_row"), "_row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that share a window of words with a benchmark item.

    Rows are judged by their own texts, also where ids repeat or are null; null and empty texts stay, as do all
    documents where there are no items.
    """
    rows, _ = keyed(docs)
    found = decontam.hits(rows, table(spark, sf_dir, "benchmark"), "_row")
    return rows.join(found.where("n_hit > 0").select("_row"), "_row", "left_anti").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mask; every document stays. A null text stays null, with a null n_chars; ids do not matter."""
    found = secret_scan.scan(docs, secret_scan.default_forest(spark))
    return found.withColumns({"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and the text decoded from them, as counts and digests, a row for every row. Null and empty texts have the end
    id alone; an empty table gives an empty one."""
    coded = sentencepiece_codec.encode_decode(docs)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("sentencepiece", encode),
]

#: SQL can express neither the language model nor the forest; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
