"""Readers: text corpora, chunk files, index tables and gold question sets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragweave.plans import schemas


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row for each .txt file below path (the ending is case-sensitive); unreadable files are skipped.

    Bytes that are not UTF-8 become U+FFFD and all line ends one newline. A missing path gives an empty table.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").option("ignoreCorruptFiles", True)
    try:
        files = reader.load(path)
    except AnalysisException:
        return spark.createDataFrame([], schemas.DOCUMENT)
    content = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", content.alias("content"))


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        if not path.endswith(".json"):
            return spark.read.schema(schema).parquet(path)
        first = spark.read.text(path).where("trim(value) <> ''").first()
        array = first is not None and first.value.lstrip().startswith("[")
        return spark.read.schema(schema).option("multiLine", array).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Packed chunks from Parquet, or from JSON: a line for each, or a file with one array; a missing path gives an empty table."""
    return _table(spark, path, schemas.CHUNK)


def masters(spark: SparkSession, path: str) -> DataFrame:
    """Master chunks, from the same forms as chunks."""
    return _table(spark, path, schemas.MASTER_CHUNK)


def index(spark: SparkSession, path: str) -> DataFrame:
    """Chunks with raw and normalised vectors in one table."""
    return spark.read.schema(schemas.INDEX).parquet(path)


def gold_questions(spark: SparkSession, path: str) -> DataFrame:
    """(query_type, query, answer) from columns question_type, question and reference_answer of CSV, JSON, Parquet or xlsx.

    Missing columns and blank cells are empty texts.
    """
    if path.endswith(".xlsx"):
        import pandas

        rows = spark.createDataFrame(pandas.read_excel(path).astype(object).where(lambda d: d.notna(), None))
    elif path.endswith(".csv"):
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    elif path.endswith((".json", ".jsonl")):
        rows = spark.read.schema(schemas.GOLD_FILE).option("multiLine", path.endswith(".json")).json(path)
    else:
        rows = spark.read.parquet(path)
    names = {"question_type": "query_type", "question": "query", "reference_answer": "answer"}
    return rows.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(v) if k in rows.columns else F.lit("").alias(v) for k, v in names.items()))


def queries(spark: SparkSession, items: list[dict]) -> DataFrame:
    """Query rows from dictionaries with query, answer and query_type (Unknown if absent), numbered in order."""
    rows = [(i, x.get("query_type") or "Unknown", x.get("query") or "", x.get("answer")) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, schemas.QUERY)


def single_query(spark: SparkSession, query: str) -> DataFrame:
    if not query or not query.strip():
        raise ValueError("empty query")
    return queries(spark, [{"query": query}])
