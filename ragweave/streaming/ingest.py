"""Incremental ingestion: new text files of a folder become index rows as they appear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragweave.operators import chunk, embed
from ragweave.plans import experiment, schemas
from ragweave.plans.config import Settings

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def stream_corpus(spark: SparkSession, raw: str, out: str, providers: experiment.Providers = experiment.Providers(), settings: Settings = Settings(), **trigger) -> StreamingQuery:
    """Append the index rows of every new .txt file below raw to out/index; each file is read once.

    Sources are packed independently, so a file's chunks do not depend on the batch it comes in. Chunk ids go on
    from the largest so far. A batch that is repeated after a failure overwrites its own folder.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(raw)
    content = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    docs = files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path", content.alias("content"))

    def add(batch: DataFrame, number: int) -> None:
        _, packed = chunk.build_chunks(experiment.keep(batch, "batch"), settings, providers.cut)
        earlier = index(spark, out).where(F.col("batch") < number)
        start = (earlier.agg(F.max("chunk_id")).first()[0] + 1) if not earlier.isEmpty() else 0
        rows = embed.build_index(packed.withColumn("chunk_id", F.col("chunk_id") + start), providers.embedder, settings, providers.cut)
        rows.write.mode("overwrite").parquet(f"{out}/index/batch={number}")

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def index(spark: SparkSession, out: str) -> DataFrame:
    """The index so far, with the number of the batch each row came in."""
    from pyspark.errors import AnalysisException

    kind = f"{schemas.INDEX}, batch bigint"
    try:
        return spark.read.schema(kind).option("basePath", f"{out}/index").parquet(f"{out}/index")
    except AnalysisException:
        return spark.createDataFrame([], kind)
