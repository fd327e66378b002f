"""Helpers shared by the corpus operators: table access, durable intermediate tables, packed exchanges."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Text bytes worked on at once in a Python worker.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where that is unset, a temporary one for a session in one
    process, as in tests; on a cluster, whose executors could not see it, an error."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="ragweave-")
        shared_dir.own = at
    return at.rstrip("/")


_folders: set[str] = set()


def _drop(jvm, conf, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage is cut and lost executors cost nothing.

    The tables of an application share one folder there, which goes when the driver's Python ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = f"{shared_dir(spark)}/ragweave-{context.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_drop, context._jvm, context._jsc.hadoopConfiguration(), folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    context._jvm.System.gc()  # Spark deletes shuffle files once the driver has let go of the plan that made them
    out = spark.read.schema(df.schema).parquet(path)
    out.ragweave_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing to come reads."""
    if path := getattr(df, "ragweave_path", None):
        context = df.sparkSession.sparkContext
        _drop(context._jvm, context._jsc.hadoopConfiguration(), path)


#: Text bytes whose share of a packed exchange one worker is given.
BUCKET_BYTES = 64 << 20


def buckets(spark: SparkSession, size: int = 0) -> int:
    """How many parts a packed exchange is cut into: the session's shuffle parallelism, more for many bytes of text."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def rows_and_bytes(docs: DataFrame, text: str) -> tuple[int, int]:
    found = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text)).alias("size")).first()
    return found.rows, found["size"] or 0


def crc_mod(col, mod: int):
    """crc32 of an id written as text, modulo mod."""
    return F.crc32(col.cast("string").cast("binary")) % mod


def share_by_hash(order, rows, wanted: int):
    """Condition that leaves about four times the wanted rows of `rows`, by hash: sorts and limits after it stay small
    however many partitions the table has. Fewer rows than that all stay."""
    return F.pmod(order, F.lit(1 << 30)) < F.lit(4.0 * wanted * (1 << 30)) / rows


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column's strings; null counts as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about `limit` bytes of text each (one row at least).

    After each batch, what Arrow keeps of freed ones goes back to the system, as workers share a machine's memory with the JVM.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(name))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
        start, total = 0, 0
        for i in range(n):
            if total and total + sizes[i] > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(sizes[i]) + 64
        yield batch.slice(start, n - start)
        del batch, column, sizes
        pa.default_memory_pool().release_unused()


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, name: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over bounded slices; fn maps one slice to one record batch."""

    def run(batches):
        for part in slices(batches, name, limit):
            out = fn(part)
            del part  # not held while the next batch is read
            if out is not None:
                yield out
            del out

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node reachable from each node of the undirected edges.

    Labels fall to the least among neighbours, and then to their label's label, until none changes; the rounds grow
    with the logarithm of the longest chain in common cases. Every round is written to the shared folder.
    """
    both = materialize(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).union(edges.select(F.col(b), F.col(a))).distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = materialize(low.join(jump, "low", "left").select("node", "label", F.least("low", F.coalesce("far", "low")).alias("now")), "labels")
        discard(labels)
        labels = new.select("node", F.col("now").alias("label"))
        if new.where(F.col("label") != F.col("now")).isEmpty():
            return labels
