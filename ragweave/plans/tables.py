"""Intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A session in one process may do without; elsewhere executors could not see it."""
    conf = spark.sparkContext.getConf()
    at = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _folders.setdefault("", tempfile.mkdtemp(prefix="ragweave-"))


def _drop(jvm, conf, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: what made it, model calls included, runs once and lost executors cost nothing.

    The tables of an application share one folder, which goes when the driver's Python ends.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    application = context.applicationId
    if application not in _folders:
        _folders[application] = f"{shared_dir(spark)}/ragweave-core-{application}"
        atexit.register(_drop, context._jvm, context._jsc.hadoopConfiguration(), _folders[application])
    path = f"{_folders[application]}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
