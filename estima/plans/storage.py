"""Tables that cut lineage: written to the shared folder, never to one machine's disk."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset and the session runs on
    one machine (a local master, as in tests) a temporary folder is set; a cluster without it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="estima-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/estima-{uuid.uuid4().hex}"


def written(df: DataFrame, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its plan is one scan and survives lost executors. Within
    scratch() the table goes at its end, unless it is to be kept."""
    path = shared_folder(df.sparkSession)
    if not keep and (tables := getattr(_open, "tables", None)) is not None:
        tables.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the cluster's own file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at the end; what is returned from it must be written with keep."""
    outer, _open.tables = getattr(_open, "tables", None), []
    try:
        yield
    finally:
        tables, _open.tables = _open.tables, outer
        for path in tables:
            remove(spark, path)
