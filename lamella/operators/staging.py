"""Tables that are computed once: written to the folder that the driver and all executors share, and read from there."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where all runs on this machine."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lamella-shared-")
        context.setCheckpointDir(found)
    return found if ":" in found else f"file://{os.path.abspath(found)}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written and read again: lineage ends there, whatever calls it holds are made once, a lost executor costs a reread."""
    path = f"{shared(df.sparkSession).rstrip('/')}/lamella-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((df.sparkSession, path))
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a staged table that nothing will read again."""
    if path := getattr(df, "_written_at", None):
        with contextlib.suppress(Exception):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        with contextlib.suppress(Exception):
            remove(spark, path)
