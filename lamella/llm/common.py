"""What the operators share: table reads, shared folders, staged tables, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch on the way to Python at most: texts are long, and a batch is in memory on both sides.
ROWS = 1000
_SHIPPED: set[str] = set()
_STAGED: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Makes this package importable by Python workers, wherever the driver started, and bounds what goes there at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS:
        spark.conf.set(key, ROWS)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="lamella-"), "lamella_pkg.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, str(Path(root.name) / p.relative_to(root)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; one of our own only where none is configured and all run on this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lamella-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else f"file://{os.path.abspath(found)}"


def remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _STAGED:
        with contextlib.suppress(Exception):
            remove(spark, path)


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/lamella-{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def again(df: DataFrame) -> DataFrame:
    """Another reading of a staged table, for joining it with itself."""
    return df.sparkSession.read.schema(df.schema).parquet(df._staged_at)


def unstage(df: DataFrame) -> None:
    with contextlib.suppress(Exception):
        remove(df.sparkSession, df._staged_at)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = ROWS) -> DataFrame:
    """Applies f to slices of at most `rows` rows of each Arrow batch."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                yield f(b.slice(at, rows))

    return df.mapInArrow(run, schema)


def rows_where(df: DataFrame, judge: Callable[[list[str]], list[bool]], rows: int = ROWS) -> DataFrame:
    """The rows of df whose text (null: empty) the judge keeps, with all columns."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array(judge(texts(b.column("text"))), pa.bool_()))

    return map_batches(df, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), rows)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8, null as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def texts(column: pa.Array) -> list[str]:
    return column.fill_null("").to_pylist()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the graph with edges a-b: every node that is not its component's smallest, and that smallest one."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        live = p != q
        if not live.any():
            break
        x, y, p, q = x[live], y[live], p[live], q[live]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (up := root[root]).tolist() != root.tolist():
            root = up
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]
