"""Embedding rows as blobs that one task can hold."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Vectors of a shard, about.
SHARD = 4096


def usable(df: DataFrame, nonzero: bool) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, dim, vec as little-endian doubles), without vectors that take no part.

    Those are null or empty ones, those that hold a null or a number that isn't finite, rows without vec_id, and,
    where asked for, zero vectors.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        keep, data = [], []
        for i, v in enumerate(b.column("embedding").to_pylist()):
            if not v or None in v:
                continue
            x = np.array(v, "<f8")
            if np.isfinite(x).all() and (not nonzero or np.linalg.norm(x) > 0):
                keep.append(i)
                data.append(x.tobytes())
        ids = b.column("vec_id").take(pa.array(keep, pa.int32()))
        return pa.record_batch([ids, pa.array([len(d) // 8 for d in data], pa.int32()), pa.array(data, pa.binary())], names=["vec_id", "dim", "vec"])

    return map_batches(df.where("vec_id IS NOT NULL").select("vec_id", "embedding"), run, "vec_id long, dim int, vec binary")


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def sharded(vectors: DataFrame, per: int = SHARD) -> DataFrame:
    """Adds `shard` (0 to shards - 1 of each dim) and `shards`: even, whatever the vectors are."""
    sizes = vectors.groupBy("dim").count().select("dim", F.ceil(F.col("count") / per).cast("int").alias("shards"))
    return vectors.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id", "vec"), F.col("shards")).cast("int"))


def dump(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}
