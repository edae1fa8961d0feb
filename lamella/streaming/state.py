"""Channel state of a stream of writes: every micro-batch is folded into the stored state by the batch reducer."""

from __future__ import annotations

from lamella.operators.channels import fold
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def keep_state(writes: DataFrame, reducers: dict[str, str], path: str, checkpoint: str) -> StreamingQuery:
    """writes: a streaming table of channel writes. The state after batch n is at path/batch=n; a batch that runs again
    overwrites its own folder and starts from the one before, so every write counts once."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/batch={n - 1}") if n else None
        fold(batch, reducers, before).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return writes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
