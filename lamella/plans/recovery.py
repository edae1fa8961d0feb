"""Barriers and node outputs on storage, and what is left to do after a crash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parquet_sink(path: str) -> Callable[[int, DataFrame, DataFrame], None]:
    """Keeps every layer's outputs and state under a folder, each layer once; a barrier only for runs that no node failed.

    node_outputs has what `pending` and `Engine.run(done=...)` read: a success is COMPLETED, and output tells that there is one.
    """

    def sink(step: int, outputs: DataFrame, state: DataFrame) -> None:
        told = outputs.withColumn("output", F.when(F.col("status") == "SUCCESS", F.coalesce("content", F.to_json("channel_writes"), F.lit(""))))
        told = told.withColumn("status", F.when(F.col("status") == "SUCCESS", "COMPLETED").otherwise(F.col("status")))
        told.drop("super_step").write.mode("overwrite").parquet(f"{path}/node_outputs/super_step={step}")
        state.write.mode("overwrite").parquet(f"{path}/state/super_step={step}")
        barrier = outputs.groupBy("run_id").agg(F.count_if(F.col("status") == "FAILED").alias("failed")).where("failed = 0").select("run_id")
        barrier.write.mode("overwrite").parquet(f"{path}/barriers/super_step={step}")

    return sink


def completed(spark: SparkSession, path: str) -> DataFrame:
    """The successes that a sink kept, for `Engine.run(done=...)`."""
    return spark.read.parquet(f"{path}/node_outputs").where("status = 'COMPLETED'").withColumn("status", F.lit("SUCCESS"))


def next_step(runs: DataFrame, barriers: DataFrame) -> DataFrame:
    """(run_id, next_step): one behind the last barrier, 0 without one."""
    last = barriers.groupBy("run_id").agg((F.max("super_step") + 1).alias("next_step"))
    return runs.select("run_id").distinct().join(last, "run_id", "left").select("run_id", F.coalesce("next_step", F.lit(0)).alias("next_step"))


def pending(planned: DataFrame, barriers: DataFrame, outputs: DataFrame) -> DataFrame:
    """Of the nodes planned (run_id, super_step, node_id), those of the next step without a completed output."""
    due = planned.join(next_step(planned, barriers), "run_id").where("super_step = next_step").drop("next_step")
    return due.join(outputs.where("status = 'COMPLETED' AND output IS NOT NULL"), ["run_id", "super_step", "node_id"], "left_anti")


def settled(outputs: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """One row per key: the first completed one, which is final, else the latest."""
    w = Window.partitionBy(*keys).orderBy(F.when(F.col("status") == "COMPLETED", 0).otherwise(1), F.when(F.col("status") == "COMPLETED", F.col(order)).otherwise(-F.col(order)))
    return outputs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
