"""Traces, token counts, log lines and diagnosis over node_traces (run_id, node_id, agent, status, prompt_tokens, completion_tokens, ...)."""

from __future__ import annotations

from functools import reduce

from lamella.functions.scalars import redacted
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens() -> Column:
    return F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))


def summary(traces: DataFrame) -> DataFrame:
    """Per run: nodes, ended ones, tokens, failures."""
    return traces.groupBy("run_id").agg(
        F.count("*").alias("nodes"),
        F.count_if(F.col("status").isin("SUCCESS", "FAILED")).alias("terminal"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.sum(tokens()).cast("bigint").alias("total_tokens"),
    )


def token_counter(calls: DataFrame) -> DataFrame:
    """Tokens per agent and model; blank names are unknown."""
    name = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown")).alias(c)
    return calls.groupBy(name("agent"), name("model")).agg(F.sum(tokens()).cast("bigint").alias("total_tokens"))


def log_lines(calls: DataFrame, prefix: str = "agent.call") -> DataFrame:
    """Two lines a call, start and end, with texts redacted; prefix begins both."""
    start = F.concat(F.lit(f"{prefix}.start prompt="), redacted(F.coalesce("prompt", F.lit(""))))
    end = F.concat(F.lit(f"{prefix}.end model="), F.coalesce("model", F.lit("unknown")), F.lit(" promptTokens="), F.coalesce("prompt_tokens", F.lit(0)).cast("string"), F.lit(" completionTokens="), F.coalesce("completion_tokens", F.lit(0)).cast("string"), F.lit(" response="), redacted(F.coalesce("response", F.lit(""))))
    return calls.select("run_id", "node_id", F.posexplode(F.array(start, end)).alias("line_no", "line"))


def retried(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Outcomes of attempts (run_id, attempt, outcome in ok, transient, fatal): cut at the first that isn't transient."""
    w = Window.partitionBy("run_id").orderBy("attempt")
    earlier = F.coalesce(F.max(F.when(F.col("outcome") != "transient", 1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    made = attempts.withColumn("n", F.row_number().over(w)).withColumn("over", earlier).where((F.col("n") <= most) & (F.col("over") == 0))
    return made.groupBy("run_id").agg(F.count("*").alias("calls"), F.when(F.max(F.when(F.col("outcome") == "ok", 1)) == 1, "SUCCESS").otherwise("FAILED").alias("status"))


def step_percentiles(durations: DataFrame, exact: bool = False) -> DataFrame:
    """Median, 95th and 99th percentile of duration_ms per node; exact ones lie between values and need them all."""
    percentile = F.percentile if exact else lambda c, p: F.percentile_approx(c, p, 10_000)
    return durations.groupBy("node_id").agg(*(percentile("duration_ms", p).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)), F.count("*").alias("n"))


def diagnosis(traces: DataFrame, times: int = 2, most_tokens: int = 100_000) -> DataFrame:
    """(run_id, finding, node_id): repeated timeouts, unusual token counts, expression failures, repeated execution."""
    where = traces.groupBy("run_id", "node_id").agg(
        F.count_if(F.col("error_class") == "TimeoutException").alias("timeouts"),
        F.sum(tokens()).alias("tokens"),
        F.count_if(F.col("error_class") == "TemplateException").alias("templates"),
        F.count_if(F.col("error_class") == "MissingChannelException").alias("missing"),
        F.count("*").alias("n"),
    )
    rules = {"repeated timeouts": F.col("timeouts") >= times, "many tokens": F.col("tokens") > most_tokens, "expression failed": F.col("templates") > 0, "channel missing": F.col("missing") > 0, "repeated execution": F.col("n") > times}
    return reduce(DataFrame.unionByName, (where.where(c).select("run_id", F.lit(name).alias("finding"), "node_id") for name, c in rules.items()))


def costs(traces: DataFrame, prices: DataFrame, budget: float) -> DataFrame:
    """Per run: cost at prices (model, prompt_price, completion_price: for 1000 tokens) and whether it is over the budget.

    Models without a price cost nothing.
    """
    one = (F.coalesce("prompt_tokens", F.lit(0)) * F.coalesce("prompt_price", F.lit(0.0)) + F.coalesce("completion_tokens", F.lit(0)) * F.coalesce("completion_price", F.lit(0.0))) / 1000
    cost = traces.join(prices, "model", "left").groupBy("run_id").agg(F.sum(one).alias("cost"))
    return cost.withColumn("over_budget", F.col("cost") > budget)


def top_tokens(traces: DataFrame, n: int = 10) -> DataFrame:
    """The n nodes with the most tokens; equal ones by name."""
    return traces.groupBy("node_id").agg(F.sum(tokens()).cast("bigint").alias("tokens")).orderBy(F.desc("tokens"), "node_id").limit(n)


def forbidden_tools(used: DataFrame, allowed: DataFrame) -> DataFrame:
    """Of the tools that nodes name (node_id, tool) those that aren't allowed (node_id, tool)."""
    return used.join(allowed, ["node_id", "tool"], "left_anti").distinct()


def version_conflicts(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Runs (run_id, workflow, version) whose version isn't the stored one (workflow, version), which may be missing."""
    kept = stored.select("workflow", F.col("version").alias("stored_version"))
    return wanted.join(kept, "workflow", "left").where(~F.col("version").eqNullSafe(F.col("stored_version")))
