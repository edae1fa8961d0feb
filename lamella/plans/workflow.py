"""Runs one workflow for all runs of a table at once.

Nodes of a layer read the same staged state. Each node is a job of its own, all of a layer at once, and its outcome is
staged: it is called once for a run and attempt, whatever reads the outcome. One shuffle folds the outcomes into the
next state, which is staged too: that is the barrier. A node that raises, takes too long, or gives no row for a run
has failed there. A run with a failed node keeps what its other nodes wrote, gets errorHandled and errorCause, and
takes no further part; its rows are in the result with status FAILED.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from lamella.functions.scalars import DEFAULT_TIMEOUT_MS, is_transient
from lamella.functions.templates import resolve
from lamella.operators.channels import Fold, fold, routed, values
from lamella.operators.staging import staged
from lamella.sources.definitions import Definition, Node, WorkflowError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a node function returns: run_id and any of the others.
OUTPUT = {"content": "string", "channel_writes": "map<string,string>", "error_class": "string", "error_message": "string", "prompt_tokens": "bigint", "completion_tokens": "bigint"}

WHITE = "".join(map(chr, range(33)))


@dataclass
class Call:
    """What a node function gets: its node and a row per live run, with run_id, context and inputs (maps of text)."""

    node: Node
    runs: DataFrame

    def prompt(self) -> tuple[Column, Column]:
        """The node's template as a column over `runs`, and whether a key is missing."""
        return resolve(self.node.prompt_template)


NodeFunction = Callable[[Call], DataFrame]


class AgentError(Exception):
    """What a node function may raise: the failure of all its runs."""


class TransientError(AgentError):
    """Worth another attempt."""


class FatalError(AgentError):
    """Not worth another attempt."""


def error_class(e: BaseException) -> str:
    """The name under which a raised error is classified: the cause of an AgentError counts where it has one."""
    known = {TransientError: "TransientException", FatalError: "FatalException", TimeoutError: "TimeoutException", ConnectionError: "IOException", OSError: "IOException"}
    for cause in (e, e.__cause__):
        for kind, name in known.items():
            if isinstance(cause, kind):
                return name
    return type(e).__name__


class Registry:
    """Node functions by name."""

    def __init__(self, functions: dict[str, NodeFunction] | None = None):
        self.functions: dict[str, NodeFunction] = {}
        for name, f in (functions or {}).items():
            self.register(name, f)

    def register(self, name: str, f: NodeFunction) -> Registry:
        if name is None or f is None:
            raise TypeError("a name and a function are needed")
        if name in self.functions:
            raise ValueError(f"{name} is registered already")
        self.functions[name] = f
        return self

    def resolve(self, name: str | None) -> NodeFunction:
        if name not in self.functions:
            raise WorkflowError(f"no node function {name!r}")
        return self.functions[name]

    def __contains__(self, name: str) -> bool:
        return name in self.functions

    def __len__(self) -> int:
        return len(self.functions)


def columns(content: Column) -> NodeFunction:
    """A node that is an expression over context and inputs."""
    return lambda call: call.runs.select("run_id", content.alias("content"))


def template(call: Call) -> DataFrame:
    """A node whose output is its resolved template; a missing key is fatal for the run."""
    text, gone = call.prompt()
    return call.runs.select("run_id", F.when(~gone, text).alias("content"), F.when(gone, "FatalException").alias("error_class"), F.when(gone, "a key of the template is missing").alias("error_message"))


def mock(call: Call) -> DataFrame:
    """A node that answers with its mock_response."""
    if call.node.mock_response is None:
        raise WorkflowError(f"node {call.node.id} has no mock_response")
    return call.runs.select("run_id", F.lit(call.node.mock_response).alias("content"))


def layer_ids(d: Definition) -> list[list[str]]:
    """Node ids by longest path from a source, each layer in the order of declaration. One definition is small."""
    into: dict[str, set[str]] = {n.id: set() for n in d.nodes}
    if unknown := {end for e in d.edges for end in e} - into.keys():
        raise WorkflowError(f"edges to or from unknown nodes {sorted(map(str, unknown))}")
    for a, b in d.edges:
        into[b].add(a)
    level: dict[str, int] = {}
    while len(level) < len(into):
        ready = [n for n, p in into.items() if n not in level and p <= level.keys()]
        if not ready:
            raise WorkflowError("the graph has a cycle")
        level |= {n: max((level[p] + 1 for p in into[n]), default=0) for n in ready}
    return [[n.id for n in d.nodes if level[n.id] == k] for k in range(max(level.values(), default=-1) + 1)]


def check(d: Definition) -> None:
    """Raises for the first broken rule of one definition."""
    if not d.nodes:
        raise WorkflowError("nodes is missing or empty")
    seen: set[str] = set()
    for n in d.nodes:
        if not n.id or not n.id.strip():
            raise WorkflowError("a node has no id")
        if n.id in seen:
            raise WorkflowError(f"node id {n.id} is repeated")
        seen.add(n.id)
    pairs: set[tuple] = set()
    for a, b in d.edges:
        if a is None or b is None:
            raise WorkflowError("an edge lacks an end")
        if a == b:
            raise WorkflowError(f"edge from {a} to itself")
        for end in (a, b):
            if end not in seen:
                raise WorkflowError(f"edge to or from unknown node {end}")
        if (a, b) in pairs:
            raise WorkflowError(f"edge {a} to {b} is repeated")
        pairs.add((a, b))
    layer_ids(d)
    if bad := [c for c, r in d.reducers.items() if not c or r is None]:
        raise WorkflowError(f"channels without a reducer: {bad}")


@dataclass
class Retry:
    """attempts in all, for transient errors; the waits between them grow by multiplier."""

    attempts: int = 3
    initial_ms: int = 1000
    multiplier: float = 2.0
    transient: Callable[[Column], Column] = is_transient

    def __post_init__(self) -> None:
        if self.attempts < 1 or self.initial_ms < 0 or self.multiplier < 1 or self.transient is None:
            raise ValueError("attempts of 1 or more, waits of 0 or more, a multiplier of 1 or more and a classifier are needed")

    def wait_ms(self, attempt: int) -> int:
        return int(self.initial_ms * self.multiplier ** (attempt - 1))


def handled(cause: Column) -> dict[str, Column]:
    """What a failed run's state gets; cause is the message of its last failure in declaration order."""
    return {"errorHandled": F.lit("true"), "errorCause": cause}


@dataclass
class Result:
    """state: run_id, channel, value, version, status. outputs: each node's outcome for a run, with its step, status,
    attempts, times. failures: run_id, super_step, n, errors (in the order of declaration)."""

    state: DataFrame
    outputs: DataFrame
    failures: DataFrame | None = None


@dataclass
class Engine:
    """sinks get (step, outputs, state) at every barrier. total_ms ends the workflow between and inside layers; node_ms is
    the timeout of nodes that have none. retry, handler: None turns them off. wraps: around every node function, the first outermost."""

    registry: Registry
    custom: dict[str, Fold] = field(default_factory=dict)
    total_ms: int | None = None
    sinks: list[Callable[[int, DataFrame, DataFrame], None]] = field(default_factory=list)
    retry: Retry | None = None
    handler: Callable[[Column], dict[str, Column]] | None = handled
    wraps: list[Callable[[NodeFunction], NodeFunction]] = field(default_factory=list)
    node_ms: int = DEFAULT_TIMEOUT_MS
    at_once: int = 20

    def run(self, d: Definition, inputs: DataFrame, done: DataFrame | None = None) -> Result:
        """inputs: run_id, channel, value; channels of the start, at version 0. A run without inputs has a null channel.

        done: outputs of an earlier run (run_id, super_step, node_id, status, content, channel_writes); a node isn't
        called again where it succeeded.
        """
        began, layers = time.monotonic(), layer_ids(d)
        nodes = {n.id: (i, n) for i, n in enumerate(d.nodes)}
        bodies = {n.id: reduce(lambda f, w: w(f), reversed(self.wraps), self.registry.resolve(n.agent)) for n in d.nodes}
        runs = staged(inputs.select("run_id").distinct(), "runs")
        given = inputs.where("channel IS NOT NULL")
        state = staged(given.select("run_id", "channel", "value", F.lit(0).cast("long").alias("version")), "state")
        start = values(given).withColumnRenamed("context", "inputs")
        live, causes, all_outputs = runs, [], []
        empty = F.create_map().cast("map<string,string>")
        for step, ids in enumerate(layers):
            self.left_ms(began, f"before layer {step}")
            seen = live.join(values(state), "run_id", "left").join(start, "run_id", "left").select("run_id", F.coalesce("context", empty).alias("context"), F.coalesce("inputs", empty).alias("inputs"))
            seen = staged(seen, "seen")
            with ThreadPoolExecutor(min(self.at_once, len(ids))) as pool:
                calls = [pool.submit(self.outcome, bodies[i], Call(nodes[i][1], seen), step, nodes[i][0], began, done) for i in ids]
            outputs = reduce(DataFrame.unionByName, (c.result() for c in calls))
            self.left_ms(began, f"inside layer {step}")
            wrong = outputs.where("status = 'FAILED'")
            message = F.coalesce("error_message", F.lit("unknown"))
            found = wrong.groupBy("run_id").agg(F.max_by(message, "node_ord").alias("cause"), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("node_ord", message.alias("m")))), lambda x: x["m"]).alias("errors"))
            cause = staged(found.withColumn("super_step", F.lit(step)), "causes")
            writes = routed(outputs.where("status = 'SUCCESS'")).drop("node_id")
            if self.handler:
                pairs = F.create_map(*(x for k, v in self.handler(F.col("cause")).items() for x in (F.lit(k), v)))
                more = cause.select("run_id", "super_step", F.lit(1 << 30).alias("node_ord"), F.posexplode(F.map_entries(pairs)).alias("write_ord", "w"))
                writes = writes.unionByName(more.select("run_id", "super_step", "node_ord", "write_ord", F.col("w.key").alias("channel"), F.col("w.value").alias("value")))
            state = staged(fold(writes, d.reducers, state, self.custom, d.types), "state")
            live = staged(live.join(cause.select("run_id"), "run_id", "left_anti"), "live")
            causes.append(cause)
            all_outputs.append(outputs)
            for sink in self.sinks:
                sink(step, outputs, state)
        if not all_outputs:
            return Result(state.withColumn("status", F.lit("SUCCESS")), runs.sparkSession.createDataFrame([], "run_id string"))
        failures = reduce(DataFrame.unionByName, causes)
        told = state.join(failures.select("run_id", F.lit("FAILED").alias("status")), "run_id", "left").withColumn("status", F.coalesce("status", F.lit("SUCCESS")))
        return Result(told, reduce(DataFrame.unionByName, all_outputs), failures.select("run_id", "super_step", "n", "errors"))

    def left_ms(self, began: float, where: str) -> int | None:
        """What is left of total_ms; none left is an error."""
        if self.total_ms is None:
            return None
        left = self.total_ms - int((time.monotonic() - began) * 1000)
        if left <= 0:
            raise TimeoutError(f"the workflow took more than {self.total_ms} ms {where}")
        return left

    def outcome(self, body: NodeFunction, call: Call, step: int, order: int, began: float, done: DataFrame | None) -> DataFrame:
        """One row for each run of the call, after all attempts."""
        known = None
        if done is not None:
            known = done.where((F.col("super_step") == step) & (F.col("node_id") == call.node.id) & (F.col("status") == "SUCCESS"))
            known = call.runs.select("run_id").join(known.select("run_id", *(F.col(c) if c in done.columns else F.lit(None).cast(t).alias(c) for c, t in OUTPUT.items())).dropDuplicates(["run_id"]), "run_id")
            call = Call(call.node, call.runs.join(known.select("run_id"), "run_id", "left_anti"))
        attempts = self.retry.attempts if self.retry else 1
        parts, rest = [], call.runs
        for k in range(1, attempts + 1):
            got = self.attempt(body, Call(call.node, rest), k, began)
            again = F.coalesce(self.retry.transient(F.col("error_class")), F.lit(False)) & F.col("error_class").isNotNull() if self.retry and k < attempts else F.lit(False)
            parts.append(got.where(~again))
            if k == attempts or got.where(again).isEmpty():
                break
            time.sleep(self.retry.wait_ms(k) / 1000)
            rest = rest.join(got.where(again).select("run_id"), "run_id", "left_semi")
        if known is not None:
            parts.append(known.withColumns({"attempts": F.lit(0), "started_at": F.lit(None).cast("timestamp"), "ended_at": F.lit(None).cast("timestamp")}))
        full = reduce(DataFrame.unionByName, parts)
        status = F.when(F.col("error_class").isNull(), "SUCCESS").otherwise("FAILED")
        return full.select("run_id", F.lit(step).alias("super_step"), F.lit(order).alias("node_ord"), F.lit(call.node.id).alias("node_id"), *OUTPUT, "attempts", "started_at", "ended_at", status.alias("status"))

    def attempt(self, body: NodeFunction, call: Call, k: int, began: float) -> DataFrame:
        """A node's rows, one for each run: no row, or more than one, is a failure, and so is whatever the node raises."""
        started = datetime.now(UTC)
        left = self.left_ms(began, f"before node {call.node.id}")
        own = timeout_of(call.node.timeout, self.node_ms)
        try:
            full = lambda df: df.select("run_id", *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in OUTPUT.items()))
            rows = call_with_timeout(call.runs, lambda _: staged(full(body(call)), "node"), own if left is None else min(own, left))
        except Exception as e:  # every error of a node is its own failure
            named = [F.lit(error_class(e)).alias("error_class"), F.lit(str(e)[:1000] or "unknown").alias("error_message")]
            rows = call.runs.select("run_id", *(F.lit(None).cast(t).alias(c) for c, t in OUTPUT.items() if not c.startswith("error")), *named).select("run_id", *OUTPUT)
        one = rows.groupBy("run_id").agg(F.count("*").alias("_n"), F.first(F.struct(*OUTPUT)).alias("_o"))
        told = call.runs.select("run_id").join(one, "run_id", "left").select("run_id", F.coalesce("_n", F.lit(0)).alias("_n"), "_o.*")
        bad = F.col("_n") != 1
        why = F.when(F.col("_n") == 0, "the node gave no output").otherwise("the node gave more than one output")
        ended = datetime.now(UTC)
        return told.withColumns({"error_class": F.when(bad, "FatalException").otherwise(F.col("error_class")), "error_message": F.when(bad, why).otherwise(F.col("error_message"))}).select(
            "run_id", *OUTPUT, F.lit(k).alias("attempts"), F.lit(started).alias("started_at"), F.lit(ended).alias("ended_at")
        )


def timeout_of(spec: str | None, default: int) -> int:
    """As scalars.timeout_ms, for one definition on the driver."""
    m = re.fullmatch(r"([+-]?[0-9]+)(ms|s|m|h)?", (spec or "").strip(WHITE).lower())
    ms = int(m[1]) * {"ms": 1, "m": 60_000, "h": 3_600_000}.get(m[2], 1000) if m else 0
    return ms if 0 < ms < 1 << 63 else default


def with_retries(f: NodeFunction, attempts: int = 3) -> NodeFunction:
    """Calls a node again for the runs whose error is transient, `attempts` times in all; the last outcome counts.

    Every attempt is staged before its runs are told apart, so a call that may differ is made once. Without waits.
    """
    if attempts < 1:
        raise ValueError("at least one attempt is needed")

    def call(c: Call) -> DataFrame:
        def full(df: DataFrame) -> DataFrame:
            return staged(df.select("run_id", *(F.col(x) if x in df.columns else F.lit(None).cast(t).alias(x) for x, t in OUTPUT.items())), "attempt")

        done = full(f(c))
        for _ in range(attempts - 1):
            again = is_transient(F.col("error_class")) & F.col("error_class").isNotNull()
            rest = c.runs.join(done.where(again).select("run_id"), "run_id", "left_semi")
            done = done.where(~F.coalesce(again, F.lit(False))).unionByName(full(f(Call(c.node, rest))))
        return done

    return call


def until_valid(f: NodeFunction, valid: Callable[[Column], Column], extra: int = 2, errors: Callable[[Column], Column] | None = None) -> NodeFunction:
    """Calls a node again where its content isn't valid, `extra` more times; what stays invalid is fatal.

    errors gives an array of what is wrong with a content; the runs of the next call have it as `feedback`. Token
    counts are those of all calls of a run.
    """
    counts = ("prompt_tokens", "completion_tokens")

    def call(c: Call) -> DataFrame:
        def full(df: DataFrame) -> DataFrame:
            return staged(df.select("run_id", "content", *(F.col(x) if x in df.columns else F.lit(None).cast("bigint").alias(x) for x in counts)), "answer")

        made = [full(f(c))]
        for _ in range(extra):
            wrong = made[-1].where(~valid(F.col("content")))
            told = wrong.select("run_id", (errors(F.col("content")) if errors else F.array().cast("array<string>")).alias("feedback"))
            made.append(full(f(Call(c.node, c.runs.drop("feedback").join(told, "run_id")))))
        ok = valid(F.col("content"))
        every = reduce(DataFrame.unionByName, (m.withColumn("k", F.lit(k)) for k, m in enumerate(made)))
        last = every.groupBy("run_id").agg(F.max_by("content", "k").alias("content"), *(F.sum(x).alias(x) for x in counts))
        wrong = F.when(~ok, F.concat_ws("; ", F.lit("the output doesn't meet the schema"), errors(F.col("content")) if errors else F.array().cast("array<string>")))
        return last.select("run_id", F.when(ok, F.col("content")).alias("content"), F.when(~ok, "FatalException").alias("error_class"), wrong.alias("error_message"), *counts)

    return call


def call_with_timeout(df: DataFrame, action: Callable[[DataFrame], object], timeout_ms: int = DEFAULT_TIMEOUT_MS) -> object:
    """Runs an action as a job of its own and cancels it after timeout_ms."""
    import threading
    import uuid

    spark, tag = df.sparkSession, f"node-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    spark.sparkContext.addJobTag(tag)
    timer = threading.Timer(timeout_ms / 1000, stop)
    timer.start()
    try:
        return action(df)
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"took more than {timeout_ms} ms") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
