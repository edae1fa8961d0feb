import time

import pytest
from pyspark.sql import functions as F

from lamella.operators import traces as T
from lamella.plans import recovery as R
from lamella.plans.workflow import Engine, Registry, Retry, TransientError, call_with_timeout, columns, mock, template, timeout_of, until_valid, with_retries
from lamella.sources.definitions import WorkflowError, parse
from lamella.streaming.state import keep_state

at = lambda c: F.try_element_at("context", F.lit(c))


def runs(spark, n=1, **inputs):
    rows = [(f"r{i}", k, v) for i in range(n) for k, v in (inputs or {None: None}).items()]
    return spark.createDataFrame(rows, "run_id string, channel string, value string")


def values(result, run="r0"):
    return {r.channel: r.value for r in result.state.where(F.col("run_id") == run).collect()}


def test_serial_and_double_fork_join(spark):
    d = parse("nodes: [" + ", ".join(f"{{id: {c}, agent: {c}}}" for c in "ABCDEFG") + "]\nedges: [" + ", ".join(f"{{from: {a}, to: {b}}}" for a, b in ("AB", "AC", "BD", "CD", "DE", "DF", "EG", "FG")) + "]")
    say = {"A": F.lit("a"), "B": F.concat(F.lit("B"), at("A")), "C": F.concat(F.lit("C"), at("A")), "D": F.concat(F.lit("D:"), at("B"), F.lit("|"), at("C")), "E": F.concat(F.lit("E"), at("D")), "F": F.concat(F.lit("F"), at("D")), "G": F.concat(F.lit("G:"), at("E"), F.lit("|"), at("F"))}
    got = values(Engine(Registry({k: columns(v) for k, v in say.items()})).run(d, runs(spark, 2)), "r1")
    assert got["G"] == "G:ED:Ba|Ca|FD:Ba|Ca"


def test_inputs_templates_and_mock(spark):
    d = parse("nodes: [{id: p, agent: t, prompt_template: 'to ${inputs.who}'}, {id: q, agent: m, mock_response: ok}, {id: z, agent: t, prompt_template: '${context.gone}'}]\nedges: [{from: p, to: z}]")
    result = Engine(Registry({"t": template, "m": mock})).run(d, runs(spark, who="Ann"))
    got = values(result)
    assert (got["p"], got["q"], got["who"], got["errorHandled"]) == ("to Ann", "ok", "Ann", "true")
    assert {r.status for r in result.state.collect()} == {"FAILED"}
    assert {(r.channel, r.version) for r in result.state.where("channel = 'who'").collect()} == {("who", 0)}


def test_a_failure_spares_siblings_and_other_runs(spark):
    d = parse("nodes: [{id: a, agent: fails}, {id: b, agent: fine}, {id: c, agent: fine}]\nedges: [{from: a, to: c}, {from: b, to: c}]")
    fails = lambda call: call.runs.select("run_id", F.when(F.col("run_id") == "r1", F.lit("ok")).alias("content"), F.when(F.col("run_id") == "r0", F.lit("FatalException")).alias("error_class"), F.lit("boom").alias("error_message"))
    result = Engine(Registry({"fails": fails, "fine": columns(F.lit("x"))})).run(d, runs(spark, 2))
    assert values(result, "r0") == {"b": "x", "errorHandled": "true", "errorCause": "boom"}
    assert values(result, "r1") == {"a": "ok", "b": "x", "c": "x"}
    assert result.outputs.where("node_id = 'c'").count() == 1


def test_registry_and_unknown_functions(spark):
    r = Registry({"a": mock})
    assert "a" in r and len(r) == 1
    with pytest.raises(ValueError, match="a"):
        r.register("a", mock)
    with pytest.raises(TypeError):
        r.register(None, mock)
    with pytest.raises(WorkflowError):
        Engine(r).run(parse("nodes: [{id: n, agent: b}]"), runs(spark))


def test_retries(spark):
    calls = []

    def flaky(kind, good_at):
        def f(call):
            calls.append(1)
            ok = len(calls) >= good_at
            return call.runs.select("run_id", F.lit("ok" if ok else None).cast("string").alias("content"), F.lit(None if ok else kind).cast("string").alias("error_class"))

        return f

    d = parse("nodes: [{id: n, agent: f}]")
    for kind, good_at, n, status in (("TransientException", 3, 3, "SUCCESS"), ("FatalException", 2, 3, "FAILED"), ("TransientException", 9, 3, "FAILED")):
        calls.clear()
        out = Engine(Registry({"f": with_retries(flaky(kind, good_at))})).run(d, runs(spark)).outputs.collect()
        assert (len(calls), [r.status for r in out]) == (n, [status])
    with pytest.raises(ValueError):
        with_retries(mock, 0)


def test_a_flaky_node_is_called_once_an_attempt(spark):
    """A node that fails at random, in Python workers: every run has one row, and no more attempts than allowed."""
    def flaky(batches):
        import random
        for b in batches:
            ok = [random.random() < 0.5 for _ in range(len(b))]
            yield b[["run_id"]].assign(content=["ok" if x else None for x in ok], error_class=[None if x else "TransientException" for x in ok])

    node = lambda c: c.runs.select("run_id").mapInPandas(flaky, "run_id string, content string, error_class string")
    d = parse("nodes: [{id: n, agent: f}, {id: m, agent: ok}]\nedges: [{from: n, to: m}]")
    for engine in (Engine(Registry({"f": node, "ok": columns(at("n"))}), retry=Retry(12, 0)), Engine(Registry({"f": with_retries(node, 12), "ok": columns(at("n"))}))):
        result = engine.run(d, runs(spark, 200))
        out = result.outputs.where("node_id = 'n'").collect()
        assert len(out) == 200 and len({r.run_id for r in out}) == 200
        good = {r.run_id for r in out if r.status == "SUCCESS"}
        assert len(good) >= 195 and all(r.content == "ok" for r in out if r.status == "SUCCESS")
        assert {r.run_id for r in result.outputs.where("node_id = 'm'").collect()} == good
        assert {r.run_id for r in result.state.where("channel = 'm' AND value = 'ok'").collect()} == good


def test_what_fails_is_a_row(spark):
    """A node that raises, one that is late, one without rows and one with two: failures of their own, siblings go on."""
    def slow(batches):
        for b in batches:
            time.sleep(30)
            yield b

    def raises(call):
        raise TransientError("no answer") from ConnectionError("down")

    bodies = {"raises": raises, "late": lambda c: c.runs.select("run_id").mapInPandas(slow, "run_id string"), "none": lambda c: c.runs.select("run_id").where("false"), "two": lambda c: c.runs.select("run_id").union(c.runs.select("run_id")), "fine": columns(F.lit("x"))}
    d = parse("nodes: [{id: a, agent: raises}, {id: b, agent: late, timeout: 500ms}, {id: c, agent: none}, {id: d, agent: two}, {id: e, agent: fine}, {id: f, agent: fine}]\nedges: [{from: a, to: f}]")
    began = time.monotonic()
    result = Engine(Registry(bodies)).run(d, runs(spark, 2))
    assert time.monotonic() - began < 25
    got = {r.node_id: (r.status, r.error_class) for r in result.outputs.where("run_id = 'r0'").collect()}
    assert got == {"a": ("FAILED", "TransientException"), "b": ("FAILED", "TimeoutException"), "c": ("FAILED", "FatalException"), "d": ("FAILED", "FatalException"), "e": ("SUCCESS", None)}
    assert [(r.n, r.errors[0]) for r in result.failures.collect()] == [(4, "no answer")] * 2
    assert values(result)["errorCause"] == "the node gave more than one output" and values(result)["e"] == "x"
    assert all(r.ended_at >= r.started_at for r in result.outputs.collect())
    with pytest.raises(TimeoutError):
        Engine(Registry(bodies), total_ms=2500).run(parse("nodes: [{id: b, agent: late}]"), runs(spark))


def test_handlers_wraps_and_retry_checks(spark):
    seen = []
    wrap = lambda name: lambda f: lambda c: (seen.append(name), f(c))[1]
    fails = lambda c: c.runs.select("run_id", F.lit("FatalException").alias("error_class"), F.lit("bad").alias("error_message"))
    d = parse("nodes: [{id: n, agent: f}]")
    engine = Engine(Registry({"f": fails}), wraps=[wrap("outer"), wrap("inner")], handler=lambda cause: {"why": F.upper(cause)})
    assert values(engine.run(d, runs(spark))) == {"why": "BAD"} and seen == ["outer", "inner"]
    assert values(Engine(Registry({"f": fails}), handler=None).run(d, runs(spark))) == {}
    for bad in ({"attempts": 0}, {"initial_ms": -1}, {"multiplier": 0.5}, {"transient": None}):
        with pytest.raises(ValueError):
            Retry(**bad)
    assert [Retry(5, 100, 1.5).wait_ms(k) for k in (1, 2, 3)] == [100, 150, 225]
    assert [timeout_of(x, 7) for x in ("120s", "2m", "500ms", "1h", "45", "abc", "0s", "-5s", "5.5s", " 7S ", None)] == [120000, 120000, 500, 3600000, 45000, 7, 7, 7, 7, 7000, 7]
    with pytest.raises(WorkflowError):
        Engine(Registry({"f": fails})).run(parse("nodes: [{id: n, agent: f}]\nedges: [{from: n, to: x}]"), runs(spark))


def test_resume_from_what_the_sink_kept(spark, tmp_path):
    calls = []
    node = lambda c: (calls.append(c.runs.count()), c.runs.select("run_id", F.create_map(F.lit("x"), F.lit("v")).alias("channel_writes")))[1]
    broken = lambda c: c.runs.select("run_id", F.when(F.col("run_id") == "r1", "c").alias("content"), F.when(F.col("run_id") == "r0", "FatalException").alias("error_class"))
    d = parse("nodes: [{id: a, agent: n}, {id: b, agent: m}]\nedges: [{from: a, to: b}]")
    Engine(Registry({"n": node, "m": broken}), sinks=[R.parquet_sink(str(tmp_path))]).run(d, runs(spark, 2))
    planned = spark.createDataFrame([(r, s, n) for r in ("r0", "r1") for s, n in ((0, "a"), (1, "b"))], "run_id string, super_step int, node_id string")
    left = R.pending(planned, spark.read.parquet(f"{tmp_path}/barriers"), spark.read.parquet(f"{tmp_path}/node_outputs"))
    assert [(r.run_id, r.node_id) for r in left.collect()] == [("r0", "b")]
    again = Engine(Registry({"n": node, "m": columns(F.concat(at("x"), F.lit("!")))})).run(d, runs(spark, 2), R.completed(spark, str(tmp_path)))
    assert calls == [2, 0]
    assert values(again) == {"x": "v", "b": "v!"} and values(again, "r1") == {"x": "v", "b": "c"}
    assert {r.attempts for r in again.outputs.where("node_id = 'a'").collect()} == {0}


def test_feedback_reaches_the_next_call(spark):
    def node(c):
        again = "feedback" in c.runs.columns
        return c.runs.select("run_id", (F.col("feedback")[0] if again else F.lit("bad")).alias("content"), F.lit(3).cast("bigint").alias("prompt_tokens"))

    f = until_valid(node, lambda c: c == "good", errors=lambda c: F.array(F.lit("good")))
    row = Engine(Registry({"f": f})).run(parse("nodes: [{id: n, agent: f}]"), runs(spark)).outputs.first()
    assert (row.content, row.status, row.prompt_tokens) == ("good", "SUCCESS", 6)


def test_until_valid(spark):
    answers = iter(["bad", "good", "good"])
    f = until_valid(lambda c: c.runs.select("run_id", F.lit(next(answers)).alias("content")), lambda c: c == "good")
    d = parse("nodes: [{id: n, agent: f}]")
    assert values(Engine(Registry({"f": f})).run(d, runs(spark))) == {"n": "good"}
    never = until_valid(lambda c: c.runs.select("run_id", F.lit("bad").alias("content")), lambda c: c == "good")
    assert "n" not in values(Engine(Registry({"f": never})).run(d, runs(spark)))


def test_timeouts(spark):
    def slow(batches):
        for b in batches:
            time.sleep(20)
            yield b

    began = time.monotonic()
    with pytest.raises(TimeoutError):
        call_with_timeout(spark.range(1).mapInPandas(slow, "id long"), lambda df: df.collect(), 500)
    assert time.monotonic() - began < 10
    assert call_with_timeout(spark.range(3), lambda df: df.count(), 60_000) == 3
    with pytest.raises(TimeoutError):
        Engine(Registry({"m": mock}), total_ms=0).run(parse("nodes: [{id: n, agent: m, mock_response: x}]"), runs(spark))


def test_sinks_and_recovery(spark, tmp_path):
    d = parse("nodes: [{id: a, agent: m, mock_response: x}, {id: b, agent: m, mock_response: y}]\nedges: [{from: a, to: b}]")
    Engine(Registry({"m": mock}), sinks=[R.parquet_sink(str(tmp_path))]).run(d, runs(spark))
    assert {(r.channel, r.super_step) for r in spark.read.parquet(f"{tmp_path}/state").collect()} == {("a", 0), ("a", 1), ("b", 1)}
    planned = spark.createDataFrame([("r", s, n) for s, n in ((0, "a"), (1, "b"), (1, "c"))], "run_id string, super_step int, node_id string")
    done = spark.createDataFrame([("r", 1, "b", "COMPLETED", "o"), ("r", 1, "c", "RUNNING", None)], "run_id string, super_step int, node_id string, status string, output string")
    assert [r.node_id for r in R.pending(planned, planned.where("super_step = 0").select("run_id", "super_step"), done).collect()] == ["c"]
    assert [r.node_id for r in R.pending(planned, planned.where("false").select("run_id", "super_step"), done).collect()] == ["a"]


def test_traces(spark):
    rows = [("r", f"n{i}", "SUCCESS" if i % 2 else "FAILED", 1, 2, None) for i in range(50)]
    t = spark.createDataFrame(rows, "run_id string, node_id string, status string, prompt_tokens long, completion_tokens long, error_class string")
    assert T.summary(t).first().asDict() == {"run_id": "r", "nodes": 50, "terminal": 50, "failed": 25, "total_tokens": 150}
    a = spark.createDataFrame([("r", 1, "transient"), ("r", 2, "ok"), ("s", 1, "fatal"), ("s", 2, "ok"), ("t", 1, "transient"), ("t", 2, "transient"), ("t", 3, "transient"), ("t", 4, "ok")], "run_id string, attempt int, outcome string")
    assert {(r.run_id, r.calls, r.status) for r in T.retried(a).collect()} == {("r", 2, "SUCCESS"), ("s", 1, "FAILED"), ("t", 3, "FAILED")}


def test_stream_of_writes(spark, tmp_path):
    one = spark.createDataFrame([("r", 0, 0, 0, "log", "a"), ("r", 0, 1, 0, "log", "b")], "run_id string, super_step int, node_ord int, write_ord int, channel string, value string")
    one.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(one.schema).parquet(str(tmp_path / "in"))
    keep_state(stream, {"log": "CONCAT"}, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    one.withColumn("value", F.lit("c")).limit(1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    keep_state(stream, {"log": "CONCAT"}, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert [(r.value, r.version) for r in spark.read.parquet(str(tmp_path / "out/batch=1")).collect()] == [("abc", 2)]
