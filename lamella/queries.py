"""One query per operator, and the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import scalars as S
from lamella.functions.templates import resolve
from lamella.operators import channels as C
from lamella.operators import graph as G
from lamella.operators import traces as T
from lamella.plans import recovery as R
from lamella.plans.workflow import Engine, Registry, Retry, columns, template, until_valid
from lamella.sources.definitions import Definition, Node

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_writes(spark: SparkSession, d: str, value: str = "props", channel: str = "event_type") -> DataFrame:
    """events as channel writes: a run per user, in the order of event_id."""
    e = read(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.lit(0).alias("super_step"), F.lit(0).alias("node_ord"), F.col("event_id").alias("write_ord"), F.col(channel).alias("channel"), F.col(value).alias("value"))


@query("""SELECT user_id, CAST(round(sum(CASE WHEN event_type='purchase' THEN value ELSE 0 END), 4) AS DOUBLE) AS spend,
  CAST(count(*) FILTER (event_type='error') AS BIGINT) AS errors, arg_max_null(event_type, event_id) AS last_event,
  CASE WHEN count(*) FILTER (event_type='error') >= 15 THEN 'HIGH' WHEN sum(CASE WHEN event_type='purchase' THEN value ELSE 0 END) < 500 THEN 'MEDIUM' ELSE 'LOW' END AS rating
  FROM events GROUP BY user_id""")
def fork_join_rating(spark: SparkSession, d: str) -> DataFrame:
    """Three nodes fork over a user's events, a fourth joins their channels: one aggregation for all users."""
    spend = F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0))
    out = read(spark, d, "events").groupBy("user_id").agg(spend.alias("spend"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max_by("event_type", "event_id").alias("last_event"))
    rating = F.when(F.col("errors") >= 15, "HIGH").when(F.col("spend") < 500, "MEDIUM").otherwise("LOW")
    return out.select("user_id", F.round("spend", 4).alias("spend"), "errors", "last_event", rating.alias("rating"))


@query("""WITH n AS (SELECT user_id, count(*) FILTER (event_type='error') AS e, count(*) FILTER (event_type='purchase') AS p FROM events GROUP BY 1)
  SELECT CAST(user_id AS VARCHAR) AS run_id, unnest(['errors','purchases','rating','spread']) AS channel,
  unnest([CAST(e AS VARCHAR), CAST(p AS VARCHAR), CASE WHEN e > p THEN 'HIGH' ELSE 'LOW' END, CAST(e AS VARCHAR) || CAST(p AS VARCHAR)]) AS value,
  unnest([CAST(0 AS BIGINT), 0, 0, 1]) AS version, 'SUCCESS' AS status FROM n""")
def workflow_state(spark: SparkSession, d: str) -> DataFrame:
    """The engine itself: two nodes write their own channels and both concatenate into `spread`; a third rates."""
    counts = read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("run_id")).agg(F.count_if(F.col("event_type") == "error").cast("string").alias("errors"), F.count_if(F.col("event_type") == "purchase").cast("string").alias("purchases"))
    both = lambda name: lambda call: call.runs.join(counts, "run_id").select("run_id", F.create_map(F.lit(name), F.col(name), F.lit("spread"), F.col(name)).alias("channel_writes"))
    at = lambda c: F.try_element_at("context", F.lit(c)).cast("bigint")
    registry = Registry({"errors": both("errors"), "purchases": both("purchases"), "rate": columns(F.when(at("errors") > at("purchases"), "HIGH").otherwise("LOW"))})
    w = Definition([Node("errors", "errors"), Node("purchases", "purchases"), Node("rating", "rate")], [("errors", "rating"), ("purchases", "rating")], {"spread": "CONCAT"})
    runs = counts.select("run_id", F.lit(None).cast("string").alias("channel"), F.lit(None).cast("string").alias("value"))
    return Engine(registry).run(w, runs).state.select("run_id", "channel", "value", "version", "status")


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS channel, arg_max_null(props, event_id) AS value FROM events GROUP BY 1, 2")
def reducer_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return event_writes(spark, d).groupBy("run_id", "channel").agg(C.overwritten().alias("value"))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, string_agg(event_type, '' ORDER BY event_id) AS value FROM events GROUP BY 1")
def reducer_concat_string(spark: SparkSession, d: str) -> DataFrame:
    return event_writes(spark, d, "event_type").groupBy("run_id").agg(C.concatenated().alias("value"))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(to_json(list(event_type ORDER BY event_id)) AS VARCHAR) AS value FROM events GROUP BY 1")
def reducer_concat_list(spark: SparkSession, d: str) -> DataFrame:
    return event_writes(spark, d, "event_type").groupBy("run_id").agg(F.to_json(C.listed()).alias("value"))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS channel, max(value) AS value FROM events GROUP BY 1, 2")
def reducer_max(spark: SparkSession, d: str) -> DataFrame:
    return C.greatest_write(event_writes(spark, d, "value"))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, string_agg(event_type, '+' ORDER BY event_id) AS value FROM events GROUP BY 1")
def reducer_custom_join(spark: SparkSession, d: str) -> DataFrame:
    return event_writes(spark, d, "event_type").groupBy("run_id").agg(C.folded(lambda a, b: F.concat(a, F.lit("+"), b)).alias("value"))


@query("SELECT event_id, event_type AS channel, CASE event_type WHEN 'click' THEN 'CONCAT' WHEN 'purchase' THEN 'MAX' ELSE 'OVERWRITE' END AS reducer FROM events")
def reducer_default(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.col("event_type").alias("channel"), C.reducer_of({"click": "CONCAT", "purchase": "MAX"}, "event_type").alias("reducer"))


@query("""SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS channel, CAST(count(*) - 1 AS BIGINT) AS version,
  CASE event_type WHEN 'click' THEN string_agg(props, '' ORDER BY event_id) ELSE arg_max_null(props, event_id) END AS value FROM events GROUP BY 1, 2""")
def channel_state(spark: SparkSession, d: str) -> DataFrame:
    """All channels of all runs folded in one shuffle, each by its own reducer."""
    return C.fold(event_writes(spark, d), {"click": "CONCAT", "view": "OVERWRITE"}).select("run_id", "channel", "version", "value")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS BIGINT) AS version FROM events")
def channel_version(spark: SparkSession, d: str) -> DataFrame:
    return C.versions(event_writes(spark, d)).select(F.col("write_ord").alias("event_id"), "version")


@query("""SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(to_json(list(event_type || '=' || n ORDER BY event_type)) AS VARCHAR) AS context FROM
  (SELECT user_id, event_type, CAST(count(*) AS VARCHAR) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def final_context(spark: SparkSession, d: str) -> DataFrame:
    state = read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("channel")).agg(F.count("*").cast("string").alias("value"))
    pairs = F.array_sort(F.transform(F.map_entries("context"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return C.values(state).select("run_id", F.to_json(pairs).alias("context"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS run_id, CAST(turn AS INTEGER) AS node_ord, CASE WHEN role='system' THEN 'rules' ELSE role END AS channel, text AS value
  FROM conversations WHERE text IS NOT NULL""")
def write_routing(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").where("text IS NOT NULL")
    given = F.when(F.col("role") == "system", F.create_map(F.lit("rules"), F.col("text")))
    out = C.routed(c.select(F.col("conv_id").cast("string").alias("run_id"), F.lit(0).alias("super_step"), F.col("turn").cast("int").alias("node_ord"), F.col("role").alias("node_id"), F.col("text").alias("content"), given.alias("channel_writes")))
    return out.select("run_id", "node_ord", "channel", "value")


def turn_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A graph per conversation: a node per turn, an edge to the next."""
    c = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("workflow"), "turn").distinct()
    nodes = c.select("workflow", F.col("turn").cast("int").alias("node_ord"), F.col("turn").cast("string").alias("node_id"))
    after = c.select("workflow", (F.col("turn") - 1).alias("turn"))
    edges = c.join(after, ["workflow", "turn"]).select("workflow", F.col("turn").cast("int").alias("edge_ord"), F.col("turn").cast("string").alias("src"), (F.col("turn") + 1).cast("string").alias("dst"))
    return nodes, edges


@query("""WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations),
  l AS (SELECT conv_id, turn, 0 AS s FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.conv_id=a.conv_id AND b.turn=a.turn-1)
        UNION ALL SELECT t.conv_id, t.turn, l.s+1 FROM l JOIN t ON t.conv_id=l.conv_id AND t.turn=l.turn+1)
  SELECT CAST(conv_id AS VARCHAR) AS workflow, CAST(turn AS VARCHAR) AS node_id, CAST(max(s) AS INTEGER) AS super_step FROM l GROUP BY 1, 2""")
def dag_levels(spark: SparkSession, d: str) -> DataFrame:
    return G.layers(*turn_graph(spark, d)).select("workflow", "node_id", "super_step")


@query("SELECT * FROM (VALUES ('g', 'b'), ('g', 'c'), ('g', 'd')) t(workflow, node_id)")
def dag_cycle_nodes(spark: SparkSession, d: str) -> DataFrame:
    """b and c are a cycle, d is behind it."""
    nodes = spark.createDataFrame([("g", i, n) for i, n in enumerate("abcd")], "workflow string, node_ord int, node_id string")
    edges = spark.createDataFrame([("g", i, a, b) for i, (a, b) in enumerate(["ab", "bc", "cb", "cd"])], "workflow string, edge_ord int, src string, dst string")
    return G.cyclic(nodes, edges)


def supply_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One graph with an edge per order line from its part to its supplier."""
    s, p, line = (read(spark, d, t) for t in ("supplier", "part", "lineitem"))
    ids = p.select(F.concat(F.lit("p"), "p_partkey").alias("node_id")).unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("node_id")))
    nodes = ids.select(F.lit("supply").alias("workflow"), F.lit(0).alias("node_ord"), "node_id")
    edges = line.select(F.lit("supply").alias("workflow"), F.col("l_linenumber").alias("edge_ord"), F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return s.select(F.lit("supply").alias("workflow")).limit(1), nodes, edges


@query("""WITH e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem),
  n AS (SELECT 'p' || p_partkey AS id FROM part UNION SELECT 's' || s_suppkey FROM supplier)
  SELECT 'edge to an unknown node' AS rule, dst AS item FROM e WHERE dst NOT IN (SELECT id FROM n)
  UNION ALL SELECT 'edge from an unknown node', src FROM e WHERE src NOT IN (SELECT id FROM n)
  UNION ALL SELECT 'repeated edge', src || ' -> ' || dst FROM e GROUP BY src, dst HAVING count(*) > 1""")
def graph_violations(spark: SparkSession, d: str) -> DataFrame:
    """All broken rules of a graph with many edges."""
    workflows, nodes, edges = supply_graph(spark, d)
    none = spark.createDataFrame([], "workflow string, channel string, reducer string")
    return G.violations(workflows, nodes, edges, none).select("rule", "item")


@query("SELECT * FROM (VALUES (3, 'node without id', '1'), (4, 'repeated node id', 'a'), (5, 'edge without an end', '2'), (6, 'edge to itself', 'b'), (9, 'cycle', 'b'), (10, 'channel without a reducer', 'x')) t(rule_order, rule, item)")
def definition_rules(spark: SparkSession, d: str) -> DataFrame:
    nodes = spark.createDataFrame([("w", 0, "a"), ("w", 1, " "), ("w", 2, "a"), ("w", 3, "b")], "workflow string, node_ord int, node_id string")
    edges = spark.createDataFrame([("w", 0, "a", "b"), ("w", 1, "b", "b"), ("w", 2, None, "b")], "workflow string, edge_ord int, src string, dst string")
    channels = spark.createDataFrame([("w", "x", None), ("w", "y", "MAX")], "workflow string, channel string, reducer string")
    return G.violations(nodes.select("workflow"), nodes, edges, channels).select("rule_order", "rule", "item")


@query("""SELECT r_name AS node_id, CAST(to_json(list(n_name ORDER BY n_nationkey)) AS VARCHAR) AS successors, CAST(count(*) AS BIGINT) AS n FROM region JOIN nation ON r_regionkey=n_regionkey GROUP BY 1""")
def adjacency_lists(spark: SparkSession, d: str) -> DataFrame:
    r, n = read(spark, d, "region"), read(spark, d, "nation")
    nodes = r.select(F.lit("w").alias("workflow"), F.col("r_name").alias("node_id"))
    edges = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.lit("w").alias("workflow"), F.col("n_nationkey").alias("edge_ord"), F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    return G.successors(nodes, edges).select("node_id", F.to_json("successors").alias("successors"), F.size("successors").cast("bigint").alias("n"))


@query("""SELECT 'supply' AS workflow, 's' || s_suppkey AS node_id, CAST(count(l_suppkey) AS BIGINT) AS in_degree FROM supplier LEFT JOIN lineitem ON s_suppkey=l_suppkey GROUP BY s_suppkey
  UNION ALL SELECT 'supply', 'p' || p_partkey, 0 FROM part""")
def in_degrees(spark: SparkSession, d: str) -> DataFrame:
    _, nodes, edges = supply_graph(spark, d)
    return G.in_degree(nodes, edges)


@query("""SELECT 'supply' AS workflow, 'p' || p_partkey AS node_id, CAST(0 AS BIGINT) AS in_degree FROM part
  UNION ALL SELECT 'supply', 's' || s_suppkey, CAST(count(l_suppkey) AS BIGINT) FROM supplier LEFT JOIN lineitem ON s_suppkey=l_suppkey GROUP BY s_suppkey""")
def in_degrees_all(spark: SparkSession, d: str) -> DataFrame:
    """Every part and every supplier is a node."""
    p, s = read(spark, d, "part"), read(spark, d, "supplier")
    ids = p.select(F.concat(F.lit("p"), "p_partkey").alias("node_id")).unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("node_id")))
    return G.in_degree(ids.select(F.lit("supply").alias("workflow"), "node_id"), supply_graph(spark, d)[2])


@query("SELECT conv_id, turn, 'role=' || coalesce(role, '') || ', text=' || coalesce(text, '') || ', k=' || CASE WHEN turn > 2 THEN 'late' ELSE 'early' END AS prompt FROM conversations")
def template_resolve(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").withColumns({"context": F.create_map(F.lit("role"), F.col("role"), F.lit("turn"), F.col("turn").cast("string")), "inputs": F.create_map(F.lit("text"), F.col("text"))})
    text, _ = resolve("role=${context.role}, text=${inputs.text}, k=${context.turn > 2 ? 'late' : 'early'}")
    return c.select("conv_id", "turn", text.alias("prompt"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '{\"a\": ' || doc_id || '}' WHEN doc_id % 3 = 1 THEN '{\"b\":1}' ELSE 'none here' END AS json FROM documents")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    answer = F.when(k == 0, F.concat(F.lit('Sure.\n```json\n{"a": '), "doc_id", F.lit("}\n```\nDone."))).when(k == 1, F.lit('text {"b":1} tail')).otherwise(F.lit("  none here "))
    return read(spark, d, "documents").select("doc_id", S.json_text(answer).alias("json"))


@query("SELECT event_id, coalesce(json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 60, false) AS valid FROM events")
def json_schema_valid(spark: SparkSession, d: str) -> DataFrame:
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 60}}}
    return read(spark, d, "events").select("event_id", S.json_valid(F.col("props"), schema).alias("valid"))


@query("SELECT * FROM (VALUES ('120s', 120000), ('2m', 120000), ('500ms', 500), ('1h', 3600000), ('45', 45000), ('abc', 120000), ('0s', 120000), ('-5s', 120000), ('5.5s', 120000), (' 7S ', 7000)) t(spec, ms)".replace("(spec, ms)", "(spec, ms0)").replace("SELECT *", "SELECT spec, CAST(ms0 AS BIGINT) AS ms"))
def timeout_parse(spark: SparkSession, d: str) -> DataFrame:
    specs = ["120s", "2m", "500ms", "1h", "45", "abc", "0s", "-5s", "5.5s", " 7S "]
    return spark.createDataFrame([(s,) for s in specs], "spec string").select("spec", S.timeout_ms(F.col("spec")).alias("ms"))


@query("SELECT CAST(i AS BIGINT) AS attempt, CAST(floor(1000 * pow(1.5, i - 1)) AS BIGINT) AS wait_ms FROM range(1, 6) t(i)")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 6).select(F.col("id").alias("attempt"), S.backoff_ms(F.col("id"), 1000, 1.5).alias("wait_ms"))


@query("SELECT event_id, CAST(greatest(0, 50 - event_id % 100) AS BIGINT) AS left_ms FROM events")
def workflow_remaining(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", S.remaining_ms(F.col("event_id") % 100, 50).alias("left_ms"))


@query("""SELECT event_id, event_type IN ('error', 'click', 'signup') AS is_transient FROM events""")
def error_classify(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    name = F.when(e == "error", "java.net.ConnectException").when(e == "click", "java.util.concurrent.TimeoutException").when(e == "signup", "TransientException").when(e == "view", "FatalException")
    return read(spark, d, "events").select("event_id", S.is_transient(name).alias("is_transient"))


@query("""WITH a AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'transient' WHEN 'click' THEN 'transient' WHEN 'signup' THEN 'fatal' ELSE 'ok' END AS o,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  b AS (SELECT *, coalesce(max(CASE WHEN o <> 'transient' THEN 1 END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop FROM a)
  SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(count(*) AS BIGINT) AS calls, CASE WHEN max(CASE WHEN o = 'ok' THEN 1 END) = 1 THEN 'SUCCESS' ELSE 'FAILED' END AS status
  FROM b WHERE n <= 3 AND stop = 0 GROUP BY 1""")
def retry_outcome(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    outcome = F.when(e.isin("error", "click"), "transient").when(e == "signup", "fatal").otherwise("ok")
    return T.retried(read(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("attempt"), outcome.alias("outcome")))


@query("""WITH f AS (SELECT user_id, min(event_id % 5) AS step FROM events WHERE event_type='error' AND value > 90 GROUP BY 1)
  SELECT e.event_id FROM events e LEFT JOIN f USING (user_id) WHERE f.step IS NULL OR e.event_id % 5 <= f.step""")
def failure_abort(spark: SparkSession, d: str) -> DataFrame:
    """Steps behind a run's first failed one don't run; the failed step itself is finished."""
    e = read(spark, d, "events").withColumn("step", F.col("event_id") % 5)
    first = e.where("event_type = 'error' AND value > 90").groupBy("user_id").agg(F.min("step").alias("failed_step"))
    return e.join(first, "user_id", "left").where("failed_step IS NULL OR step <= failed_step").select("event_id")


def event_traces(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("node_id"), F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "RUNNING").otherwise("SUCCESS").alias("status"), k.alias("prompt_tokens"), F.length("event_type").cast("bigint").alias("completion_tokens"), F.when(F.col("event_type") == "error", "TimeoutException").alias("error_class"))


@query("""SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(count(*) AS BIGINT) AS nodes, CAST(count(*) FILTER (event_type <> 'signup') AS BIGINT) AS terminal,
  CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failed, CAST(sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) + length(event_type)) AS BIGINT) AS total_tokens FROM events GROUP BY 1""")
def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    return T.summary(event_traces(spark, d))


@query("""WITH n AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS node_id, count(*) AS n, sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) + length(event_type)) AS t FROM events GROUP BY 1, 2)
  SELECT run_id, 'repeated timeouts' AS finding, node_id FROM n WHERE node_id = 'error' AND n >= 2
  UNION ALL SELECT run_id, 'many tokens', node_id FROM n WHERE t > 1000 UNION ALL SELECT run_id, 'repeated execution', node_id FROM n WHERE n > 2""")
def diagnose(spark: SparkSession, d: str) -> DataFrame:
    return T.diagnosis(event_traces(spark, d), 2, 1000)


@query("""SELECT role AS agent, 'unknown' AS model, CAST(sum(length(text) - length(replace(text, ' ', '')) + 1) AS BIGINT) AS total_tokens FROM conversations GROUP BY 1""")
def token_counter(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    return T.token_counter(read(spark, d, "conversations").select(F.col("role").alias("agent"), F.lit(" ").alias("model"), n.alias("prompt_tokens"), F.lit(None).cast("bigint").alias("completion_tokens")))


@query("""SELECT CAST(conv_id AS VARCHAR) AS run_id, CAST(turn AS VARCHAR) AS node_id, unnest([0, 1]) AS line_no,
  unnest(['agent.call.start prompt=' || text, 'agent.call.end model=' || role || ' promptTokens=' || length(text) || ' completionTokens=0 response=sk-***']) AS line FROM conversations""")
def log_lines(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return T.log_lines(c.select(F.col("conv_id").cast("string").alias("run_id"), F.col("turn").cast("string").alias("node_id"), F.col("text").alias("prompt"), F.col("role").alias("model"), F.length("text").alias("prompt_tokens"), F.lit(None).cast("int").alias("completion_tokens"), F.lit("sk-12345").alias("response")))


@query("SELECT doc_id, CAST(length(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '***', 'g')) AS INTEGER) AS n, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '***', 'g')) AS digest FROM documents")
def redact(spark: SparkSession, d: str) -> DataFrame:
    out = S.redacted(F.col("text"), "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "***")
    return read(spark, d, "documents").select("doc_id", F.length(out).alias("n"), F.md5(out).alias("digest"))


@query("""SELECT event_type AS node_id, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def step_durations(spark: SparkSession, d: str) -> DataFrame:
    found = T.step_percentiles(read(spark, d, "events").select(F.col("event_type").alias("node_id"), F.col("value").alias("duration_ms")), exact=True)
    return found.select("node_id", "n", *(F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")))


@query("""SELECT event_type AS node_id, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def step_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The exact percentiles."""
    found = T.step_percentiles(read(spark, d, "events").select(F.col("event_type").alias("node_id"), F.col("value").alias("duration_ms")), exact=True)
    return found.select("node_id", *(F.round(p, 6).alias(p) for p in ("p50", "p95", "p99")), "n")


@query("SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '***', 'g') AS text FROM documents")
def redacted_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", S.redacted(F.col("text"), "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "***").alias("text"))


@query("""WITH b AS (SELECT user_id, max(event_id % 4) + 1 AS nxt FROM events WHERE event_type='purchase' AND event_id % 4 < 2 GROUP BY 1)
  SELECT DISTINCT CAST(e.user_id AS VARCHAR) AS run_id, CAST(e.event_id % 4 AS INTEGER) AS super_step, e.event_type AS node_id FROM events e LEFT JOIN b USING (user_id)
  WHERE e.event_id % 4 = coalesce(b.nxt, 0) AND NOT EXISTS (SELECT 1 FROM events o WHERE o.user_id=e.user_id AND o.event_id % 4 = e.event_id % 4 AND o.event_type=e.event_type AND o.value > 50)""")
def recovery_pending(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), (F.col("event_id") % 4).cast("int").alias("super_step"), F.col("event_type").alias("node_id"), "value")
    barriers = e.where("node_id = 'purchase' AND super_step < 2").select("run_id", "super_step")
    outputs = e.where("value > 50").select("run_id", "super_step", "node_id", F.lit("COMPLETED").alias("status"), F.lit("x").alias("output"))
    return R.pending(e.select("run_id", "super_step", "node_id").distinct(), barriers, outputs)


@query("""WITH o AS (SELECT *, CASE WHEN value > 50 THEN 'COMPLETED' ELSE 'RUNNING' END AS status FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN status='COMPLETED' THEN 0 ELSE 1 END, CASE WHEN status='COMPLETED' THEN event_id ELSE -event_id END) AS n FROM o)
  SELECT user_id, event_type, event_id, status FROM r WHERE n = 1""")
def node_output_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "events").withColumn("status", F.when(F.col("value") > 50, "COMPLETED").otherwise("RUNNING"))
    return R.settled(o, ("user_id", "event_type"), "event_id").select("user_id", "event_type", "event_id", "status")


def user_runs(spark: SparkSession, d: str) -> DataFrame:
    """A run for each user, without inputs."""
    users = read(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id")).distinct()
    return users.select("run_id", F.lit(None).cast("string").alias("channel"), F.lit(None).cast("string").alias("value"))


def in_context(channel: str) -> F.Column:
    return F.try_element_at("context", F.lit(channel))


@query("""WITH n AS (SELECT user_id, count(*) FILTER (event_type='error') AS e, count(*) FILTER (event_type='purchase') AS p, arg_max_null(event_type, event_id) AS l FROM events GROUP BY 1)
  SELECT CAST(user_id AS VARCHAR) AS run_id, unnest(['errors','purchases','last','rating']) AS channel,
  unnest([CAST(e AS VARCHAR), CAST(p AS VARCHAR), l, CASE WHEN e >= 15 THEN 'HIGH' WHEN p < 5 THEN 'MEDIUM' ELSE 'LOW' END]) AS value FROM n""")
def fork_join_engine(spark: SparkSession, d: str) -> DataFrame:
    """The engine: three nodes fork over a user's events, a fourth joins their channels."""
    e = read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("run_id")).agg(F.count_if(F.col("event_type") == "error").cast("string").alias("errors"), F.count_if(F.col("event_type") == "purchase").cast("string").alias("purchases"), F.max_by("event_type", "event_id").alias("last"))
    own = lambda c: lambda call: call.runs.join(e, "run_id").select("run_id", F.col(c).alias("content"))
    rating = F.when(in_context("errors").cast("bigint") >= 15, "HIGH").when(in_context("purchases").cast("bigint") < 5, "MEDIUM").otherwise("LOW")
    names = ("errors", "purchases", "last")
    w = Definition([*(Node(c, c) for c in names), Node("rating", "rate")], [(c, "rating") for c in names])
    return Engine(Registry({**{c: own(c) for c in names}, "rate": columns(rating)})).run(w, user_runs(spark, d)).state.select("run_id", "channel", "value")


@query("""WITH u AS (SELECT DISTINCT user_id, user_id % 5 AS need FROM events)
  SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(least(need + 1, 3) AS INTEGER) AS attempts, CASE WHEN need < 3 THEN 'SUCCESS' ELSE 'FAILED' END AS status,
  CASE WHEN need < 3 THEN 'ok' END AS content, CASE WHEN need >= 3 THEN 'TransientException' END AS error_class FROM u""")
def retry_engine(spark: SparkSession, d: str) -> DataFrame:
    """A node that is well again after some attempts, a number that depends on the run; three attempts at most."""
    calls = []

    def node(call):
        calls.append(1)
        ok = F.col("run_id").cast("bigint") % 5 < len(calls)
        return call.runs.select("run_id", F.when(ok, "ok").alias("content"), F.when(~ok, "TransientException").alias("error_class"))

    out = Engine(Registry({"n": node}), retry=Retry(3, 0)).run(Definition([Node("n", "n")], []), user_runs(spark, d)).outputs
    return out.select("run_id", "attempts", "status", "content", "error_class")


@query("""WITH n AS (SELECT user_id, count(*) FILTER (event_type='error') >= 15 AS bad FROM events GROUP BY 1)
  SELECT CAST(user_id AS VARCHAR) AS run_id, unnest(CASE WHEN bad THEN ['b','errorCause','errorHandled'] ELSE ['a','b','c'] END) AS channel,
  unnest(CASE WHEN bad THEN ['fine','many errors','true'] ELSE ['ok','fine','end'] END) AS value, CASE WHEN bad THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM n""")
def abort_engine(spark: SparkSession, d: str) -> DataFrame:
    """A node fails for some runs: its sibling's write stays, the failure is told, the next layer doesn't run."""
    e = read(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("run_id")).agg((F.count_if(F.col("event_type") == "error") >= 15).alias("bad"))
    node = lambda call: call.runs.join(e, "run_id").select("run_id", F.when(~F.col("bad"), "ok").alias("content"), F.when(F.col("bad"), "FatalException").alias("error_class"), F.when(F.col("bad"), "many errors").alias("error_message"))
    w = Definition([Node("a", "a"), Node("b", "b"), Node("c", "c")], [("a", "c"), ("b", "c")])
    engine = Engine(Registry({"a": node, "b": columns(F.lit("fine")), "c": columns(F.lit("end"))}))
    return engine.run(w, user_runs(spark, d)).state.select("run_id", "channel", "value", "status")


@query("""SELECT CAST(user_id AS VARCHAR) AS run_id, CAST(0 AS INTEGER) AS super_step, CAST(2 AS BIGINT) AS n, '["no output of a","b is down"]' AS errors FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0)
  UNION ALL SELECT CAST(user_id AS VARCHAR), 0, 1, '["b is down"]' FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 1)""")
def failure_list(spark: SparkSession, d: str) -> DataFrame:
    """All failures of a layer, in the order of declaration; one node raises, for all runs."""
    odd = F.col("run_id").cast("bigint") % 2 == 1

    def down(call):
        raise ValueError("b is down")

    node = lambda call: call.runs.select("run_id", F.when(odd, "x").alias("content"), F.when(~odd, "FatalException").alias("error_class"), F.lit("no output of a").alias("error_message"))
    failures = Engine(Registry({"a": node, "b": down})).run(Definition([Node("a", "a"), Node("b", "b")], []), user_runs(spark, d)).failures
    return failures.select("run_id", "super_step", "n", F.to_json("errors").alias("errors"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS run_id, 'Dear ' || c_name || ' of ' || c_mktsegment AS letter, 1 AS shown FROM customer""")
def workflow_inputs(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of a run reach a template; a second node reads what the first wrote."""
    c = read(spark, d, "customer")
    given = c.select(F.col("c_custkey").cast("string").alias("run_id"), F.explode(F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment")).alias("channel", "value"))
    w = Definition([Node("greeting", "t", "Dear ${inputs.name}"), Node("letter", "t", "${context.greeting} of ${inputs.segment}")], [("greeting", "letter")])
    state = Engine(Registry({"t": template})).run(w, given).state
    return state.where("channel = 'letter'").select("run_id", F.col("value").alias("letter"), F.lit(1).alias("shown"))


@query("""SELECT CAST(user_id AS VARCHAR) AS run_id, CASE WHEN k < 3 THEN 'SUCCESS' ELSE 'FAILED' END AS status, CASE WHEN k < 3 THEN '{"k":' || k || '}' END AS content, CAST(30 AS BIGINT) AS prompt_tokens
  FROM (SELECT DISTINCT user_id, user_id % 4 AS k FROM events)""")
def regenerate_loop(spark: SparkSession, d: str) -> DataFrame:
    """Answers that don't meet the schema are asked for again with what was wrong, two more times; tokens are those of all calls."""
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 2}}}

    def node(call):
        k = F.col("run_id").cast("bigint") % 4
        told = F.array_join("feedback", ";") if "feedback" in call.runs.columns else F.lit("")
        answer = F.when(F.length(told) == 0, "none").when(told.contains("not JSON"), "{}").otherwise(F.concat(F.lit('{"k":'), k, F.lit("}")))
        return call.runs.select("run_id", answer.alias("content"), F.lit(10).cast("bigint").alias("prompt_tokens"))

    f = until_valid(node, lambda c: S.json_valid(c, schema), errors=lambda c: S.json_errors(c, schema))
    return Engine(Registry({"n": f})).run(Definition([Node("n", "n")], []), user_runs(spark, d)).outputs.select("run_id", "status", "content", "prompt_tokens")


@query("""WITH w AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'x' ELSE CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) END AS v FROM events),
  o AS (SELECT *, max(CASE WHEN TRY_CAST(v AS BIGINT) IS NULL THEN event_id END) OVER (PARTITION BY user_id, event_type) AS odd FROM w)
  SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS channel, CASE WHEN count(*) FILTER (odd IS NULL OR event_id > odd) = 0 THEN arg_max_null(v, event_id)
  ELSE CAST(max(CAST(CASE WHEN odd IS NULL OR event_id > odd THEN v END AS BIGINT)) AS VARCHAR) END AS value FROM o GROUP BY 1, 2""")
def reducer_max_odd(spark: SparkSession, d: str) -> DataFrame:
    """MAX in the engine's fold, with nulls and text between the numbers."""
    k = F.get_json_object("props", "$.k")
    e = read(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, "x").otherwise(k))
    w = e.select(F.col("user_id").cast("string").alias("run_id"), F.lit(0).alias("super_step"), F.lit(0).alias("node_ord"), F.col("event_id").alias("write_ord"), F.col("event_type").alias("channel"), F.col("v").alias("value"))
    return C.fold(w, dict.fromkeys(("view", "click", "purchase", "signup", "error"), "MAX")).select("run_id", "channel", "value")


@query("""SELECT CAST(user_id AS VARCHAR) AS run_id, '[' || string_agg(CASE WHEN event_id % 3 = 0 THEN event_id || ',' || event_id + 1 ELSE '"' || event_type || '"' END, ',' ORDER BY event_id) || ']' AS value
  FROM (SELECT -1 AS event_id, user_id, 'start' AS event_type FROM events GROUP BY 2 UNION ALL SELECT event_id, user_id, event_type FROM events) t WHERE event_id >= 0 GROUP BY 1""")
def reducer_concat_typed(spark: SparkSession, d: str) -> DataFrame:
    """CONCAT of lists and scalars into one flat list, begun as an empty list."""
    e = read(spark, d, "events")
    v = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), "event_id", F.lit(","), F.col("event_id") + 1, F.lit("]"))).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    w = e.select(F.col("user_id").cast("string").alias("run_id"), F.lit(0).alias("super_step"), F.lit(0).alias("node_ord"), F.col("event_id").alias("write_ord"), F.lit("log").alias("channel"), v.alias("value"))
    before = w.select("run_id", "channel").distinct().select("run_id", "channel", F.lit("[]").alias("value"), F.lit(0).cast("long").alias("version"))
    return C.fold(w, {"log": "CONCAT"}, before, types={"log": "list"}).select("run_id", "value")


@query("""SELECT n_name AS node_id, CAST(to_json([r_name]) AS VARCHAR) AS predecessors FROM region JOIN nation ON r_regionkey=n_regionkey""")
def predecessor_lists(spark: SparkSession, d: str) -> DataFrame:
    r, n = read(spark, d, "region"), read(spark, d, "nation")
    edges = r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).select(F.lit("w").alias("workflow"), F.col("n_nationkey").alias("edge_ord"), F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    return G.predecessors(n.select(F.lit("w").alias("workflow"), F.col("n_name").alias("node_id")), edges).select("node_id", F.to_json("predecessors").alias("predecessors"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS workflow, CAST(turn AS VARCHAR) AS node_id FROM (SELECT DISTINCT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE m >= 2 AND turn >= 1""")
def conversation_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Conversations whose last turn leads back to turn 1: all but turn 0 lie on the cycle."""
    nodes, edges = turn_graph(spark, d)
    last = nodes.groupBy("workflow").agg(F.max("node_ord").alias("m")).where("m >= 2")
    back = last.select("workflow", F.lit(-1).alias("edge_ord"), F.col("m").cast("string").alias("src"), F.lit("1").alias("dst"))
    return G.cyclic(nodes, edges.unionByName(back))


@query("""WITH e AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)
  SELECT 'supply' AS workflow, 8 AS rule_order, 'repeated edge' AS rule, src || ' -> ' || dst AS item FROM e GROUP BY src, dst HAVING count(*) > 1
  UNION ALL SELECT 'supply', 7, 'edge from an unknown node', src FROM e WHERE src LIKE 'c%' UNION ALL SELECT 'supply', 7, 'edge to an unknown node', dst FROM e WHERE dst LIKE 'n%'""")
def supply_violations(spark: SparkSession, d: str) -> DataFrame:
    """Every part and supplier is a node, customers and nations are none, though edges name them."""
    p, s, c, line = (read(spark, d, t) for t in ("part", "supplier", "customer", "lineitem"))
    tag = lambda letter, column: F.concat(F.lit(letter), column)
    ids = p.select(tag("p", "p_partkey").alias("node_id")).unionByName(s.select(tag("s", "s_suppkey").alias("node_id")))
    ends = line.select(tag("p", "l_partkey").alias("src"), tag("s", "l_suppkey").alias("dst")).unionByName(c.select(tag("c", "c_custkey").alias("src"), tag("n", "c_nationkey").alias("dst")))
    w = F.lit("supply").alias("workflow")
    none = spark.createDataFrame([], "workflow string, channel string, reducer string")
    return G.violations(ids.select(w).distinct(), ids.select(w, F.lit(0).alias("node_ord"), "node_id"), ends.select(w, F.lit(0).alias("edge_ord"), "src", "dst"), none)


@query("""WITH n AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_type AS node_id, count(*) AS n, sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) + length(event_type)) AS t FROM events GROUP BY 1, 2)
  SELECT run_id, 'repeated timeouts' AS finding, node_id FROM n WHERE node_id = 'error' AND n >= 2 UNION ALL SELECT run_id, 'many tokens', node_id FROM n WHERE t > 1000
  UNION ALL SELECT run_id, 'repeated execution', node_id FROM n WHERE n > 2 UNION ALL SELECT run_id, 'expression failed', node_id FROM n WHERE node_id = 'signup' UNION ALL SELECT run_id, 'channel missing', node_id FROM n WHERE node_id = 'view'""")
def diagnose_all(spark: SparkSession, d: str) -> DataFrame:
    """All five findings."""
    kind = F.when(F.col("node_id") == "signup", "TemplateException").when(F.col("node_id") == "view", "MissingChannelException").otherwise(F.col("error_class"))
    return T.diagnosis(event_traces(spark, d).withColumn("error_class", kind), 2, 1000)


@query("""WITH p(model, a, b) AS (VALUES ('click', 2.0, 4.0), ('view', 1.0, 0.5))
  SELECT CAST(user_id AS VARCHAR) AS run_id, round(sum((CAST(json_extract_string(props, '$.k') AS BIGINT) * coalesce(a, 0) + length(event_type) * coalesce(b, 0)) / 1000.0::DOUBLE), 6) AS cost,
  sum((CAST(json_extract_string(props, '$.k') AS BIGINT) * coalesce(a, 0) + length(event_type) * coalesce(b, 0)) / 1000.0::DOUBLE) > 2.0005 AS over_budget FROM events LEFT JOIN p ON model = event_type GROUP BY 1""")
def run_costs(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([("click", 2.0, 4.0), ("view", 1.0, 0.5)], "model string, prompt_price double, completion_price double")
    found = T.costs(event_traces(spark, d).withColumn("model", F.col("node_id")), prices, 2.0005)
    return found.select("run_id", F.round("cost", 6).alias("cost"), "over_budget")


@query("""SELECT CAST(l_partkey AS VARCHAR) AS node_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def token_top10(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("node_id"), F.col("l_quantity").cast("bigint").alias("prompt_tokens"), F.lit(None).cast("bigint").alias("completion_tokens"))
    return T.top_tokens(line)


@query("""SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS node_id, l_returnflag AS tool FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_returnflag = l.l_returnflag AND m.l_linenumber = 1)""")
def tool_allowlist(spark: SparkSession, d: str) -> DataFrame:
    """An order's flags that its first line doesn't allow."""
    used = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("node_id"), F.col("l_returnflag").alias("tool"), "l_linenumber")
    return T.forbidden_tools(used.select("node_id", "tool"), used.where("l_linenumber = 1").select("node_id", "tool"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CAST(o_custkey AS VARCHAR) AS workflow, o_orderpriority AS version, c_mktsegment AS stored_version FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IS DISTINCT FROM c_mktsegment""")
def version_check(spark: SparkSession, d: str) -> DataFrame:
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    wanted = o.select(F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_custkey").cast("string").alias("workflow"), F.col("o_orderpriority").alias("version"))
    return T.version_conflicts(wanted, c.select(F.col("c_custkey").cast("string").alias("workflow"), F.col("c_mktsegment").alias("version")))


@query("""SELECT event_id, CAST(date_diff('millisecond', ts, CASE WHEN event_type = 'error' THEN TIMESTAMP '2030-01-01' ELSE ts + INTERVAL 1500 MILLISECOND END) AS BIGINT) AS duration_ms, event_id % 100 >= 50 AS exceeded FROM events""")
def node_durations(spark: SparkSession, d: str) -> DataFrame:
    """From start to end, or to now without an end; and whether the total is used up."""
    e = read(spark, d, "events")
    ended = F.when(F.col("event_type") != "error", F.col("ts") + F.expr("INTERVAL 1500 MILLISECOND"))
    return e.select("event_id", S.duration_ms(F.col("ts"), ended, F.lit("2030-01-01").cast(e.schema["ts"].dataType)).alias("duration_ms"), S.workflow_exceeded(F.col("event_id") % 100, 50).alias("exceeded"))


@query("""SELECT event_id, CASE WHEN k < 10 THEN '["$.k: must be at least 10"]' WHEN k > 60 THEN '["$.k: must be at most 60"]' ELSE '[]' END AS errors, CAST(k AS VARCHAR) AS k FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def json_schema_errors(spark: SparkSession, d: str) -> DataFrame:
    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 60}}}
    props = F.col("props")
    return read(spark, d, "events").select("event_id", F.to_json(S.json_errors(props, schema)).alias("errors"), F.try_element_at(S.json_map(props), F.lit("k")).alias("k"))


@query("""SELECT conv_id, turn, CASE WHEN text IS NULL OR (role = 'user' AND turn > 0) THEN 'a' ELSE 'b' END AS choice FROM conversations""")
def template_tests(spark: SparkSession, d: str) -> DataFrame:
    """Tests of null, joined by and and or; the branch that isn't taken may name a missing key."""
    c = read(spark, d, "conversations").withColumns({"context": F.create_map(F.lit("role"), F.col("role"), F.lit("turn"), F.col("turn").cast("string")), "inputs": F.create_map(F.lit("text"), F.col("text"))})
    text, gone = resolve("${inputs.text == null or context.role == 'user' and context.turn > 0 ? 'a' : 'b'}")
    return c.where(~gone).select("conv_id", "turn", text.alias("choice"))
