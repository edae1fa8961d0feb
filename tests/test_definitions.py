import pytest

from lamella.operators import graph as G
from lamella.plans.workflow import check, layer_ids
from lamella.sources.definitions import WorkflowError, parse, scan, tables

DOUBLE = "nodes: [{id: A}, {id: B}, {id: C}, {id: D}, {id: E}, {id: F}, {id: G}]\nedges: [" + ", ".join(f"{{from: {a}, to: {b}}}" for a, b in ("AB", "AC", "BD", "CD", "DE", "DF", "EG", "FG")) + "]"
FULL = """
workflow: {version: "2.1"}
channels: {risk: {type: string, reducer: max}, log: {reducer: CONCAT}}
nodes:
  - {id: a, agent: x, prompt_template: "hi ${inputs.n}", tools: [t1, t2], timeout: 30s, retry: {max_attempts: 2, initial_backoff: 1s}, output_schema: {type: object}, mock_response: m}
"""


@pytest.mark.parametrize(
    ("text", "layers"),
    [
        ("nodes: [{id: A}, {id: B}, {id: C}]\nedges: [{from: A, to: B}, {from: B, to: C}]", [["A"], ["B"], ["C"]]),
        (DOUBLE, [["A"], ["B", "C"], ["D"], ["E", "F"], ["G"]]),
        ("nodes: [{id: only}]", [["only"]]),
        ("nodes: [{id: A}, {id: B}, {id: C}]", [["A", "B", "C"]]),
    ],
)
def test_layers(spark, text, layers):
    d = parse(text)
    check(d)
    assert layer_ids(d) == layers
    t = tables(spark, d)
    got = {(r.node_id, r.super_step) for r in G.layers(t["nodes"], t["edges"]).collect()}
    assert got == {(n, i) for i, step in enumerate(layers) for n in step}
    assert G.violations(t["nodes"].select("workflow"), t["nodes"], t["edges"], t["channels"]).count() == 0


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("nodes: [{id: A}, {id: B}]\nedges: [{from: A, to: B}, {from: B, to: A}]", "cycle"),
        ("nodes: [{id: A}]\nedges: [{from: A, to: A}]", "itself"),
        ("nodes: [{id: A}]\nedges: [{from: A, to: Z}]", "Z"),
        ("nodes: [{id: A}, {id: A}]", "repeated"),
        ("nodes: []", "nodes"),
        ("nodes: [{agent: x}]", "id"),
        ("nodes: [{id: A}, {id: B}]\nedges: [{from: A, to: B}, {from: A, to: B}]", "repeated"),
        ("nodes: [{id: A, colour: red}]", "unknown keys"),
        ("channels: {c: {reducer: SUM}}\nnodes: [{id: A}]", "reducer"),
        ("channels: {c: {}}\nnodes: [{id: A}]", "reducer"),
        ("nodes: [", "YAML"),
    ],
)
def test_faults(text, said):
    with pytest.raises(WorkflowError, match=said):
        check(parse(text))


@pytest.mark.parametrize("text", ["nodes: 5", "nodes: [x]", "nodes: [[1]]", "edges: {a: b}", "nodes: [{id: A}]\nedges: [A]", "nodes: [{id: A}, {id: B}]\nedges: [{from: A, to: B, x: 1}]", "channels: [a]", "channels: {c: 3}", "workflow: 7", "nodes: [{id: [1]}]", "nodes: [{id: A, tools: x}]", "nodes: [{id: A, retry: 3}]", "- a"])
def test_wrong_shapes(text):
    with pytest.raises(WorkflowError):
        parse(text)


def test_scan_has_all_fields(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(FULL)
    (tmp_path / "b.yaml").write_text("nodes: [x]")
    found = scan(spark, str(tmp_path))
    row, want = found["nodes"].first(), tables(spark, parse(FULL))["nodes"].first()
    assert {k: v for k, v in row.asDict().items() if k != "workflow"} == {k: v for k, v in want.asDict().items() if k != "workflow"}
    assert {(r.channel, r.type, r.reducer) for r in found["channels"].collect()} == {("risk", "string", "MAX"), ("log", None, "CONCAT")}
    assert found["errors"].count() == 1


def test_full_definition(spark):
    d = parse(FULL)
    assert (d.version, d.reducers, parse("nodes: [{id: a}]").version) == ("2.1", {"risk": "MAX", "log": "CONCAT"}, "1.0")
    row = tables(spark, d)["nodes"].first()
    assert (row.tools, row.retry.max_attempts, row.output_schema) == (["t1", "t2"], 2, '{"type": "object"}')


def test_scan_of_files(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(DOUBLE)
    (tmp_path / "b.yaml").write_text("nodes: [")
    found = scan(spark, str(tmp_path))
    assert (found["nodes"].count(), found["edges"].count(), found["errors"].count()) == (7, 8, 1)
    assert G.layers(found["nodes"], found["edges"]).agg({"super_step": "max"}).first()[0] == 4


def test_adjacency(spark):
    t = tables(spark, parse(DOUBLE))
    assert {r.node_id: r.successors for r in G.successors(t["nodes"], t["edges"]).collect()}["A"] == ["B", "C"]
    assert {r.node_id: r.predecessors for r in G.predecessors(t["nodes"], t["edges"]).collect()}["A"] == []
    assert {r.node_id: r.in_degree for r in G.in_degree(t["nodes"], t["edges"]).collect()} == {"A": 0, "B": 1, "C": 1, "D": 2, "E": 1, "F": 1, "G": 2}
