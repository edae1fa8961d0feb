"""Workflow definitions: YAML text to rows. A definition is small and stays on the driver; files by the thousand are
parsed where they are read."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

REDUCERS = ("OVERWRITE", "CONCAT", "MAX", "CUSTOM")
NODES = "workflow string, version string, node_ord int, node_id string, agent string, prompt_template string, tools array<string>, timeout string, retry struct<max_attempts: int, initial_backoff: string>, output_schema string, mock_response string"
EDGES = "workflow string, version string, edge_ord int, src string, dst string"
CHANNELS = "workflow string, version string, channel string, type string, reducer string"


class WorkflowError(ValueError):
    """A definition that can't be read or isn't valid."""


@dataclass
class Node:
    id: str | None
    agent: str | None = None
    prompt_template: str | None = None
    tools: list[str] = field(default_factory=list)
    timeout: str | None = None
    retry: dict[str, Any] | None = None
    output_schema: dict[str, Any] = field(default_factory=dict)
    mock_response: str | None = None


@dataclass
class Definition:
    """reducers: channel to OVERWRITE, CONCAT, MAX or CUSTOM (None if it isn't given)."""

    nodes: list[Node]
    edges: list[tuple[str | None, str | None]]
    reducers: dict[str, str | None] = field(default_factory=dict)
    types: dict[str, str | None] = field(default_factory=dict)
    version: str = "1.0"
    name: str = "workflow"


def parse(text: str, name: str = "workflow", head: str = "workflow") -> Definition:
    """One YAML document. Unknown keys, unknown reducers and wrong shapes are errors; head is the key of the section with the version."""
    try:
        doc = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise WorkflowError(f"not YAML: {e}") from e
    if not isinstance(doc, dict):
        raise WorkflowError("the top level must be a mapping")
    strict(doc, {head, "channels", "nodes", "edges"}, "the top level")
    nodes = []
    for n in sequence(doc, "nodes"):
        strict(n, {"id", "agent", "prompt_template", "tools", "timeout", "retry", "output_schema", "mock_response"}, f"node {n.get('id') if isinstance(n, dict) else n}")
        for key, kind in (("tools", list), ("retry", dict), ("output_schema", dict)):
            if not isinstance(n.get(key) if n.get(key) is not None else kind(), kind):
                raise WorkflowError(f"node {n.get('id')}: {key} has the wrong shape")
        plain = {k: as_text(n[k]) for k in ("agent", "prompt_template", "timeout", "mock_response") if n.get(k) is not None}
        nodes.append(Node(as_text(n.get("id")), **plain, **{k: n[k] for k in ("tools", "retry", "output_schema") if n.get(k) is not None}))
    reducers, types = {}, {}
    if not isinstance(doc.get("channels") or {}, dict):
        raise WorkflowError("channels must be a mapping")
    for channel, c in (doc.get("channels") or {}).items():
        c = c or {}
        strict(c, {"type", "reducer"}, f"channel {channel}")
        reducer = c.get("reducer")
        if reducer is not None and str(reducer).upper() not in REDUCERS:
            raise WorkflowError(f"channel {channel}: unknown reducer {reducer}")
        reducers[channel], types[channel] = reducer and str(reducer).upper(), c.get("type")
    edges = []
    for e in sequence(doc, "edges"):
        strict(e, {"from", "to"}, f"edge {e}")
        edges.append((as_text(e.get("from")), as_text(e.get("to"))))
    if not isinstance(doc.get(head) or {}, dict):
        raise WorkflowError(f"{head} must be a mapping")
    version = str((doc.get(head) or {}).get("version") or "").strip() or "1.0"
    return Definition(nodes, edges, reducers, types, version, name)


def sequence(doc: dict, key: str) -> list:
    found = doc.get(key)
    if found is not None and not isinstance(found, list):
        raise WorkflowError(f"{key} must be a list")
    return found or []


def as_text(v: Any) -> str | None:
    """A scalar as text, as YAML may read an id as a number."""
    if isinstance(v, (dict, list)):
        raise WorkflowError(f"{v} must be a scalar")
    return None if v is None else str(v)


def strict(found: Any, known: set[str], where: str) -> None:
    if not isinstance(found, dict):
        raise WorkflowError(f"{where} must be a mapping")
    if more := set(found) - known:
        raise WorkflowError(f"{where}: unknown keys {sorted(more)}")


def node_rows(d: Definition) -> list[tuple]:
    retry = lambda r: (r.get("max_attempts"), r.get("initial_backoff")) if r else None
    return [(d.name, d.version, i, n.id, n.agent, n.prompt_template, n.tools, n.timeout, retry(n.retry), json.dumps(n.output_schema) if n.output_schema else None, n.mock_response) for i, n in enumerate(d.nodes)]


def edge_rows(d: Definition) -> list[tuple]:
    return [(d.name, d.version, i, a, b) for i, (a, b) in enumerate(d.edges)]


def channel_rows(d: Definition) -> list[tuple]:
    return [(d.name, d.version, c, d.types.get(c), r) for c, r in d.reducers.items()]


def tables(spark: SparkSession, *definitions: Definition) -> dict[str, DataFrame]:
    """nodes, edges and channels of definitions as DataFrames."""
    return {kind: spark.createDataFrame([r for d in definitions for r in rows(d)], schema) for kind, (rows, schema) in MADE.items()}


MADE = {"nodes": (node_rows, NODES), "edges": (edge_rows, EDGES), "channels": (channel_rows, CHANNELS)}


def named(names: list[str], row: tuple) -> dict[str, Any]:
    """A row by its names."""
    found = dict(zip(names, row, strict=True))
    if found.get("retry"):
        found["retry"] = dict(zip(("max_attempts", "initial_backoff"), found["retry"], strict=True))
    return found


def scan(spark: SparkSession, path: str, head: str = "workflow") -> dict[str, DataFrame]:
    """nodes, edges and channels of all YAML files under a path, with all fields; a file that can't be read gives a row in errors."""

    names = {kind: StructType.fromDDL(schema).names for kind, (_, schema) in MADE.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, text in zip(b["file"], b["value"], strict=True):
                try:
                    d = parse(text, name, head)
                    found = [(kind, named(names[kind], r)) for kind, (made, _) in MADE.items() for r in made(d)]
                except WorkflowError as e:
                    found = [("errors", {"workflow": name, "error": str(e)})]
                rows += [(kind, json.dumps(r)) for kind, r in found]
            yield pd.DataFrame(rows, columns=["kind", "row"])

    files = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    rows = files.mapInPandas(run, "kind string, row string")
    schemas = {kind: schema for kind, (_, schema) in MADE.items()} | {"errors": "workflow string, error string"}
    return {kind: rows.where(F.col("kind") == kind).select(F.from_json("row", schema).alias("r")).select("r.*") for kind, schema in schemas.items()}
