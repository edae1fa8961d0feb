"""Checks and layers of many workflow graphs at once: nodes (workflow, node_ord, node_id), edges (workflow, edge_ord, src, dst)."""

from __future__ import annotations

from functools import reduce

from lamella.operators.staging import drop, staged
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "workflow string, rule_order int, rule string, item string"


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow, node_id, super_step): the longest path from a source; nodes on or behind a cycle have none.

    Peels sources layer by layer: as many rounds as the deepest graph has layers, each over what is left of all.
    """
    left = staged(nodes.select("workflow", "node_id").where(~blank("node_id")).distinct(), "left")
    ends = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("workflow", "src", "dst").distinct()
    for end in ("src", "dst"):
        ends = ends.join(left.withColumnRenamed("node_id", end), ["workflow", end], "left_semi")
    live = staged(ends, "live")
    done, step = [], 0
    while True:
        sources = left.join(live.select("workflow", F.col("dst").alias("node_id")), ["workflow", "node_id"], "left_anti")
        first = staged(sources.withColumn("super_step", F.lit(step)), "layer")
        if first.isEmpty():
            break
        done.append(first)
        rest = staged(left.join(first, ["workflow", "node_id"], "left_anti"), "left")
        still = staged(live.join(first.select("workflow", F.col("node_id").alias("src")), ["workflow", "src"], "left_anti"), "live")
        drop(left)
        drop(live)
        left, live, step = rest, still, step + 1
    return reduce(DataFrame.unionByName, done) if done else first


def cyclic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow, node_id) of nodes that no layer can hold."""
    return nodes.select("workflow", "node_id").where(~blank("node_id")).distinct().join(layers(nodes, edges), ["workflow", "node_id"], "left_anti")


def violations(workflows: DataFrame, nodes: DataFrame, edges: DataFrame, channels: DataFrame) -> DataFrame:
    """All broken rules, (workflow, rule_order, rule, item); a workflow without a row is valid. Isolated nodes are fine."""
    ids = nodes.where(~blank("node_id")).select("workflow", "node_id").distinct()

    def rule(order: int, name: str, rows: DataFrame, item: Column) -> DataFrame:
        return rows.select("workflow", F.lit(order).alias("rule_order"), F.lit(name).alias("rule"), item.cast("string").alias("item"))

    ends = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    arrow = F.concat_ws(" -> ", "src", "dst")
    found = [
        rule(2, "no nodes", workflows.select("workflow").distinct().join(nodes, "workflow", "left_anti"), F.lit(None)),
        rule(3, "node without id", nodes.where(blank("node_id")), F.col("node_ord")),
        rule(4, "repeated node id", nodes.where(~blank("node_id")).groupBy("workflow", "node_id").count().where("count > 1"), F.col("node_id")),
        rule(5, "edge without an end", edges.where("src IS NULL OR dst IS NULL"), F.col("edge_ord")),
        rule(6, "edge to itself", ends.where("src = dst"), F.col("src")),
        rule(7, "edge from an unknown node", ends.join(ids.withColumnRenamed("node_id", "src"), ["workflow", "src"], "left_anti"), F.col("src")),
        rule(7, "edge to an unknown node", ends.join(ids.withColumnRenamed("node_id", "dst"), ["workflow", "dst"], "left_anti"), F.col("dst")),
        rule(8, "repeated edge", ends.groupBy("workflow", "src", "dst").count().where("count > 1"), arrow),
        rule(9, "cycle", cyclic(nodes, edges), F.col("node_id")),
        rule(10, "channel without a reducer", channels.where("channel IS NULL OR reducer IS NULL"), F.col("channel")),
    ]
    return reduce(DataFrame.unionByName, found)


def successors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(workflow, node_id, successors): in edge order, empty where there are none."""
    return neighbours(nodes, edges, "src", "dst", "successors")


def predecessors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return neighbours(nodes, edges, "dst", "src", "predecessors")


def neighbours(nodes: DataFrame, edges: DataFrame, own: str, other: str, name: str) -> DataFrame:
    lists = edges.groupBy("workflow", F.col(own).alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_ord", other))), lambda x: x[other]).alias(name))
    return nodes.select("workflow", "node_id").join(lists, ["workflow", "node_id"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.groupBy("workflow", F.col("dst").alias("node_id")).agg(F.count("*").alias("in_degree"))
    return nodes.select("workflow", "node_id").join(n, ["workflow", "node_id"], "left").na.fill(0, ["in_degree"])
