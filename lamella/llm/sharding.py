"""K-d tree sharding: documents are split at distributed weighted medians until every leaf holds its share of bytes.

A document's coordinates are metadata of its text: the logarithm of its size, bytes per character, and the logarithm of
its lines. A node that has to give k shards is cut along its widest coordinate (as a share of the whole table's width)
where floor(k/2)/k of its bytes lie below. Ties go by a hash of the text, so equal texts stay together; only where a
group of equal texts is larger than `WHOLE` of a shard is it cut as well, by doc_id. A cut is found by histograms over
ever narrower ranges: each pass sends some hundred sums per node to the driver, and all nodes of a level share a pass.
Everything is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

SHARDS, BINS, NEAR, WHOLE = 24, 512, 0.0005, 0.002
DIMS = ("log_size", "density", "log_lines")
#: Rows of a bucket within which slots are numbered.
BUCKET = 8192


@dataclass
class Node:
    """shards first to first + shards - 1; order: the columns by which it is cut, cut: where; left and right below."""

    first: int
    shards: int
    order: tuple[str, ...] = ()
    cut: tuple[int, ...] = ()
    below: list[Node] = field(default_factory=list)

    @property
    def share(self) -> int:
        return self.shards // 2


@dataclass
class Search:
    """Where a node's cut is: values of the columns before `level` are fixed, the one at `level` is in [low, high]."""

    node: Node
    order: tuple[str, ...]
    goal: int
    low: int
    high: int
    before: int = 0
    fixed: tuple[int, ...] = ()

    @property
    def column(self) -> str:
        return self.order[len(self.fixed)]

    @property
    def width(self) -> int:
        return max(1, -(-(self.high - self.low + 1) // BINS))

    def rows(self) -> Column:
        c = F.col(self.column).between(self.low, self.high)
        for name, value in zip(self.order, self.fixed, strict=False):
            c &= F.col(name) == value
        return c

    def done(self, least: int) -> None:
        """Rows whose columns come before (fixed..., least) go left."""
        self.node.order, self.node.cut = self.order[: len(self.fixed) + 1], (*self.fixed, least)
        half = self.node.share
        self.node.below = [Node(self.node.first, half), Node(self.node.first + half, self.node.shards - half)]


def goes_left(order: tuple[str, ...], cut: tuple[int, ...]) -> Column:
    c = F.col(order[-1]) < cut[-1]
    for name, value in zip(order[-2::-1], cut[-2::-1], strict=True):
        c = (F.col(name) < value) | ((F.col(name) == value) & c)
    return c


def leaf_of(node: Node) -> Column:
    """The number of the first shard of the deepest node that a row is in."""
    if not node.below:
        return F.lit(node.first)
    return F.when(goes_left(node.order, node.cut), leaf_of(node.below[0])).otherwise(leaf_of(node.below[1]))


def open_nodes(node: Node) -> list[Node]:
    if node.below:
        return [x for n in node.below for x in open_nodes(n)]
    return [node] if node.shards > 1 else []


def kd_tree(points: DataFrame, shards: int = SHARDS) -> Node:
    """points: doc_id, size, text_hash and DIMS (whole numbers). Nodes without rows are cut anywhere."""
    root = Node(0, shards)
    ends = [f(c).alias(f"{k}_{c}") for c in (*DIMS, "text_hash", "doc_id") for k, f in (("low", F.min), ("high", F.max))]
    widths, target = None, 0
    while nodes := open_nodes(root):
        seen = {r["node"]: r for r in points.groupBy(leaf_of(root).alias("node")).agg(F.sum("size").alias("bytes"), *ends).collect()}
        if widths is None:
            top = seen.get(0)
            widths = {d: max(1, top[f"high_{d}"] - top[f"low_{d}"]) if top else 1 for d in DIMS}
            target = (top["bytes"] if top else 0) / shards
        todo = []
        for n in nodes:
            if (r := seen.get(n.first)) is None:
                Search(n, (DIMS[0],), 0, 0, 0).done(0)
                continue
            d = max(DIMS, key=lambda c, r=r: (r[f"high_{c}"] - r[f"low_{c}"]) / widths[c])
            todo.append(Search(n, (d, "text_hash", "doc_id"), r["bytes"] * n.share // n.shards, r[f"low_{d}"], r[f"high_{d}"]))
        while todo:
            todo = one_pass(points, root, todo, target)
    return root


def one_pass(points: DataFrame, root: Node, todo: list[Search], target: float) -> list[Search]:
    """Narrows every search by one histogram; gives those that aren't done."""
    found: dict[int, list] = {s.node.first: [] for s in todo}
    number, bin_ = F.lit(None).cast("int"), F.lit(None).cast("long")
    leaf = leaf_of(root)
    value = F.lit(None).cast("long")
    for s in todo:
        mine = (F.col("leaf") == s.node.first) & s.rows()
        number = F.when(mine, s.node.first).otherwise(number)
        bin_ = F.when(mine, F.floor((F.col(s.column) - F.lit(s.low)) / s.width)).otherwise(bin_)
        value = F.when(mine, F.col(s.column)).otherwise(value)
    binned = points.withColumn("leaf", leaf).select(number.alias("n"), bin_.alias("bin"), value.alias("v"), "size").where("n IS NOT NULL")
    for r in binned.groupBy("n", "bin").agg(F.sum("size").alias("bytes"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
        found[r["n"]].append(r)
    rest = []
    for s in todo:
        before = s.before
        for r in sorted(found[s.node.first], key=lambda r: r["bin"]):
            if before + r["bytes"] >= s.goal:
                break
            before += r["bytes"]
        after = before + r["bytes"]
        near = min(s.goal - before, after - s.goal)
        last = s.column == "doc_id" and r["low"] == r["high"]
        whole = s.column == "text_hash" and r["low"] == r["high"] and r["bytes"] <= WHOLE * target
        if near <= NEAR * target or last or whole:
            s.done(r["low"] if s.goal - before <= after - s.goal else r["high"] + 1)
        elif r["low"] == r["high"]:
            follow = s.order[len(s.fixed) + 1]
            low, high = (0, (1 << 52) - 1) if follow == "text_hash" else (-(1 << 52), (1 << 52) - 1)
            rest.append(Search(s.node, s.order, s.goal, low, high, before, (*s.fixed, r["low"])))
        else:
            rest.append(Search(s.node, s.order, s.goal, r["low"], r["high"], before, s.fixed))
    return rest


def measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size, chars = F.octet_length(text).cast("long"), F.length(text)
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return docs.select(
        "doc_id",
        (size + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 12).alias("text_hash"),
        F.floor(F.log(size + 8) * 65536).alias("log_size"),
        F.floor(size * 1_000_000 / F.greatest(chars, F.lit(1))).alias("density"),
        F.floor(F.log(lines + 1) * 65536).alias("log_lines"),
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row.

    Null texts are empty; null doc_ids and ids beyond 2**52 count as the same in ties. Fewer documents than shards
    leave shards empty. Slots count the rows of a shard from 0, bucket by bucket.
    """
    points = stage(measured(docs), "points")
    safe = points.withColumn("doc_id", F.coalesce(F.greatest(F.least("doc_id", F.lit((1 << 52) - 1)), F.lit(-(1 << 52))), F.lit(0)))
    root = kd_tree(safe, shards)
    placed = points.withColumn("own_id", F.col("doc_id")).withColumn("doc_id", F.coalesce(F.greatest(F.least("doc_id", F.lit((1 << 52) - 1)), F.lit(-(1 << 52))), F.lit(0)))
    placed = placed.withColumn("shard", leaf_of(root)).withColumn("doc_id", F.col("own_id"))
    n = points.count()
    buckets = max(1, -(-n // (shards * BUCKET)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)))
    sizes = placed.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = sizes.select("shard", "bucket", (F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("rows")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_hash"))
    return (
        placed.withColumn("number", number)
        .join(before, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
