"""Embedding near-duplicates: exact threshold pairs by dual traversal of cover trees.

Vectors are scaled to length one, so cosine >= t is distance <= sqrt(2 - 2t). Equal vectors become one point with a
count. Points are dealt to shards around pivots (a bounded sample; large cells are split by a hash), each shard gets a
cover tree: nested levels whose centres are points, with halving radii. Shard pairs, and then node pairs, whose balls
are further apart than the threshold are dropped; pairs whose balls lie within it link as a whole, without listing
pairs; the rest is opened until single points are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import again, forest, map_batches, ship, stage, table, unstage
from .components import components
from .vectors import SHARD, dump, load, matrix, usable

COSINE, LEAF, TILE, SAFE = 0.9, 24, 1024, 1e-7
#: Pivots at most, and points for each.
PIVOTS, PER_PIVOT = 512, 2048


def cover_tree(x: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes are stretches of `order`; the first point of a node is its centre, and its first child has the same.

    A node of radius r has children of radius r / 2 or less, whose centres are more than r / 2 apart. Its children are
    the nodes `child` to `child + children - 1`.
    """
    order = np.arange(len(x))
    start, end, child, children, radius = [0], [len(x)], [0], [0], [0.0]
    k = 0
    while k < len(start):
        s, e = start[k], end[k]
        own = order[s:e]
        d = np.sqrt(np.maximum(0, 2 - 2 * (x[own] @ x[own[0]])))
        d[0] = 0
        radius[k] = float(d.max(initial=0)) + SAFE * (e - s > 1)
        if e - s > LEAF and radius[k] > 10 * SAFE:
            half, groups, rest, near = radius[k] / 2, [], own, d
            while len(rest):
                inside = near <= half
                inside[0] = True
                groups.append(rest[inside])
                rest = rest[~inside]
                if len(rest):
                    near = np.sqrt(np.maximum(0, 2 - 2 * (x[rest] @ x[rest[0]])))
            if len(groups) > 1:
                order[s:e] = np.concatenate(groups)
                child[k], children[k] = len(start), len(groups)
                for g in groups:
                    start.append(s)
                    end.append(s + len(g))
                    s += len(g)
                more = [0] * len(groups)
                child += more
                children += more
                radius += more
        k += 1
    return {"order": order, "start": np.array(start), "end": np.array(end), "child": np.array(child), "children": np.array(children), "radius": np.array(radius, float)}


def packed(x: np.ndarray) -> np.ndarray:
    """x in single precision where that holds every number exactly."""
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    return small if (small == x).all() else x


def scaled(raw: np.ndarray) -> np.ndarray:
    """The vectors in double precision, of length one."""
    x = raw.astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shard(data: bytes) -> dict[str, np.ndarray]:
    """A staged shard's tree with its scaled vectors."""
    s = load(data)
    return s | {"x": scaled(s.pop("raw"))}


class Dual:
    """Links between two shards, or within one (b is a)."""

    def __init__(self, a: dict[str, np.ndarray], b: dict[str, np.ndarray], cosine: float):
        self.a, self.b, self.cosine, self.reach = a, b, cosine, float(np.sqrt(2 - 2 * cosine))
        self.links = [np.zeros(len(a["x"]), np.int64), np.zeros(len(b["x"]), np.int64)]
        if a is b:
            self.links[1] = self.links[0]
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def points(self, p: np.ndarray, q: np.ndarray, same: bool) -> None:
        """Compares points one by one; same: p is q."""
        dot = self.a["x"][p] @ self.b["x"][q].T
        i, j = np.nonzero(np.triu(dot >= self.cosine, 1) if same else dot >= self.cosine)
        if len(i):
            i, j = p[i], q[j]
            np.add.at(self.links[0], i, self.b["n"][j])
            np.add.at(self.links[1], j, self.a["n"][i])
            self.edges.append((self.a["ids"][i], self.b["ids"][j]))

    def whole(self, p: np.ndarray, q: np.ndarray, same: bool) -> None:
        """Links all of p with all of q."""
        na, nb = self.a["n"][p], self.b["n"][q]
        self.links[0][p] += nb.sum() - (na if same else 0)
        if not same:
            self.links[1][q] += na.sum()
        hub = self.a["ids"][p[0]]
        for ids in (self.a["ids"][p], self.b["ids"][q]):
            self.edges.append((np.full(len(ids), hub), ids))

    def run(self) -> None:
        a, b, same = self.a, self.b, self.a is self.b
        todo = [(0, 0)]
        while todo:
            i, j = todo.pop()
            twin = same and i == j
            p, q = a["order"][a["start"][i] : a["end"][i]], b["order"][b["start"][j] : b["end"][j]]
            d = 0.0 if twin else float(np.sqrt(max(0, 2 - 2 * float(a["x"][p[0]] @ b["x"][q[0]]))))
            if d > a["radius"][i] + b["radius"][j] + self.reach + SAFE:
                continue
            if d + a["radius"][i] + b["radius"][j] < self.reach - SAFE:
                self.whole(p, q, twin)
            elif not a["children"][i] and not b["children"][j]:
                self.points(p, q, twin)
            else:
                todo += self.open(i, j, twin)

    def open(self, i: int, j: int, twin: bool) -> list[tuple[int, int]]:
        """Pairs of children that come near enough; pairs of single points are compared at once."""
        a, b, out = self.a, self.b, []
        left = a["child"][i] + np.arange(a["children"][i]) if a["children"][i] else np.array([i])
        right = b["child"][j] + np.arange(b["children"][j]) if b["children"][j] else np.array([j])
        for s in range(0, len(left), TILE):
            m = left[s : s + TILE]
            pm, rm, one_m = a["order"][a["start"][m]], a["radius"][m], a["end"][m] - a["start"][m] == 1
            for t in range(s if twin else 0, len(right), TILE):
                n = right[t : t + TILE]
                pn, rn, one_n = b["order"][b["start"][n]], b["radius"][n], b["end"][n] - b["start"][n] == 1
                dot = a["x"][pm] @ b["x"][pn].T
                near = 2 - 2 * dot <= (rm[:, None] + rn[None, :] + self.reach + SAFE) ** 2
                if twin:
                    near &= m[:, None] <= n[None, :]
                single = near & one_m[:, None] & one_n[None, :] & (dot >= self.cosine)
                if twin:
                    single &= m[:, None] < n[None, :]
                x, y = np.nonzero(single)
                if len(x):
                    np.add.at(self.links[0], pm[x], b["n"][pn[y]])
                    np.add.at(self.links[1], pn[y], a["n"][pm[x]])
                    self.edges.append((a["ids"][pm[x]], b["ids"][pn[y]]))
                x, y = np.nonzero(near & ~(one_m[:, None] & one_n[None, :]))
                out += zip(m[x].tolist(), n[y].tolist(), strict=True)
        return out

    def result(self) -> pa.Table:
        """A row for each linked point: its links here and its root here."""
        shards = [self.a] if self.a is self.b else [self.a, self.b]
        ids = np.concatenate([s["ids"] for s in shards])
        links = np.concatenate(self.links[: len(shards)])
        node, root = forest(*(np.concatenate(x) for x in zip(*self.edges, strict=True))) if self.edges else (ids[:0], ids[:0])
        at = np.argsort(node)
        place = np.searchsorted(node[at], ids).clip(max=max(0, len(node) - 1))
        up = np.where(node[at][place] == ids, root[at][place], ids) if len(node) else ids
        on = links > 0
        return pa.table({"vec_id": ids[on], "links": links[on], "root": up[on]})


def near_vectors(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, n_links, component_id, kept), a row for each row.

    Vectors that `usable` leaves out, and vectors of another length, link with nothing. Rows with the same vec_id count
    as one vector in components. A null vec_id links with nothing, has no component and isn't kept.
    """
    spark = rows.sparkSession
    ship(spark)
    vectors = stage(usable(rows, True).withColumn("same", F.unhex(F.md5("vec"))), "vectors")
    named = stage(vectors.select("vec_id", "dim", "same"), "named-vectors")
    reps = stage(vectors.groupBy("dim", "same").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("vec").alias("vec")), "distinct-vectors")
    unstage(vectors)  # from here on equal vectors go by their digest
    first = stage(reps.drop("vec"), "first-vectors")
    sizes = {r[0]: r[1] for r in reps.groupBy("dim").count().orderBy(F.desc("count")).limit(4096).collect()}
    pivots = {}
    for dim, n in sizes.items():
        want = max(1, min(PIVOTS, n // PER_PIVOT))
        got = reps.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(max(1, n // (4 * want)))) == 0)).select("vec").limit(want).collect() if n > 1 else []
        x = np.array([np.frombuffer(r[0], "<f8") for r in got]).reshape(-1, dim) if got else np.ones((1, dim))
        pivots[dim] = x / np.linalg.norm(x, axis=1, keepdims=True)
    sent = spark.sparkContext.broadcast(pivots)

    def cell(b: pa.RecordBatch) -> pa.RecordBatch:
        dims, out = b.column("dim").to_numpy(), np.zeros(b.num_rows, np.int32)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            x = matrix(b.column("vec").take(pa.array(at)), int(d))
            out[at] = (x @ sent.value.get(int(d), np.ones((1, int(d)))).T).argmax(1)
        return pa.record_batch([*b.columns, pa.array(out)], names=[*b.schema.names, "cell"])

    placed = map_batches(reps.select("dim", "vec", "vec_id", "n"), cell, "dim int, vec binary, vec_id long, n long, cell int")
    cells = placed.groupBy("dim", "cell").count().withColumn("parts", F.ceil(F.col("count") / SHARD).cast("int"))
    cut = placed.join(cells.drop("count"), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        ids, n = t["vec_id"].to_numpy(), t["n"].to_numpy()
        by_id = np.argsort(ids)
        raw, ids, n = packed(matrix(t["vec"], dim)[by_id]), ids[by_id], n[by_id]
        x = scaled(raw)
        tree = cover_tree(x)
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "cell": pa.array([t["cell"][0].as_py()], pa.int32()), "part": pa.array([t["part"][0].as_py()], pa.int32()),
            "center": pa.array([x[0].tolist()], pa.list_(pa.float64())), "radius": pa.array([float(tree["radius"][0])]), "data": pa.array([dump(raw=raw, ids=ids, n=n, **tree)], pa.binary()),
        })

    shards = stage(cut.groupBy("dim", "cell", "part").applyInArrow(build, "dim int, cell int, part int, center array<double>, radius double, data binary"), "covers")
    name = F.struct("cell", "part")
    unstage(reps)
    reach = float(np.sqrt(2 - 2 * cosine)) + SAFE
    apart = F.aggregate(F.zip_with("ci", "cj", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    one = shards.select("dim", name.alias("i"), F.col("center").alias("ci"), F.col("radius").alias("ri"), F.col("data").alias("one"))
    two = again(shards).select(F.col("dim").alias("dim_j"), name.alias("j"), F.col("center").alias("cj"), F.col("radius").alias("rj"), F.col("data").alias("two"))
    near = (F.col("dim") == F.col("dim_j")) & (F.col("i") <= F.col("j")) & (apart <= (F.col("ri") + F.col("rj") + reach) * (F.col("ri") + F.col("rj") + reach))
    # both sides are read from the staged shards where they meet: a shuffle would write a shard once for each of its pairs
    pairs = one.join(two.hint("shuffle_replicate_nl"), near).select((F.col("i") == F.col("j")).alias("same"), "one", "two")

    def dual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, x, y in zip(*(batch.column(c) for c in ("same", "one", "two")), strict=True):
                a = shard(x.as_py())
                d = Dual(a, a if same.as_py() else shard(y.as_py()), cosine)
                d.run()
                yield from d.result().to_batches()

    found = stage(pairs.mapInArrow(dual, "vec_id long, links long, root long"), "links")
    comp = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "vec_id")
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    told = first.join(links, "vec_id", "left").join(comp, "vec_id", "left").select("dim", "same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    linked = named.join(told, ["dim", "same"]).select("vec_id", "n_links", "component_id")
    out = rows.select("vec_id", F.monotonically_increasing_id().alias("row")).join(linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
