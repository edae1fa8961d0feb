"""Exact top-k inner-product search: a ball tree per shard, branch and bound by upper bound.

Shards are dealt by a hash, so copies of a common vector spread. Each query first searches the shard that holds it;
its k-th score there is a floor that goes with it to all other shards, where whatever can't reach it is cut off. In a
shard, a block of queries opens nodes in the order of their best upper bound q.c + |q| r, all sharing their current
k-th scores. The work is the query set against all rows, in blocks of queries and shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, stage, table
from .vectors import dump, load, matrix, sharded, usable

K, LEAF, BLOCK = 5, 64, 512
EXACT, LOWEST = 2.0**53, np.iinfo(np.int64).min


def ball_tree(x: np.ndarray) -> dict[str, np.ndarray]:
    """order: rows so that each node is a stretch (start, end); child: of the left child (right: + 1), or -1; center, radius."""
    order, start, end, child, center, radius = np.arange(len(x)), [0], [len(x)], [-1], [], []
    k = 0
    while k < len(start):
        own = order[start[k] : end[k]]
        p = x[own]
        c = p.mean(0)
        center.append(c)
        radius.append(float(np.sqrt(((p - c) ** 2).sum(1).max())))
        if len(own) > LEAF and radius[-1] > 0:
            far = p[((p - c) ** 2).sum(1).argmax()]
            by = p @ (far - c)
            half = len(own) // 2
            order[start[k] : end[k]] = own[np.argpartition(by, half)]
            child[k] = len(start)
            start += [start[k], start[k] + half]
            end += [start[k] + half, end[k]]
            child += [-1, -1]
        k += 1
    return {"order": order, "start": np.array(start), "end": np.array(end), "child": np.array(child), "center": np.array(center), "radius": np.array(radius)}


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles; beyond 64 bits the nearest long."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < EXACT:
        return (q @ x.T).astype(np.int64)
    big = np.frompyfunc(int, 1, 1)
    return np.clip(big(q) @ big(x).T, LOWEST + 1, np.iinfo(np.int64).max).astype(np.int64)


def search(tree: dict[str, np.ndarray], x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids (queries, k) of the best rows that reach each query's floor; LOWEST where there are fewer."""
    best, who = np.full((len(q), k), LOWEST), np.full((len(q), k), np.iinfo(np.int64).max)
    if not len(q):
        return best, who
    kth = floor.copy()
    length = np.sqrt((q**2).sum(1))
    upper = q @ tree["center"].T + length[:, None] * tree["radius"]
    upper += 1 + np.abs(upper) * 1e-9 + length[:, None] * np.sqrt((tree["center"] ** 2).sum(1)) * 1e-9  # rounding
    queue = [(-upper[:, 0].max(), 0)]
    while queue:
        node = heapq.heappop(queue)[1]
        live = np.flatnonzero(upper[:, node] >= kth)
        if not len(live):
            continue
        if (c := tree["child"][node]) >= 0:
            for n in (c, c + 1):
                heapq.heappush(queue, (-upper[live, n].max(), n))
            continue
        at = tree["order"][tree["start"][node] : tree["end"][node]]
        score = products(q[live], x[at])
        score[own[live][:, None] == ids[at][None, :]] = LOWEST
        hit = (score >= kth[live][:, None]).any(1)
        live, score = live[hit], score[hit]
        both, names = np.c_[best[live], score], np.c_[who[live], np.broadcast_to(ids[at], score.shape)]
        names[both == LOWEST] = np.iinfo(np.int64).max
        top = np.lexsort((names, ~both), axis=1)[:, :k]  # ~x falls as x grows, without overflow
        best[live], who[live] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        kth[live] = np.maximum(kth[live], best[live, -1])
    return best, who


def found_rows(queries: np.ndarray, best: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ok = best != LOWEST
    return np.repeat(queries, ok.sum(1)), who[ok], best[ok]


def top_k(rows: DataFrame, k: int = K, every: int = 50, scale: float = 256.0) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): the k best rows for each row whose id `every` divides.

    Components become floor(scale * x); scores are whole inner products. A row with the query's own id is no
    candidate; only vectors of the query's length are. Vectors that `usable` leaves out take no part; without queries
    or candidates the result is empty. Equal scores: smaller vec_id first.
    """
    ship(rows.sparkSession)

    def build(t: pa.Table) -> pa.Table:
        dim, shard, shards = (t[c][0].as_py() for c in ("dim", "shard", "shards"))
        x, ids = np.floor(scale * matrix(t["vec"], dim)), t["vec_id"].to_numpy()
        tree = ball_tree(x)
        asked = np.flatnonzero(ids % every == 0)
        best, who = search(tree, x, ids, x[asked], ids[asked], np.full(len(asked), LOWEST + 1), k)
        a, b, c = found_rows(ids[asked], best, who)
        floor = np.maximum(best[:, -1], LOWEST + 1)
        n = 1 + len(asked) + len(a)
        pad = lambda v, before: np.r_[np.zeros(before, np.int64), v, np.zeros(n - before - len(v), np.int64)]
        return pa.table({
            "kind": pa.array([0] + [1] * len(asked) + [2] * len(a), pa.int32()),
            "dim": pa.array([dim] * n, pa.int32()), "shard": pa.array([shard] * n, pa.int32()), "shards": pa.array([shards] * n, pa.int32()),
            "query_id": np.r_[0, ids[asked], a].astype(np.int64), "vec_id": pad(b, 1 + len(asked)), "score": pad(c, 1 + len(asked)) + pad(floor, 1),
            "data": pa.array([dump(x=x, ids=ids, **tree), *(v.tobytes() for v in x[asked]), *([None] * len(a))], pa.binary()),
        })

    schema = "kind int, dim int, shard int, shards int, query_id long, vec_id long, score long, data binary"
    first = stage(sharded(usable(rows, False)).groupBy("dim", "shard").applyInArrow(build, schema), "balls")
    queries = first.where("kind = 1")
    n = queries.count()
    blocks = -(-n // BLOCK)
    own = first.where("kind = 2").select("query_id", "vec_id", "score")
    if not blocks:
        return own.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")

    def visit(key: tuple, shard: pa.Table, asked: pa.Table) -> pa.Table:
        if shard.num_rows and asked.num_rows:
            s = load(shard["data"][0].as_py())
            q, ids = matrix(asked["data"], s["x"].shape[1]), asked["query_id"].to_numpy()
            a, b, c = found_rows(ids, *search(s, s["x"], s["ids"], q, ids, asked["score"].to_numpy(), k))
        else:
            a = b = c = np.empty(0, np.int64)
        return pa.table({"query_id": a, "vec_id": b, "score": c})

    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    sent = queries.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("to"), block, "shard", "query_id", "score", "data").where("to <> shard").select("dim", F.col("to").alias("shard"), "block", "query_id", "score", "data")
    trees = first.where("kind = 0").select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "data")
    keys = ("dim", "shard", "block")
    other = trees.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(visit, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = own.unionByName(other).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))
