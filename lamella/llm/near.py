"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are the SimHash links of the pigeonring filter over the sets' fingerprints, and beside them the sets that
meet in min-hashes: at a similarity of 0.8 fingerprints differ in some ten of 64 bits, for which no pigeonring key is
selective. Two sets of similarity s agree in all rows of a band with probability s**ROWS, so they meet in one of the
bands with 1 - (1 - s**ROWS)**BANDS, which is 0.99998 at s = 0.8 and more above. Sets that are linked, directly or over
others, form a cluster; a small cluster's sets come together once, and there all pairs of similarity 0.8 or more are
settled exactly by a prefix filter over the whole sets. A cluster that is more than a task should hold is settled over
many tasks instead: first every set is compared with one centre of a band, which joins a large group of near copies
in a round or two, then the bands that still hold several groups are compared in tiles of two bounded blocks,
of which one at least has no set of the band's largest group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import again, map_batches, ship, stage, utf8
from .components import components
from .simhash import bit_counts, fingerprint_links, majority

WORDS, BANDS, ROWS, SEED = 5, 28, 5, 42
#: The least similarity, as a fraction.
NUM, DEN = 4, 5
#: Shingles that are hashed by all rows at once.
BLOCK = 512
#: A cluster with more sets, or more shingles in all, is settled over many tasks; of a tile's two blocks each has about half as many.
SETS, WEIGHT = 256, 1 << 20
#: Rounds of comparing with centres.
ROUNDS = 2
MULT, ADD = (np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[1], [0]], np.uint64))


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    grams = [b" ".join(w)] if len(w) < WORDS else map(b" ".join, zip(*(w[i:] for i in range(WORDS))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64))


def name(s: np.ndarray) -> int:
    """A set's id: equal sets have equal ids."""
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def fingerprint(s: np.ndarray) -> int:
    """The SimHash of a set of shingles; zero without shingles."""
    ones = sum((bit_counts(s[at : at + BLOCK]) for at in range(0, len(s), BLOCK)), np.zeros(64, np.int64))
    return majority(ones, len(s)) if len(s) else 0


def bands(s: np.ndarray) -> np.ndarray:
    """A key for each band of a set's min-hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(s), BLOCK):
        low = np.minimum(low, (s[at : at + BLOCK, None] * MULT + ADD).min(0))
    low, key = low.reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for row in range(ROWS):
        key = (key ^ (key >> np.uint64(29)) ^ low[:, row]) * np.uint64(0x9E3779B97F4A7C15)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def settle(sets: list[np.ndarray], known: np.ndarray | None = None, asked: np.ndarray | None = None) -> np.ndarray:
    """For each of the distinct sets the first one (by place) that it reaches over pairs of the least similarity; exact.

    known: sets with the same value are of one group already. asked (n x n): the pairs to compare, all without it.
    Sets are taken by size. Of a pair, the rarest len - ceil(0.8 len) + 1 shingles of both share one, so only sets that
    share such a shingle are compared, and of those only the ones that aren't in the same group already.
    """
    n = len(sets)
    root = np.arange(n)
    if known is not None:
        _, first, group = np.unique(known, return_index=True, return_inverse=True)
        root = first[group]
    if n == 2 and known is None:
        return root * (not similar(*sets))
    sizes = np.array([len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    ends = sizes.cumsum()
    prefix = [np.sort(rank[token[e - k : e]])[: k - -(-NUM * k // DEN) + 1] for e, k in zip(ends, sizes, strict=True)]
    places = np.r_[0, np.bincount(np.concatenate(prefix), minlength=len(times)).cumsum()]
    held, filled = np.empty(places[-1], np.int64), places[:-1].copy()
    mark = np.zeros(len(times), np.int64)
    for x in np.argsort(sizes, kind="stable"):
        near = np.concatenate([held[places[t] : filled[t]] for t in prefix[x]]) if len(prefix[x]) else held[:0]
        near = np.unique(near[(root[near] != root[x]) & (DEN * sizes[near] >= NUM * sizes[x])])
        if asked is not None:
            near = near[asked[x, near]]
        if len(near):
            own, others = token[ends[x] - sizes[x] : ends[x]], np.concatenate([token[ends[y] - sizes[y] : ends[y]] for y in near])
            mark[own] = 1
            both = np.add.reduceat(mark[others], np.r_[0, sizes[near][:-1].cumsum()])
            mark[own] = 0
            for y in near[DEN * both >= NUM * (sizes[x] + sizes[near] - both)]:
                first, second = sorted((root[x], root[y]))
                root[root == second] = first
        held[filled[prefix[x]]] = x
        filled[prefix[x]] += 1
    return root


def meetings(sets: DataFrame) -> DataFrame:
    """sets (set_id, keys) -> edges (a, b) from the first set under each key to the others."""
    ship(sets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = np.empty(0, np.int64), np.empty(0, np.int64)  # the last key so far, and its first set
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids = (np.r_[had, batch.column(c).to_numpy(zero_copy_only=False)] for had, c in ((key, "key"), (first, "set_id")))
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            firsts = np.repeat(ids[starts], np.diff(np.r_[starts, len(keys)]))
            key, first = keys[-1:], firsts[-1:]
            more = firsts != ids
            yield pa.record_batch([pa.array(firsts[more]), pa.array(ids[more])], names=["a", "b"])

    return sets.select("set_id", F.explode("keys").alias("key")).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def settled(members: DataFrame) -> DataFrame:
    """members (cluster, set_id, text) -> (set_id, root): each set of a cluster with the least set of its group."""
    ship(members.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def out() -> pa.RecordBatch:
            ids = sorted(held)
            root = settle([held[i] for i in ids]) if len(ids) > 1 else [0] * len(ids)
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array([ids[r] for r in root], pa.int64())], names=["set_id", "root"])

        for batch in batches:
            for cluster, set_id, text in zip(batch.column("cluster").to_pylist(), batch.column("set_id").to_pylist(), utf8(batch.column("text")), strict=True):
                if cluster != at:
                    yield out()
                    at, held = cluster, {}
                held[set_id] = shingles(text)
        yield out()

    return members.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(run, "set_id long, root long")


def of(sets: DataFrame, column: str) -> DataFrame:
    """The staged sets (set_id, data) as (column, data)."""
    return again(sets).select(F.col("set_id").alias(column), "data")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose sets are similar. A task compares one a with about SETS of its b at a time."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for a, b, data in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "data")), strict=True):
                s = np.frombuffer(data, "<u8")
                if b is None:
                    at, head = a, s
                elif a == at and similar(head, s):
                    found.append((a, b))
            yield pa.record_batch([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SETS).cast("int").alias("parts"))
    asked = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    heads = parts.join(of(sets, "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "data")
    rows = heads.unionByName(asked.join(of(sets, "b"), "b").select("a", "part", "b", "data"))
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b")).mapInArrow(run, "a long, b long")


def tiled(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """rest (key, set_id, size, root) -> edges (a, b) that join all similar sets of a key, by tiles of two blocks of a key's sets.

    A key's largest group isn't compared with itself: its blocks meet those of the other groups' sets only, which meet
    each other too. So a set of that group is sent once for each block of the others, however large its own group is.
    Two sets are compared in one tile only: under the least key they share, and there in the tile of their two blocks.
    Tiles whose sets are of one group already are left out before the sets are shuffled.
    """
    ship(rest.sparkSession)
    shared = rest.groupBy("set_id").agg(F.collect_list("key").alias("keys"))
    n, size, top = F.sum("n"), F.sum("size"), F.max(F.struct("n", "size", "root"))
    groups = rest.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size")).groupBy("key").agg((n - top.n).alias("n"), (size - top.size).alias("size"), top.alias("top"))
    few = F.greatest(F.ceil(2 * F.col("n") / SETS), F.ceil(2 * F.col("size") / WEIGHT)).cast("int").alias("few")
    many = F.greatest(F.ceil(F.col("top.n") / (2 * SETS)), F.ceil(2 * F.col("top.size") / WEIGHT)).cast("int").alias("many")
    split, most = rest.join(groups.select("key", F.col("top.root").alias("top"), few, many), "key"), F.col("root") == F.col("top")
    block = (F.pmod(F.xxhash64("set_id", F.lit(SEED)), F.when(most, F.col("many")).otherwise(F.col("few"))) + F.when(most, F.col("few")).otherwise(0)).cast("int").alias("block")
    others = F.col("few") + F.when(most, 0).otherwise(F.col("many"))
    placed = split.select("key", "set_id", "root", block, F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    placed = stage(placed.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set_id", "root", "block"), "tiles")
    mixed = again(placed).groupBy("key", "i", "j").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def asked(ids: list[int]) -> np.ndarray:
            less = [[k for k in held[i][2] if k < at[0]] for i in ids]
            place = {k: c for c, k in enumerate({k for keys in less for k in keys})}
            has = np.zeros((len(ids), len(place)), np.float32)
            for row, keys in enumerate(less):
                has[row, [place[k] for k in keys]] = 1
            block = np.array([held[i][3] for i in ids])
            return (has @ has.T == 0) & ((at[1] == at[2]) | (block[:, None] != block[None, :]))

        def out() -> pa.RecordBatch:
            ids = sorted(held)
            root = settle([held[i][1] for i in ids], np.array([held[i][0] for i in ids]), asked(ids)) if len(ids) > 1 else np.zeros(len(ids), np.int64)
            more = [(ids[r], i) for i, r in zip(ids, root, strict=True) if ids[r] != i and held[i][0] != held[ids[r]][0]]
            return pa.record_batch([pa.array([m[k] for m in more], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for *tile, set_id, root, block, keys, data in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "set_id", "root", "block", "keys", "data")), strict=True):
                if tile != at:
                    yield out()
                    at, held = tile, {}
                held[set_id] = (root, np.frombuffer(data, "<u8"), keys, block)
        yield out()

    told = shared.join(again(sets).select("set_id", "data"), "set_id")
    rows = placed.join(mixed, ["key", "i", "j"]).join(told, "set_id")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def settled_apart(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Staged sets (set_id, size, keys, data) of large clusters, candidates beside their keys (a, b) -> (set_id, root).

    No task holds a cluster: a key's sets meet a centre in bounded parts, and tiles where the key still has several groups.
    """
    keyed = again(sets).select("set_id", "size", F.explode("keys").alias("key"))
    same = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("y")).where("n > 1")
    keyed = keyed.join(same.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "key")  # keys of the same sets once
    keyed = stage(keyed.groupBy("set_id", "size").agg(F.collect_list("key").alias("keys")), "keyed")
    root = again(sets).select("set_id", F.col("set_id").alias("root"))
    found, rest = None, None
    for turn in range(ROUNDS + 1):
        now = keyed.join(root, "set_id").select("set_id", "size", "root", F.explode("keys").alias("key"))  # a set's root is joined once, not under each key
        centre = F.min(F.struct(F.xxhash64("set_id", F.lit(turn)).alias("h"), "set_id", "root")).alias("c")
        uneven = now.groupBy("key").agg(centre, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "c")
        rest = stage(now.join(uneven, "key"), "uneven")
        if turn and rest.isEmpty():
            break
        if turn == ROUNDS:
            more = tiled(rest.select("key", "set_id", "size", "root"), sets)
        else:
            asked = rest.where("root <> c.root").groupBy("set_id").agg(F.min("c").alias("c")).select(F.col("c.set_id").alias("a"), F.col("set_id").alias("b"))
            more = verified(stage(asked.unionByName(links).distinct() if turn == 0 else asked, "asked"), sets)
        more = stage(more, "similar")
        found = more if found is None else found.unionByName(more)
        up = components(found).select(F.col("node").alias("set_id"), F.col("component").alias("root"))
        root = stage(again(sets).select("set_id").join(up, "set_id", "left").select("set_id", F.coalesce("root", "set_id").alias("root")), "roots")
    return root


def print_links(first: DataFrame) -> DataFrame:
    """(set_id, fp) -> edges (a, b) between the sets of equal fingerprints and of those that the pigeonring filter links."""
    named = stage(first.groupBy("fp").agg(F.min("set_id").alias("a")), "named-prints")
    same = first.join(named, "fp").where("set_id <> a").select("a", F.col("set_id").alias("b"))
    links = fingerprint_links(named.select("fp")).select(F.col("a").alias("x"), F.col("b").alias("y"))
    ends = links.join(named.select(F.col("fp").alias("x"), "a"), "x").join(again(named).select(F.col("fp").alias("y"), F.col("a").alias("b")), "y")
    return same.unionByName(ends.select("a", "b"))


def sets_of(told: DataFrame) -> DataFrame:
    """(set_id, text) -> (set_id, data): the set's hashes."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([b.column("set_id"), pa.array([shingles(t).astype("<u8").tobytes() for t in utf8(b.column("text"))], pa.binary())], names=["set_id", "data"])

    return map_batches(told.select("set_id", "text"), run, "set_id long, data binary")


def near_roots(docs: DataFrame) -> DataFrame:
    """docs (doc_id, mark, text) -> (doc_id, mark, root): root names a document's group of near copies.

    mark tells the texts of one doc_id apart. Every input row gives a row; documents without words are copies of each other.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in utf8(b.column("text"))]
        columns = [pa.array([f(s) for s in sets], t) for f, t in ((name, pa.int64()), (len, pa.int64()), (fingerprint, pa.int64()), (bands, pa.list_(pa.int64())))]
        return pa.record_batch([b.column("doc_id"), b.column("mark"), *columns], names=["doc_id", "mark", "set_id", "size", "fp", "keys"])

    docs = docs.select("doc_id", "mark", "text")
    seen = stage(map_batches(docs, run, "doc_id long, mark long, set_id long, size long, fp long, keys array<bigint>"), "shingled")
    one = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "mark"))
    first = stage(seen.groupBy("set_id").agg(one.alias("one"), *(F.first(c).alias(c) for c in ("size", "fp", "keys"))), "sets")
    links = stage(print_links(first), "print-links")
    clusters = components(meetings(first).unionByName(links)).select(F.col("node").alias("set_id"), F.col("component").alias("cluster"))
    members = stage(clusters.join(first.select("set_id", "size", "one.*"), "set_id"), "members")
    large = (F.count("*") > SETS) | (F.sum("size") > WEIGHT)
    members = members.join(again(members).groupBy("cluster").agg(large.alias("large")), "cluster")
    texts = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1))).dropDuplicates(["doc_id", "mark"])
    told = texts.join(members.hint("merge"), ["doc_id", "mark"])  # one plan at every size
    told = stage(told.select("cluster", "set_id", "large", "text"), "told")
    root = stage(settled(told.where("NOT large").drop("large")), "settled")
    apart = stage(sets_of(again(told).where("large")).join(again(first).select("set_id", "size", "keys"), "set_id"), "large-sets")
    if not apart.isEmpty():
        inside = links.join(again(apart).select(F.col("set_id").alias("a")), "a")
        root = root.unionByName(settled_apart(apart, inside))
    rooted = first.select("set_id").join(root, "set_id", "left").select("set_id", F.coalesce("root", "set_id").alias("root"))
    return seen.select("doc_id", "mark", "set_id").join(rooted, "set_id").select("doc_id", "mark", "root")


def near_copies(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, component_id): the smallest doc_id that is reached over near copies, itself included.

    Every input row gives a row; a null doc_id stays null and names no component. Documents without words are copies of each other.
    """
    groups = stage(near_roots(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")), "near-roots")
    lowest = groups.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return groups.join(lowest, "root").select("doc_id", "component_id")
