"""Near duplicates, vectors, shards, packing and the pipeline against brute force."""

import math
import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamella.llm import cover, near, packing, sharding, simhash, topk
from lamella.llm.common import forest
from lamella.llm.components import components
from lamella.llm.queries import oracle_sql, queries
from lamella.llm.vectors import sharded

BYTE = public_tokenizers.path("byte_bpe_50k.json")


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute_fingerprint(text, words=3):
    w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if x]
    grams = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, make):
    r = random.Random(0)
    words = [f"w{i}" for i in range(50)]
    base = [" ".join(r.choice(words) for _ in range(300)) for _ in range(6)]
    texts = [None, "", "one", "ONE", "two words", "Ä ä\x1cx\tb\nc\rd"] + base
    for b in base:  # near copies: a word or two changed
        for _ in range(12):
            w = b.split()
            w[r.randrange(300)] = r.choice(words)
            texts.append(" ".join(w))
    texts += [base[0]] * 5
    docs = make(*((1000 - i, t) for i, t in enumerate(texts)), extra=True)
    got = simhash.near_duplicates(docs).collect()
    prints = {1000 - i: brute_fingerprint(t or "") for i, t in enumerate(texts)}
    s = Sets()
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                s.join(a, b)
    assert {(x.doc_id, x.fingerprint % 2**64, x.component_id) for x in got} == {(i, f, s.find(i)) for i, f in prints.items()}
    kept = simhash.one_of_each(docs.unionByName(docs))
    assert sorted(x.doc_id for x in kept.collect()) == sorted({s.find(i) for i in prints}) and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    assert simhash.one_of_each(make((None, "a b c"), (None, "a b c"), (None, "x y z"))).count() == 2


def brute_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies(spark, make):
    """Edited copies against brute force over all pairs; two words in a hundred changed is far beyond 2 bits."""
    r = random.Random(0)
    words = [f"w{i}" for i in range(500)]
    texts = [None, "", "one", "ONE", "two words", "a b c d e f", "A b c d e f"]
    for n in (12, 40, 100, 300):
        for _ in range(4):
            base = [r.choice(words) for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(10):
                w = list(base)
                for _ in range(r.randint(1, max(1, n // 40))):
                    w[r.randrange(n)] = r.choice(words)
                texts.append(" ".join(w))
    texts += [texts[20]] * 30
    sets = {1000 - i: brute_shingles(t) for i, t in enumerate(texts)}
    s, far = Sets(), 0
    for a in sets:
        for b in sets:
            if a < b and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])):
                s.join(a, b)
                far += (simhash.simhash((texts[1000 - a] or "").encode()) ^ simhash.simhash((texts[1000 - b] or "").encode())).bit_count() > 2
    assert far > 100
    docs = make(*((1000 - i, t) for i, t in enumerate(texts)), extra=True)
    assert {(x.doc_id, x.component_id) for x in near.near_copies(docs).collect()} == {(i, s.find(i)) for i in sets}
    kept = corpus_pipeline.near_duplicates(spark, docs.unionByName(docs), "")
    assert sorted(x.doc_id for x in kept.collect()) == sorted({s.find(i) for i in sets}) and kept.columns == docs.columns
    assert near.near_copies(docs.where("false")).count() == 0
    # links of the pigeonring filter are candidates too, with no min-hashes at all
    prints = near.print_links(spark.createDataFrame([(1, 7), (2, 7), (3, 6), (4, -1)], "set_id long, fp long"))
    assert {frozenset(x) for x in prints.collect()} == {frozenset((1, 2)), frozenset((1, 3))}


def test_texts_of_one_id_stay(spark, make):
    """A doc_id with two texts is two documents; rows that repeat both are one; rows without doc_id go last."""
    far, near_, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    docs = make((7, far), (7, near_), (7, near_), (9, near_), (None, other), (None, other), (8, far), (None, far), (5, None), (6, "")).selectExpr("*", "1 AS mark", "2 AS root", "3 AS row")
    for find in (simhash.print_roots, near.near_roots):
        kept = simhash.one_of_each(docs, find)
        assert kept.columns == docs.columns
        assert sorted((-1 if x.doc_id is None else x.doc_id, x.text) for x in kept.collect() if x.text) == [(-1, other), (7, far), (7, near_)]
        assert [x.doc_id for x in kept.collect() if not x.text] == [5]


def test_settle_is_exact():
    r = np.random.default_rng(0)
    for _ in range(40):
        sets = [np.unique(r.choice(60, r.integers(1, 40))).astype(np.uint64) for _ in range(3)]
        for _ in range(40):
            x = sets[r.integers(len(sets))]
            sets.append(np.unique(np.r_[x[r.random(len(x)) < 0.93], r.choice(60, r.integers(0, 3)).astype(np.uint64)])[:50])
        sets = [np.array(x, np.uint64) for x in {tuple(x.tolist()) for x in sets} if len(x)]
        s = Sets()
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if len(np.intersect1d(a, b)) * 5 >= 4 * len(np.union1d(a, b)):
                    s.join(i, j)
        assert near.settle(sets).tolist() == [s.find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("rounds", "sets", "weight"), [(0, 8, 1 << 20), (2, 8, 1 << 20), (2, 256, 400)])
def test_large_clusters_are_settled_alike(spark, make, monkeypatch, rounds, sets, weight):
    """Clusters beyond a task's bound, with groups on both sides of the least similarity, against brute force over all pairs."""
    r = random.Random(1)
    texts = []
    for n in (30, 90):
        base = [f"w{r.randrange(900)}" for _ in range(n)]
        for _ in range(60):
            w = list(base)
            for _ in range(r.randint(1, max(2, n // 12))):
                w[r.randrange(n)] = f"v{r.randrange(900)}"
            texts.append(" ".join(w))
    said, s = [brute_shingles(t) for t in texts], Sets()
    for a, b in ((a, b) for a in range(len(texts)) for b in range(a)):
        if len(said[a] & said[b]) >= 0.8 * len(said[a] | said[b]):
            s.join(a, b)
    wanted = {(i, s.find(i)) for i in range(len(texts))}
    assert 10 < len({c for _, c in wanted}) < len(texts) - 10
    apart, seen = near.settled_apart, []
    monkeypatch.setattr(near, "settled_apart", lambda rows, links: seen.append(rows.count()) or apart(rows, links))
    for name, value in (("ROUNDS", rounds), ("SETS", sets), ("WEIGHT", weight)):
        monkeypatch.setattr(near, name, value)
    assert {(x.doc_id, x.component_id) for x in near.near_copies(make(*enumerate(texts), extra=True)).collect()} == wanted
    assert seen[0] > 60


def test_tiles_grow_with_a_large_group(spark, monkeypatch):
    """A key's large group and a few sets beside it: rows sent to tiles grow in proportion, and all pairs of two groups are compared."""
    monkeypatch.setattr(near, "SETS", 8)
    rows, keep = [], near.stage
    monkeypatch.setattr(near, "stage", lambda df, name: (rows.append((out := keep(df, name)).count()), out)[1] if name == "tiles" else keep(df, name))

    def edges(n):
        said = {i: np.arange(100 * (i >= n) * (i - n + 1), 100 * (i >= n) * (i - n + 1) + 50) for i in range(n + 4)}
        said |= {i: np.r_[said[i], 1000 + i] for i in range(n)}  # n sets of one group
        said |= {n: np.r_[np.arange(49), 1003, 1004], n + 3: np.r_[said[n + 2][:45], 2000 + np.arange(6)]}  # like the group, and like the third
        sets = spark.createDataFrame([(i, s.astype("<u8").tobytes()) for i, s in said.items()], "set_id long, data binary")
        rest = spark.createDataFrame([(k, i, len(s), max(0, i - n + 1)) for k in (5, 6) for i, s in said.items()], "key long, set_id long, size long, root long")
        return {frozenset((max(0, x.a - n + 1), max(0, x.b - n + 1))) for x in near.tiled(rest, keep(sets, "sets")).collect()}

    assert edges(60) == edges(120) == {frozenset((0, 1)), frozenset((3, 4))}
    assert rows[1] < 2.5 * rows[0] and rows[1] < 4 * 2 * 124


@pytest.mark.parametrize("pairs", [0, 5, 48])
def test_links_are_exact(spark, monkeypatch, pairs):
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", pairs)
    r = random.Random(pairs)
    heart = [r.getrandbits(64) for _ in range(3)]
    fps = sorted({h ^ sum(1 << b for b in set(r.choices(range(64), k=r.randint(0, 4)))) for h in heart for _ in range(150)})
    keys, vals = [], []
    for f in fps:
        for i in range(8):
            ring = (f >> 8 * i | f << 64 - 8 * i) & (2**64 - 1)
            for half in (0, 1):
                keys.append((ring & 0xFFFFFF) | ((ring >> 24 + 16 * half) & 0xFFFF) << 24 | i << 40 | half << 43)
                vals.append(f)
    k, v = np.array(keys, np.int64), np.array(vals, np.uint64).view(np.int64)
    order = np.argsort(k, kind="stable")
    a, b = simhash.link(k[order], v[order], 2)
    ours, want = Sets(), Sets()
    for x, y in zip(a.view(np.uint64).tolist(), b.view(np.uint64).tolist(), strict=True):
        ours.join(x, y)
    for x in fps:
        for y in fps:
            if (x ^ y).bit_count() <= 2:
                want.join(x, y)
    parts = lambda s: {frozenset(g) for g in groups(s, fps)}
    assert parts(ours) == parts(want)


def groups(s, items):
    out = defaultdict(set)
    for x in items:
        out[s.find(x)].add(x)
    return out.values()


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    r.shuffle(edges)
    s = Sets()
    for a, b in edges:
        if a != b:
            s.join(a, b)
    got = components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()
    assert {(x.node, x.component) for x in got} == {(n, s.find(n)) for n in s.up}
    a, b = (np.array(x) for x in zip(*edges, strict=True))
    assert dict(zip(*map(np.ndarray.tolist, forest(a, b)), strict=True)) == {n: s.find(n) for n in s.up if s.find(n) != n}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(spark, n=400, dim=16, seed=0):
    r = np.random.default_rng(seed)
    hearts = r.normal(size=(12, dim))
    x = np.concatenate([hearts[r.integers(0, 12, n // 2)] + r.normal(0, 0.12, (n // 2, dim)), r.normal(size=(n - n // 2, dim))])
    x[20:60] = x[20]
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    odd = [(n, None), (n + 50 - n % 50, []), (n + 1, [1.0] * (dim - 1) + [None]), (n + 2, [math.nan] * dim), (n + 3, [0.0] * dim), (n + 4, [1.0, 2.0]), (None, [1.0] * dim), (n + 5, [1e30] * dim)]
    return rows, odd, "vec_id long, embedding array<float>"


@pytest.mark.parametrize("shard", [60, 4096])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(topk.sharded, "__defaults__", (shard,))
    rows, odd, schema = vectors(spark)
    df = spark.createDataFrame(rows + odd, schema).selectExpr("*", "1 AS score", "0 AS shard")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(df).collect()}
    ok = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in rows + odd if i is not None and v and None not in v and np.isfinite(v).all()}
    want = {}
    for q in (i for i in ok if i % 50 == 0):
        s = sorted(((max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(ok[q], ok[c], strict=True)))), -c) for c in ok if c != q and len(ok[c]) == len(ok[q])), reverse=True)
        want |= {(q, k + 1): (-c, v) for k, (v, c) in enumerate(s[:5])}
    assert got == want
    assert topk.top_k(df.where("vec_id % 50 <> 0")).count() == 0
    assert topk.top_k(df.where("false")).count() == 0
    assert topk.top_k(df.where("vec_id IN (0, 1, 2)")).count() == 2


@pytest.mark.parametrize("shard", [50, 4096])
def test_cover_tree(spark, monkeypatch, shard):
    monkeypatch.setattr(cover, "SHARD", shard)
    monkeypatch.setattr(cover, "PER_PIVOT", shard * 2)
    rows, odd, schema = vectors(spark, seed=shard)
    df = spark.createDataFrame(rows + odd, schema).selectExpr("*", "1 AS n", "0 AS cell")
    ok = {i: np.array(v, float) for i, v in rows + odd if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)}
    s, links = Sets(), defaultdict(int)
    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]):
                x, y = (np.float64(np.float32(v)) / np.abs(v).max() for v in (ok[a], ok[b]))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                    s.join(a, b)
                    links[a] += 1
                    links[b] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover.near_vectors(df).collect()}
    assert got == {i: (links[i], s.find(i) if i is not None else None, i is not None and s.find(i) == i) for i, _ in rows + odd}
    assert cover.near_vectors(df.where("false")).count() == 0


def test_shard_pairs_are_not_shuffled(spark, monkeypatch):
    """Shards that no radius keeps apart meet where they are read: what is shuffled doesn't grow with the pairs."""
    plans, keep = {}, cover.stage
    monkeypatch.setattr(cover, "SHARD", 30)
    monkeypatch.setattr(cover, "stage", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), keep(df, name))[1])
    x = np.random.default_rng(3).normal(size=(200, 16))
    x[100:] = x[:100] + np.random.default_rng(4).normal(size=(100, 16)) * 0.1
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in cover.near_vectors(rows).collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == dict(enumerate(((y @ y.T >= 0.9).sum(1) - 1).tolist())) and sum(got.values()) >= 190
    assert "Exchange" in plans["covers"] and "Exchange" not in plans["links"]


def test_packed_vectors_are_exact():
    x = np.array([[1.5, -2.0], [0.1, 3.0], [1e300, 1.0]])
    assert cover.packed(x[:1]).dtype == np.float32 and cover.packed(x[1:2]).dtype == np.float64 and cover.packed(x).dtype == np.float64
    assert (cover.scaled(cover.packed(x[:1])) == cover.scaled(x[:1])).all()


def test_every_length_has_shards(spark):
    """More than 4096 lengths of vectors: all keep their rows."""
    rows = spark.range(5000).selectExpr("id AS vec_id", "CAST(id AS int) AS dim", "CAST('x' AS binary) AS vec")
    assert sharded(rows).count() == 5000


def test_cover_tree_levels():
    x = np.random.default_rng(0).normal(size=(500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = cover.cover_tree(x)
    for k in range(len(t["start"])):
        own = t["order"][t["start"][k] : t["end"][k]]
        assert np.linalg.norm(x[own] - x[own[0]], axis=1).max() <= t["radius"][k] + 1e-6
        kids = range(t["child"][k], t["child"][k] + t["children"][k])
        if kids:
            heads = t["order"][t["start"][list(kids)]]
            assert heads[0] == own[0] and max(t["radius"][j] for j in kids) <= t["radius"][k] / 2 + 1e-6
            d = np.linalg.norm(x[heads][:, None] - x[heads][None], axis=2) + 9 * np.eye(len(heads))
            assert d.min() > t["radius"][k] / 2 - 1e-6


def test_sharding(spark, make):
    r = random.Random(0)
    texts = ["x" * r.randint(1, 900) + "\n" * r.randint(0, 9) + "é" * r.randint(0, 50) for _ in range(3000)] + ["copy " * 40] * 1500 + [None, "", None]
    docs = make(*enumerate(texts), (7, "again"), (None, "no id"), (2**60, "big id"), extra=True)
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == docs.count() and {x.law for x in rows} == {"bytes"} and {x.grown_shard for x in rows} == {None}
    size, slots, first = defaultdict(int), defaultdict(list), defaultdict(set)
    for x in rows:
        size[x.shard] += x.size
        slots[x.shard].append(x.slot)
        first[x.text_crc32, x.size].add(x.shard)
        if x.doc_id is not None and x.doc_id < len(texts) and x.doc_id != 7:
            data = (texts[x.doc_id] or "").encode()
            assert (x.size, x.text_crc32) == (len(data) + 8, zlib.crc32(data))
    assert set(size) == set(range(24)) and max(size.values()) - min(size.values()) < 0.03 * np.mean(list(size.values()))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sum(len(v) > 1 for v in first.values()) <= 1  # only the large group is cut
    assert sharding.shard_documents(docs.where("false")).count() == 0
    assert sharding.shard_documents(docs.limit(3)).count() == 3


def test_packing(spark, make):
    texts = ["word " * n for n in (1, 10, 2047, 2048, 2049, 5000, 300, 900)] + [None, "", "a b c"] * 30
    docs = make(*enumerate(texts), (3, "same id"), extra=True)
    rows = packing.pack_documents(docs, BYTE).collect()
    library = Tokenizer.from_file(BYTE)
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    at, total = defaultdict(list), 0
    for x in rows:
        total += x.length
        at[x.sequence_id].append((x.offset, x.length))
        if x.doc_id != 3:
            assert zlib.crc32(ids[x.doc_id][x.start : x.start + x.length]) == x.ids_crc32
    for i, v in ids.items():
        own = sorted((x.piece, x.start, x.length) for x in rows if x.doc_id == i)
        if i != 3:
            assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for _, _, n in own) == len(v)
            assert all(n == 2048 for _, _, n in own[1:]) and (len(own) > 1) == (len(v) > 2048)
    for v in at.values():
        ends = np.cumsum([n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert len(at) <= -(-total // 2048) + 2
    assert packing.pack_documents(docs.where("false"), BYTE).count() == 0


@pytest.mark.parametrize("sparing", [False, True])
def test_every_piece_goes_where_squares_are_least(sparing):
    """Brute force: all places of a piece with the whole sum of squares afterwards, ties as the module states."""
    r = np.random.default_rng(4)
    for capacity in (1, 2, 7, 30):
        sizes = r.integers(1, capacity + 1, 120)
        bins, room = [], []
        for i, s in enumerate(sizes.tolist()):
            options = []
            for gap in sorted({g for g in room if g >= s and 0 < g < capacity}) + [capacity]:
                after = list(room)
                if gap == capacity:
                    after.append(capacity - s)
                else:
                    after[len(room) - 1 - room[::-1].index(gap)] = gap - s
                squares = sum(after.count(g) ** 2 for g in set(after) if 0 < g < capacity)
                options.append((sparing and gap == capacity, squares, gap))
            gap = min(options)[2]
            at = len(bins) if gap == capacity else None
            if at is None:  # of the sequences with this gap the one that got it last
                at = max((k for k, g in enumerate(room) if g == gap), key=lambda k: bins[k][-1])
            if at == len(bins):
                bins.append([])
                room.append(capacity)
            bins[at].append(i)
            room[at] -= s
        assert packing.place(list(range(len(sizes))), sizes, capacity, sparing) == bins


def test_repeated_rows_are_spread(spark, make):
    """Rows without doc_id and with one text don't meet in one group."""
    found = spark.range(4000).selectExpr("CAST(NULL AS long) AS doc_id", "0 AS piece", "CAST(0 AS long) AS start", "CAST(300 AS long) AS length", "CAST(9 AS long) AS ids_crc32")
    rows = packing.packed(found, group=500).groupBy(F.shiftright("sequence_id", 32).alias("g")).count().collect()
    assert len(rows) == 8 and max(x["count"] for x in rows) <= 600


def test_sum_of_squares_is_near_the_least():
    r = np.random.default_rng(0)
    sizes = np.minimum(2047, r.lognormal(6, 0.9, 20_000).astype(int) + 1)
    bins = packing.sum_of_squares(sizes)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and max(sizes[b].sum() for b in bins) <= 2048
    assert len(bins) <= 1.001 * sizes.sum() / 2048 + 2


def test_pipeline(spark, make, tmp_path):
    r = random.Random(0)
    words = {"en": ["the", "and", "with", "house", "water", "this", "other", "never"], "de": ["der", "und", "nicht", "häuser", "wasser", "diese", "schön", "immer"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(60)) + (" idiot vequa" if i % 5 == 0 else "") + (f" mail a{i}@b.org" if i % 3 == 0 else ""), lang) for i, lang in ((i, ("en", "de")[i % 2]) for i in range(400))]
    clean = [(1000 + k, rows[1][1], "de") for k in range(5)]
    junk = [(2000, None), (2001, "123 456"), (2002, "")]
    make(*rows, *clean, *junk).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {x.doc_id for x in docs.select("doc_id").collect()}
        assert name == "packing" or docs.columns == columns
    assert not kept["language"] & {2000, 2001, 2002} and len(kept["language"]) >= 400
    assert not [i for i in kept["toxicity"] if i < 400 and i % 5 == 0] and len(kept["toxicity"]) >= 320
    assert not kept["near_duplicates"] & {1000, 1001, 1002, 1003, 1004} and 1 in kept["near_duplicates"]
    texts = [x.text for x in spark.read.parquet(str(tmp_path / "personal_data")).collect()]
    assert not any("@" in t for t in texts) and any("[EMAIL]" in t for t in texts)
    assert kept["packing"] == kept["personal_data"]
    assert corpus_pipeline.run(spark, str(tmp_path)).select(F.countDistinct("doc_id")).first()[0] == len(kept["packing"])


def test_registered():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in queries())] == []
    assert "pipeline" in queries() and set(oracle_sql()) <= set(queries())
