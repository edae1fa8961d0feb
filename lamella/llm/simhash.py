"""SimHash near-duplicate detection with a pigeonring filter over 64-bit fingerprints.

A fingerprint's eight bytes form a ring. If two fingerprints differ in at most `distance` = 2 bits, some byte starts a
chain all of whose prefixes of l bytes differ in at most floor(l * 2 / 8) bits: none in the first three bytes, at most
one in the first seven. So the first three bytes agree, and of the next two pairs of bytes one agrees too. Each
fingerprint is therefore filed under 16 keys of 40 bits, and only fingerprints that share a key and pass the chain
test get the full Hamming check. A key leaves 24 bits free, so a key never holds more than 2**24 fingerprints; large
keys are searched by one-bit neighbours instead of by pairs, which is exact and linear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forest, map_batches, ship, stage, table, utf8
from .components import components

#: Keys with at most so many fingerprints are searched by pairs.
PAIRS_UP_TO = 48
#: Shingles whose hashes are held at once.
BLOCK = 1 << 16


def simhash(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one UTF-8 text as a signed 64-bit integer; zero without words."""
    w = text.lower().split()
    if not w:
        return 0
    grams = iter([b" ".join(w)]) if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    ones, n = np.zeros(64, np.int64), 0
    while block := list(islice(map(xxhash.xxh64_intdigest, grams, repeat(seed)), BLOCK)):
        ones += bit_counts(np.array(block, "<u8"))
        n += len(block)
    return majority(ones, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes: a bit is one where over half of them have it."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, text: str = "text") -> DataFrame:
    """docs with a column fingerprint (long). A null or empty text has fingerprint zero. `text` is dropped."""
    keep = [c for c in docs.columns if c != text]
    out = docs.select(*keep, F.col(text)).schema

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        prints = pa.array([simhash(t, words) for t in utf8(b.column(text))], pa.int64())
        return pa.record_batch([*(b.column(c) for c in keep), prints], names=[*keep, "fingerprint"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out if f.name != text)
    return map_batches(docs.select(*keep, text), run, f"{fields}, fingerprint long" if keep else "fingerprint long")


def keyed(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) under their 16 pigeonring keys."""

    def key(i: int, half: int) -> F.Column:
        ring = F.col("fp") if i == 0 else F.shiftrightunsigned("fp", 8 * i).bitwiseOR(F.shiftleft("fp", 64 - 8 * i))
        first = ring.bitwiseAND(F.lit(0xFFFFFF))
        pair = F.shiftleft(F.shiftrightunsigned(ring, 24 + 16 * half).bitwiseAND(F.lit(0xFFFF)), 24)
        return first.bitwiseOR(pair).bitwiseOR(F.lit(i << 40 | half << 43))

    return prints.select("fp", F.explode(F.array(*(key(i, half) for i in range(8) for half in (0, 1)))).alias("key"))


def bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64)).astype(np.int64)


def chain_ok(diff: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Whether the chain from byte `start` keeps to its proportional budget at every length."""
    d = np.bitwise_count(diff.view(np.uint8).reshape(-1, 8)).astype(np.int64)
    ring = np.take_along_axis(d, (start[:, None] + np.arange(8)) % 8, 1).cumsum(1)
    return (ring * 8 <= np.arange(1, 9) * distance).all(1)


def link(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the fingerprints of whole keys (sorted by key) that reach all linked ones."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    small = np.repeat(sizes <= PAIRS_UP_TO, sizes)
    a, b = [], []
    for step in range(1, int(min(PAIRS_UP_TO, sizes.max(initial=0)))):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & small[step:])
        diff = fps[at] ^ fps[at + step]
        ok = chain_ok(diff, (keys[at] >> 40) & 7, distance)
        at, diff = at[ok], diff[ok]
        at = at[bits(diff) <= distance]
        a.append(fps[at])
        b.append(fps[at + step])
    for s, n in zip(starts[sizes > PAIRS_UP_TO], sizes[sizes > PAIRS_UP_TO], strict=True):
        x, y = neighbours(fps[s : s + n])
        a.append(x)
        b.append(y)
    if not a:
        return fps[:0], fps[:0]
    return forest(np.concatenate(a), np.concatenate(b))


def neighbours(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all fingerprints at distance 2 or less: two such share a value at distance 1 or less of both."""
    varies = int(np.bitwise_or.reduce(fps ^ fps[0]))
    masks = np.array([0, *(1 << i for i in range(64) if varies >> i & 1)], np.uint64).view(np.int64)
    a, b = [], []
    near = (fps[:, None] ^ masks[None, :]).ravel()
    who = np.repeat(fps, len(masks))
    order = np.argsort(near, kind="stable")
    near, who = near[order], who[order]
    same = np.flatnonzero(near[1:] == near[:-1])
    a.append(who[same])
    b.append(who[same + 1])
    return forest(np.concatenate(a), np.concatenate(b))


def fingerprint_links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (a, b) whose components are those of all pairs at `distance` bits or fewer."""
    if distance != 2:
        raise ValueError("the keys are derived for a distance of 2")
    ship(prints.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = [], []  # the parts of what goes on in the next batch: one key

        def out() -> pa.RecordBatch:
            a, b = link(np.concatenate(keys), np.concatenate(fps), distance)
            return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            last = int(np.searchsorted(k, k[-1]))
            if last or (keys and keys[-1][-1] != k[0]):
                keys.append(k[:last])
                fps.append(f[:last])
                yield out()
                keys, fps = [], []
            keys.append(k[last:])
            fps.append(f[last:])
        if keys:
            yield out()

    return keyed(prints).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame, words: int = 3, distance: int = 2, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, *carry) -> its rows with their fingerprint, and (fingerprint, root, first): a root for each
    component, and the smallest doc_id of each fingerprint. Exact copies meet in one fingerprint, so a group of copies
    costs one row from there on."""
    seen = stage(fingerprints(docs.select("doc_id", *carry, "text"), words), "prints")
    first = stage(seen.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")), "distinct")
    comp = stage(components(fingerprint_links(first.select("fp"), distance)), "components")
    rooted = first.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
    return seen, rooted.select(F.col("fp").alias("fingerprint"), F.coalesce("component", "fp").alias("root"), "first")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, fingerprint long, component_id).

    component_id is the smallest doc_id reachable, itself included. Documents without words have fingerprint zero and
    link like others. Every input row gives a row: repeated rows repeat, a null doc_id stays null and names no component.
    """
    seen, rooted = grouped(docs, words, distance)
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select("fingerprint", "component_id")
    return seen.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def print_roots(docs: DataFrame) -> DataFrame:
    """docs (doc_id, mark, text) -> (doc_id, mark, root): the groups that one_of_each takes by default."""
    seen, rooted = grouped(docs, carry=("mark",))
    return seen.join(rooted, "fingerprint").select("doc_id", "mark", "root")


def one_of_each(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = print_roots) -> DataFrame:
    """docs without near duplicates: of each group that `find` gives a root the document with the smallest doc_id, with all columns.

    A document is a doc_id and a text: rows that repeat both are one document, of which any row stays; a doc_id with
    two texts is two documents. Rows without doc_id come last. `find` takes (doc_id, mark, text) and returns (doc_id,
    mark, root). Texts are shuffled once, by the same plan at every size.
    """
    ident, mark = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), F.xxhash64(F.col("text"), F.col("doc_id").isNull()).alias("mark")
    groups = find(docs.select(ident, mark, "text"))
    kept = stage(groups.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("k")).select("k.doc_id", "k.mark"), "kept")
    documents = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), ident, mark).dropDuplicates(["doc_id", "mark"])
    return documents.join(kept.hint("merge"), ["doc_id", "mark"]).select("row.*")  # the documents kept grow with the input


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
