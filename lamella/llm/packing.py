"""Sum-of-squares packing of token sequences.

Let N(g) be the number of open sequences with g free tokens. Each piece goes where the sum of N(g)^2 is smallest
afterwards: into a new sequence, or into an open one of any gap that holds it. Keeping the counts of all gaps low
keeps gaps of every size on offer, and so waste low. Of equally good places an open sequence comes before a new one,
and a smaller gap before a larger one. Pieces are dealt evenly over groups of about `GROUP` pieces, repeated rows as
well, and taken in the order of a hash; every group is packed apart. What a group's end leaves open with more than
1/`SLACK` of its room is taken out and placed once more by the same rule, largest first, where a new sequence is
opened only for a piece that no open one holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, ship, stage, table
from .library_bpe import encoder

CAPACITY, GROUP, SLACK, END = 2048, 50_000, 256, 0
FULL_FROM, PACKED_FROM = 1 << 62, 1 << 61


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, piece, start, length, ids_crc32): longer documents are cut, the first piece takes the rest."""
    ship(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(vocabulary)
        rows, piece, start, length, crc = [], [], [], [], []
        for i, ids in enumerate(encode(b.column("text"))):
            ids = np.r_[ids, encode.dtype.type(end)].astype("<u4")
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                rows.append(i)
                piece.append(k)
                start.append(s)
                length.append(e - s)
                crc.append(zlib.crc32(ids[s:e]))
        return pa.record_batch([b.column("doc_id").take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(items: list[int], sizes: np.ndarray, capacity: int = CAPACITY, sparing: bool = False) -> list[list[int]]:
    """The sequences, each a list of items (places in `sizes`, of 1 to capacity), by the rule of least squares.

    sparing: a new sequence is opened only where no open one holds the item.
    """
    count = np.zeros(capacity + 1, np.int64)  # of open sequences by gap; 0 and capacity stay 0
    by_gap: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    never = np.int64(1 << 60)
    for i in items:
        s, into = int(sizes[i]), capacity
        if s < capacity:
            # from gap g to g - s: the squares change by 2 (N(g - s) - N(g)) + 2, by one less where nothing is left
            change = np.where(count[s:capacity] > 0, 2 * (count[: capacity - s] - count[s:capacity]) + 2, never)
            change[0] -= 1
            best = int(change.argmin())
            if change[best] < never - 1 and (sparing or change[best] <= 2 * count[capacity - s] + 1):
                into = best + s
        if into == capacity:
            at = len(bins)
            bins.append([i])
        else:
            at = by_gap[into].pop()
            bins[at].append(i)
            count[into] -= 1
        if left := into - s:
            by_gap.setdefault(left, []).append(at)
            count[left] += 1
    return bins


def sum_of_squares(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """The sequences of a whole group, each a list of places in `sizes`."""
    bins = place(list(range(len(sizes))), sizes, capacity)
    full = [int(sizes[b].sum()) >= capacity - capacity // SLACK for b in bins]
    rest = sorted((i for b, f in zip(bins, full, strict=True) if not f for i in b), key=lambda i: -sizes[i])
    return [b for b, f in zip(bins, full, strict=True) if f] + place(rest, sizes, capacity, sparing=True)


def packed(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to pieces. Full pieces have a sequence each."""
    ship(found.sparkSession)
    n = found.where(F.col("length") < capacity).count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if not got or not got.num_rows:
            return
        sizes = got["length"].to_numpy()
        bins = sum_of_squares(sizes, capacity)
        order = np.concatenate([np.array(b) for b in bins])
        lengths = np.array([len(b) for b in bins])
        number = PACKED_FROM + (TaskContext.get().partitionId() << 32) + np.repeat(np.arange(len(bins)), lengths)
        ends = np.cumsum(sizes[order])
        firsts = np.repeat((ends - sizes[order])[np.cumsum(lengths) - lengths], lengths)
        out = got.take(pa.array(order)).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(ends - sizes[order] - firsts))
        yield from out.to_batches(max_chunksize=10_000)

    rest = found.where(F.col("length") < capacity)
    deal = F.xxhash64("doc_id", "piece", "ids_crc32")
    rest = rest.repartition(max(1, -(-n // group))).sortWithinPartitions(deal, "doc_id", "piece")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    full = found.where(F.col("length") == capacity).select("*", (F.monotonically_increasing_id() + F.lit(FULL_FROM)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest.mapInArrow(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """docs (doc_id, text) -> one row per piece with its sequence and offset there. Null texts are empty (one end id)."""
    return packed(stage(pieces(docs, vocabulary, capacity), "pieces"), capacity)


def op10_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
