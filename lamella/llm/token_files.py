"""Token ids in Arrow stream files of equal-sized batches.

A file is an Arrow IPC stream with two columns of fixed-size lists: `ids` and `mask` (true where an id counts; only a
file's last sequence is padded). All batches but the last have the same number of sequences and no nulls, so they have
the same number of bytes, and batch k begins at header + k * size: a reader maps the file and touches only what it
needs. A file holds a range of doc_id in ascending order; a Parquet index beside it has each document's place.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, ship, stage, table
from .library_bpe import encoder

LENGTH, SEQUENCES, BATCH, END = 2048, 64, 1000, 0


class Writer:
    """Cuts a stream of ids into sequences and writes full batches; holds one batch."""

    def __init__(self, uri: str, dtype: np.dtype, length: int = LENGTH, sequences: int = SEQUENCES):
        where, path = fs.FileSystem.from_uri(uri)
        where.create_dir(path.rpartition("/")[0], recursive=True)
        self.sink = where.open_output_stream(path)
        self.length, self.batch = length, length * sequences
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.field("id", kind, False), length), False), pa.field("mask", pa.list_(pa.field("on", pa.bool_(), False), length), False)])
        self.out = pa.ipc.new_stream(self.sink, self.schema)
        self.dtype, self.held, self.n = dtype, [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.batch:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.batch * self.batch
            for at in range(0, whole, self.batch):
                self.put(flat[at : at + self.batch], self.batch)
            self.held, self.n = [flat[whole:]], len(flat) - whole

    def put(self, ids: np.ndarray, on: int) -> None:
        mask = pa.array(np.arange(len(ids)) < on)
        lists = (pa.FixedSizeListArray.from_arrays(v, type=f.type) for v, f in zip((pa.array(ids), mask), self.schema, strict=True))
        self.out.write_batch(pa.RecordBatch.from_arrays(list(lists), schema=self.schema))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            self.put(np.r_[flat, np.zeros(-len(flat) % self.length, self.dtype)], len(flat))
        self.out.close()
        self.sink.close()


class Reader:
    """Random access by token position, without copies where the file can be mapped."""

    def __init__(self, uri: str):
        where, path = fs.FileSystem.from_uri(uri)
        self.file = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
        self.schema = pa.ipc.read_schema(pa.ipc.read_message(self.file))
        self.length = self.schema.field("ids").type.list_size
        self.header = self.file.tell()
        first = pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)
        self.size, self.batch = self.file.tell() - self.header, first.num_rows * self.length
        self.at, self.ids = 0, first.column(0).values.to_numpy(zero_copy_only=True)

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views of the ids from start, a batch at a time."""
        while n > 0:
            k, inside = divmod(start, self.batch)
            if k != self.at:
                self.file.seek(self.header + k * self.size)
                self.ids = pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema).column(0).values.to_numpy(zero_copy_only=True)
                self.at = k
            view = self.ids[inside : inside + n]
            yield view
            start, n = start + len(view), n - len(view)

    def masks(self, sequence: int) -> np.ndarray:
        """The mask of one sequence."""
        k, row = divmod(sequence, self.batch // self.length)
        self.file.seek(self.header + k * self.size)
        b = pa.ipc.read_record_batch(pa.ipc.read_message(self.file), self.schema)
        return b.column(1).values.slice(row * self.length, self.length).to_numpy(zero_copy_only=False)


def crc_of(views: Iterable[np.ndarray]) -> int:
    c = 0
    for v in views:
        c = zlib.crc32(v.astype("<u4"), c)
    return c


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end: int = END) -> DataFrame:
    """Writes docs (doc_id, text) in ascending doc_id order; returns the index (part, path, doc_id, place, n_tokens).

    Null texts are empty; every document ends with `end`; repeated doc_ids follow each other. A task that runs again
    writes another file, and the index names the one that counts.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary), TaskContext.get()
        path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.arrows"
        last, out, place = np.array([end], encode.dtype), None, 0
        for whole, at in ((b, at) for b in batches for at in range(0, b.num_rows, BATCH)):
            b = whole.slice(at, BATCH)
            out = out or Writer(path, encode.dtype)
            n = []
            for ids in encode(b.column("text")):
                out.add(ids)
                out.add(last)
                n.append(len(ids) + 1)
            n = np.array(n, np.int64)
            places = place + np.cumsum(n) - n
            place += int(n.sum())
            yield pa.record_batch([pa.array([task.partitionId()] * len(n), pa.int32()), pa.array([path] * len(n)), b.column("doc_id"), pa.array(places), pa.array(n)], names=["part", "path", "doc_id", "place", "n_tokens"])
        if out:
            out.close()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stage(ordered.mapInArrow(run, "part int, path string, doc_id long, place long, n_tokens long"), "token-index")


def read_tokens(index: DataFrame) -> DataFrame:
    """The index with start (ids of all documents before) and the crc32 of each document's ids, from the files."""
    spark = index.sparkSession
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for b in batches:
            crc = []
            for p, place, n in zip(b.column("path").to_pylist(), b.column("place").to_pylist(), b.column("n_tokens").to_pylist(), strict=True):
                if p != path:
                    path, file = p, Reader(p)
                crc.append(crc_of(file.tokens(place, n)))
            yield pa.record_batch([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = index.join(before, "part").select("doc_id", "path", "place", "n_tokens", (F.col("before") + F.col("place")).alias("start"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartition(parts, "path", F.floor(F.col("place") / (LENGTH * SEQUENCES * 16))).sortWithinPartitions("path", "place")
    return ordered.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    index = write_tokens(table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), vocabulary)
    return read_tokens(index)
