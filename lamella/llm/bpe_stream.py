"""Byte-pair encoding as a bounded-lookahead transducer, and an incremental decoder.

The merge list decides how far to the right of a token its presence can depend on what follows: walking the merges in
order of rank, a left part depends on its partner, which depends on what may claim it, and so on. `lookahead` holds
that distance for every symbol. A token is emitted once so many bytes behind its end are known, and encoding goes on
from there, since no merge crosses a token's edge. Every word goes through the transducer; only its results are kept for
words that come again. Ids and text run into digests block by block, with one decoder for a document, so memory stays
constant however long a document, or a word without spaces, is.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table, texts

#: Words kept per worker, the longest word that is kept, and symbols up to which a plain scan beats a heap.
WORDS, LONGEST, SCAN = 400_000, 48, 100
#: Characters that are split at once, longer texts block by block; ids that run into a digest at once; bytes that are decoded at once.
CHARS, IDS, PORTION = 1 << 18, 1 << 14, 1 << 16
SHIFT, NEVER = 20, 1 << 40


def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """A vocabulary file's merges as integers, and each symbol's sufficient lookahead in bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("dropout, byte fallback and ignore_merges aren't supported")
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        self.width = {i: len(t.removesuffix(self.suffix) if self.suffix else t) for t, i in vocab.items()}
        self.pairs: dict[int, int] = {}  # two symbols -> rank
        self.made: list[int] = []  # rank -> symbol
        ahead = dict.fromkeys([*self.inner, *self.final], 1)
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pairs.setdefault(x << SHIFT | y, rank)
            self.made.append(z)
            fx, fy = ahead.get(x, 1), ahead.get(y, 1)
            ahead[z] = max(ahead.get(z, 1), fy, fx - self.width[y])
            ahead[x] = max(fx, self.width[y] + fy)
        self.ahead = ahead
        self.lookahead = max(ahead.values())
        self.window = 2 * (self.lookahead + max(self.width.values()))

    def merge(self, symbols: list[int]) -> list[int]:
        """Applies the merges, lowest rank first, leftmost first."""
        if len(symbols) > SCAN:
            return self.merge_long(symbols)
        rank, made = self.pairs.get, self.made
        ranks = [rank(a << SHIFT | b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            symbols[i : i + 2] = [z := made[best]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(z << SHIFT | symbols[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank(symbols[i - 1] << SHIFT | z, NEVER)
        return symbols

    def merge_long(self, symbols: list[int]) -> list[int]:
        n, rank, made = len(symbols), self.pairs.get, self.made
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank(a << SHIFT | b, NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            symbols[i], symbols[j] = (z := made[r]), -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank(z << SHIFT | symbols[k], NEVER)) < NEVER:
                    heapq.heappush(heap, (r, i, z, symbols[k]))
            if (h := before[i]) >= 0 and (r := rank(symbols[h] << SHIFT | z, NEVER)) < NEVER:
                heapq.heappush(heap, (r, h, symbols[h], z))
        return [s for s in symbols if s >= 0]

    def whole(self, word: bytes) -> list[int]:
        return self.merge([*(self.inner[b] for b in word[:-1]), self.final[word[-1]]])


class Transducer:
    """Takes one word's bytes in any portions; gives its token ids as soon as nothing to come can change them."""

    def __init__(self, merges: Merges, window: int | None = None):
        self.merges, self.window, self.held = merges, window or merges.window, b""

    def feed(self, data: bytes) -> Iterator[int]:
        m = self.merges
        for at in range(0, len(data), self.window):
            self.held += data[at : at + self.window]
            if len(self.held) <= self.window:
                continue
            end, known = 0, len(self.held)
            for token in m.merge([m.inner[b] for b in self.held]):
                if end + m.width[token] + m.ahead.get(token, m.lookahead) > known:
                    break
                end += m.width[token]
                yield token
            self.held = self.held[end:]

    def close(self) -> Iterator[int]:
        if self.held:
            yield from self.merges.whole(self.held)
        self.held = b""


class Decoder:
    """Ids to text, portion by portion: bytes of a character that are split between tokens wait for the rest."""

    def __init__(self, table: dict[int, bytes], between: bytes = b""):
        self.table, self.between, self.begun = table, between, False
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.push(self.between.join(map(self.table.__getitem__, ids)))

    def push(self, data: bytes) -> str:
        """The tokens' bytes themselves, joined by `between`."""
        if data and self.begun:
            data = self.between + data
        self.begun |= bool(data)
        return self.state.decode(data)

    def close(self) -> str:
        return self.state.decode(b"", True)


class Running:
    """A document's count of ids and its two digests, added to block by block."""

    def __init__(self, decoder: Decoder):
        self.n, self.ids, self.text, self.decoder = 0, hashlib.sha256(), hashlib.sha256(), decoder

    def add(self, n: int, ids: bytes, names: bytes) -> None:
        """n ids in decimal and the names of their tokens, each joined by spaces."""
        if not n:
            return
        self.ids.update(b" " + ids if self.n else ids)
        self.n += n
        self.text.update(self.decoder.push(names[:PORTION]).encode())
        for at in range(PORTION, len(names), PORTION):
            self.text.update(self.decoder.state.decode(names[at : at + PORTION]).encode())

    def close(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.close().encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


class WordBpe:
    """The lower-casing word tokenizer: NFC, white space dropped, words and marks apart, merges within a word."""

    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")

    def __init__(self, path: str, window: int | None = None):
        self.merges = Merges(path)
        self.window = window or self.merges.window
        self.names = {i: t.encode() for i, t in self.merges.names.items()}
        letters = {c: b for b, c in enumerate(byte_letters())}
        tail = self.merges.suffix
        self.bytes = {i: t.encode() if t in self.merges.added else bytes(letters[c] for c in t.removesuffix(tail)) + b" " * (bool(tail) and t.endswith(tail)) for i, t in self.merges.names.items()}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.merges.added)) + ")")
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.transducer, self.fed = Transducer(self.merges, self.window), 0  # fed: words so far

    def through(self, word: str) -> Iterator[int]:
        """A word's ids, as the transducer gives them."""
        self.fed += 1
        yield from self.transducer.feed(word.encode())
        yield from self.transducer.close()

    def chunk(self, text: str) -> Iterator[int]:
        """Ids of a normalised text without spaces."""
        if text.isalpha():
            words = [text]
        elif text[-1] in ".," and text[:-1].isalpha():
            words = [text[:-1], text[-1]]
        else:
            words = (m[0] for m in self.SPLIT.finditer(text))
        for word in words:
            yield from self.through(word)

    def digest_of(self, text: str) -> tuple[bytes, bytes]:
        """A chunk's ids in decimal and its tokens' names, each joined by spaces; kept for short chunks."""
        ids = list(self.chunk(text))
        out = " ".join(map(str, ids)).encode(), b" ".join(map(self.names.__getitem__, ids))
        if len(text) <= LONGEST and len(self.known) < WORDS:
            self.known[text] = out
        return out

    def normal(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Normalised stretches of text, and the added tokens between them."""
        for part in self.marks.split(text) if "<|" in text else [text]:
            if part in self.merges.added:
                yield part, self.merges.added[part]
            elif part:
                yield self.normal(part), None

    def encode(self, text: str) -> list[int]:
        return [i for part, added in self.segments(text) for i in ([added] if added is not None else [i for c in part.split(" ") if c for i in self.chunk(c)])]

    def decode(self, ids: Iterable[int]) -> str:
        """As the library's decode for a vocabulary without a decoder: tokens joined by spaces."""
        d = Decoder(self.names, b" ")
        return d.feed(ids) + d.close()

    def plain_text(self, ids: Iterable[int]) -> str:
        """The text that the tokens' bytes spell, a space behind each word."""
        d = Decoder(self.bytes)
        return d.feed(ids) + d.close()

    def joined(self, normal: list[str]) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """For each normalised text: count of ids, ids in decimal, names of the tokens, each joined by spaces.

        Arrow splits the texts, makes their words distinct and puts their results together again.
        """
        split = pc.split_pattern(pa.array(normal, pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        done = [d or (self.digest_of(w) if w else (b"", b"")) for d, w in zip(map(self.known.get, distinct), distinct, strict=True)]
        some = np.array([bool(d[0]) for d in done], bool)
        many = np.array([d[0].count(b" ") + 1 if d[0] else 0 for d in done], np.int64)
        at = coded.indices.to_numpy()
        kept = at[some[at]] if len(at) else at
        starts = split.offsets.to_numpy() - split.offsets[0].as_py()
        ends = pa.array(np.r_[0, np.cumsum(some[at])][starts], pa.int32())
        columns = []
        for k in (0, 1):
            values = pa.array([d[k] for d in done], pa.binary()).take(pa.array(kept))
            columns.append(pc.binary_join(pa.ListArray.from_arrays(ends, values), b" ").to_pylist())
        return np.diff(np.r_[0, np.cumsum(many[at])][starts]), *columns

    def blocks(self, normal: str) -> Iterator[tuple[str, bool]]:
        """A normalised text in blocks that end at spaces, and whether a block is one chunk, longer than others."""
        at = 0
        while at < len(normal):
            end, long = len(normal), False
            if end - at > CHARS:
                cut = normal.rfind(" ", at, at + CHARS)
                long = cut < 0
                end = normal.find(" ", at) if long else cut
                end = len(normal) if end < 0 else end
            yield normal[at:end], long
            at = end + 1

    def streamed(self, text: str) -> tuple[int, str, str]:
        """The digests of a text of any length or with added tokens."""
        out = Running(Decoder(self.names, b" "))
        for part, added in self.segments(text):
            if added is not None:
                out.add(1, b"%d" % added, self.names[added])
                continue
            for block, long in self.blocks(part):
                if long:
                    ids = self.chunk(block)
                    while some := list(islice(ids, IDS)):
                        out.add(len(some), " ".join(map(str, some)).encode(), b" ".join(map(self.names.__getitem__, some)))
                else:
                    n, ids, names = self.joined([block])
                    out.add(int(n[0]), ids[0], names[0])
        return out.close()

    def digests(self, column: pa.Array) -> list[tuple[int, str, str]]:
        """For each text of an Arrow column: count of ids, sha256 of the ids in decimal, sha256 of the decoded text."""
        got = texts(column)
        found: list[tuple[int, str, str]] = [(0, "", "")] * len(got)
        some: list[int] = []
        held = 0
        for i, t in enumerate([*got, None]):
            if t is None or held + len(t) > CHARS:  # what is held goes through as one
                for j, n, ids, names in zip(some, *self.joined([self.normal(got[j]) for j in some]), strict=True):
                    out = Running(Decoder(self.names, b" "))
                    out.add(int(n), ids, names)
                    found[j] = out.close()
                some, held = [], 0
            if t is None:
                break
            if len(t) > CHARS or "<|" in t:
                found[i] = self.streamed(t)
            else:
                some.append(i)
                held += len(t)
        return found


@functools.cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, ids array<int>). Null texts are empty and have no ids."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = word_bpe(vocabulary)
        return pa.record_batch([b.column("doc_id"), pa.array([bpe.encode(t) for t in texts(b.column("text"))], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>", 512)


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, text); null ids give an empty text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        bpe = word_bpe(vocabulary)
        return pa.record_batch([b.column("doc_id"), pa.array([bpe.decode(i or ()) for i in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string", 512)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row. Null texts are empty."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = word_bpe(vocabulary).digests(b.column("text"))
        columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
        return pa.record_batch([b.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe_stream(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))
