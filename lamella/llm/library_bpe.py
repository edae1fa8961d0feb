"""Token ids from the tokenizers library, with a bounded memory of words per worker."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Words kept per worker, and the longest word that is kept.
WORDS, LONGEST = 300_000, 48
#: A space with white space on both sides isn't the start of a new piece; such texts are encoded in one go.
INNER = re.compile(r"\s \s")
#: Words that can be encoded in a row: no odd characters, no white space at either end.
PLAIN = re.compile(r"[!-~\xa1-\u024f](?:[\t\n\r!-~\xa1-\u024f]*[!-~\xa1-\u024f])?")
#: Words that go to the library in one row.
ROW = 256


class WordEncoder:
    """Ids of whole texts (two bytes each where the vocabulary allows it, else four).

    Byte-level pre-tokenisation starts a new piece at every single space that has no white space on both sides, so
    a text's ids are those of its space-separated words, each with its space. A batch is split and its words are made
    distinct by Arrow; a distinct word costs one look-up. New words go to the library in rows, and a row's ids fall
    apart again where a token begins with a space.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {}
        space = self.library.encode(" a", add_special_tokens=False).tokens[0][0]
        self.begins = np.zeros(self.library.get_vocab_size(), bool)
        self.begins[[i for t, i in self.library.get_vocab().items() if t[0] == space]] = True

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def found(self, new: list[str]) -> list[bytes]:
        """Ids of words that aren't kept yet, each with a space before it; keeps them as far as there is room."""
        plain = [bool(PLAIN.fullmatch(w)) and "<|" not in w for w in new]
        row = [w for w, p in zip(new, plain, strict=True) if p]
        out: list[bytes] = []
        for e in self.library.encode_batch_fast([" " + " ".join(row[at : at + ROW]) for at in range(0, len(row), ROW)], add_special_tokens=False):
            ids = np.array(e.ids, self.dtype)
            data, at = ids.tobytes(), (np.flatnonzero(self.begins[ids]) * self.dtype.itemsize).tolist()
            out += map(data.__getitem__, map(slice, at, [*at[1:], len(data)]))
        rest = iter(self.direct([" " + w for w, p in zip(new, plain, strict=True) if not p]))
        rows = iter(out)
        out = [next(rows if p else rest) for p in plain]
        room = WORDS - len(self.words)
        self.words.update((w, i) for w, i in zip(new[:room], out, strict=False) if len(w) <= LONGEST)
        return out

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an Arrow column; null is empty."""
        if not len(column):
            return []
        column = column.fill_null("")
        split = pc.split_pattern(column, " ")
        first = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        distinct, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        texts = column.to_pylist()
        odd = [i for i, t in enumerate(texts) if INNER.search(t)]
        ids = list(map(self.words.get, distinct))
        used = np.ones(len(at), bool)
        used[first[:-1] - first[0]] = False
        new = np.flatnonzero(np.isin(np.arange(len(distinct)), at[used]) & np.array([i is None for i in ids], bool))
        for k, v in zip(new.tolist(), self.found([distinct[k] for k in new]), strict=True):
            ids[k] = v
        # what begins a text has no space before it, and odd texts are encoded there as a whole
        heads = [t.split(" ", 1)[0] for t in texts]
        for i in odd:
            heads[i] = texts[i]
            at[first[i] - first[0] : first[i + 1] - first[0]] = len(distinct)
        at[first[:-1] - first[0]] = len(distinct) + 1 + np.arange(len(texts))
        ids = [i or b"" for i in ids] + [b""] + self.direct(heads)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        table = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.frombuffer(b"".join(ids), self.dtype)))
        flat = table.take(pa.array(at)).flatten().to_numpy()
        ends = np.r_[0, np.cumsum(sizes[at])][first[1:] - first[0]]
        return np.split(flat, ends[:-1])


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One for each worker process and vocabulary."""
    return WordEncoder(path)
