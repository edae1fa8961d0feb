"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased and every run of other characters than letters counts as spaces; its n-grams of 1 to 3 characters
are hashed into `DIM` features. A feature is its share of the text's n-grams times its inverse document frequency over
all documents that may be learned from. Weights are trained by follow-the-regularised-leader with an elastic net on a
bounded sample of labelled rows, on the driver; a fifth of the sample sets the temperature. Prediction is one table
look-up per n-gram, over the whole text.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, rows_where, ship, table, texts

DIM, SCALE, BLOCK = 1 << 15, 30.0, 1 << 16
#: The training sample: rows per language, rows in all to which these are cut down, but not below the floor, and the longest text that is taken.
PER_LANGUAGE, SAMPLE, FLOOR, SAMPLE_CHARS = 700, 6000, 60, 20_000
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> Iterator[tuple[np.ndarray, bool]]:
    """Hashed n-grams of a text, block by block, each with whether the block has a letter."""
    last = np.empty(0, np.uint32)
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        is_letter = letters()[codes]
        new = np.where(is_letter, codes, 32).astype(np.uint32)
        new = new[np.r_[not (len(last) and last[-1] == 32 and new[0] == 32), (new[1:] != 32) | (new[:-1] != 32)]]
        c = np.r_[last, new]  # the last two characters before begin n-grams that end here
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint32(0x85EBCA6B) + c[2:]
        h = np.concatenate([new * np.uint32(0xC2B2AE35), two[max(0, len(last) - 1) :] * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)])
        last = c[-2:]
        yield (h >> np.uint32(32 - 15)).astype(np.int32), bool(is_letter.any())


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and their shares."""
    got = [h for h, _ in ngrams(text)]
    if not got:
        return np.empty(0, np.int64), np.empty(0)
    at, n = np.unique(np.concatenate(got), return_counts=True)
    return at, n / n.sum()


@dataclass
class Model:
    """table: weight times idf of each feature (DIM, languages); scores are divided by the temperature."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str) -> tuple[str, float]:
        """(und, 0.0) without letters or without anything learned."""
        total, n, seen = np.zeros(len(self.languages)), 0, False
        for h, some in ngrams(text):
            total += self.table.take(h, 0).sum(0, dtype=np.float64)
            n += len(h)
            seen |= some
        if not seen or not self.languages:
            return UNKNOWN, 0.0
        z = (self.bias + SCALE * total / n) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        return self.languages[int(p.argmax())], float(p.max())


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows of docs: how many have each feature, and how many there are."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for b in batches:
            for t in texts(b.column("text")):
                seen = np.zeros(DIM, bool)
                for h, _ in ngrams(t):
                    seen[h] = True
                df += seen
                n += 1
        at = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.r_[-1, at]), pa.array(np.r_[n, df[at]])], names=["feature", "n"])

    out, total = np.zeros(DIM, np.int64), 0
    for feature, n in docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():
        if feature < 0:
            total = n
        else:
            out[feature] = n
    return out, total


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal with an elastic net; gives weights (DIM, k) and a bias."""
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))

    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, x = np.r_[rows[i][0], DIM], np.r_[rows[i][1], 1.0]
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / alpha * w
            n[at] = new
    w = weights(slice(None))
    return w[:DIM], w[DIM]


def calibrated(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the smallest log loss."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        s = scores / t
        top = s.max(1, keepdims=True)
        return float((np.log(np.exp(s - top).sum(1)) + top[:, 0] - s[np.arange(len(y)), y]).mean())

    return float(min(np.geomspace(0.05, 20, 121), key=loss))


def train(labelled: DataFrame) -> Model:
    """labelled (doc_id, text, lang): document frequencies from all rows, weights from a bounded sample.

    Every language has its share of the sample, so it has about max(SAMPLE, languages x FLOOR) rows, twice that at most.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    short = rows.where(F.length("text") <= SAMPLE_CHARS)
    sizes = {r[0]: r[1] for r in short.groupBy("lang").count().collect()}
    df, total = document_frequency(rows)
    idf = np.log((1 + total) / (1 + df)) + 1
    if not sizes:
        return Model([], np.zeros((DIM, 0), np.float32), np.zeros(0), 1.0)
    each = min(PER_LANGUAGE, max(FLOOR, SAMPLE // len(sizes)))
    part = labelled.sparkSession.createDataFrame([(lang, 1_000_000 * each / n) for lang, n in sizes.items()], "lang string, part double")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "text"))  # a doc_id may repeat without end
    drawn = short.join(F.broadcast(part), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("part"))
    sample = drawn.withColumn("place", place).where(F.col("place") <= 2 * each).select("doc_id", "text", "lang").toPandas()
    sample = sample if len(sample) else short.orderBy("doc_id", "text").limit(FLOOR).select("doc_id", "text", "lang").toPandas()
    sample = sample.sort_values(["doc_id", "text"], kind="stable")
    languages = sorted(sample["lang"].unique())
    y = sample["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy()
    x = [(at, SCALE * share * idf[at]) for at, share in map(counts, sample["text"])]
    kept = np.arange(len(x)) % 5 != 4
    w, bias = ftrl([r for r, k in zip(x, kept, strict=True) if k], y[kept], len(languages))
    scores = np.array([bias + r[1] @ w[r[0]] for r, k in zip(x, kept, strict=True) if not k]).reshape(-1, len(languages))
    return Model(languages, (w * idf[:, None]).astype(np.float32), bias, calibrated(scores, y[~kept]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, lang_pred, score). Null texts and texts without a letter are und with score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        found = [m.predict(t) for t in texts(b.column("text"))]
        return pa.record_batch([b.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, with all columns, whose language is known with a score of at least `least`.

    Where no language was learned, as no row has a label, all documents with a letter stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batch: list[str]) -> list[bool]:
        if not sent.value.languages:
            return [any(some for _, some in ngrams(t)) for t in batch]
        return [lang != UNKNOWN and score >= least for lang, score in map(sent.value.predict, batch)]

    return rows_where(docs, judge)


def remainder(by: int) -> F.Column:
    """crc32 of the doc_id as text, by a divisor; null ids give -1."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(by)), F.lit(-1))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where((remainder(4) != 2) & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")
