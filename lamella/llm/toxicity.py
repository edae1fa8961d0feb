"""Toxicity by weak supervision.

Voters look at the words of a text: fixed lexicon entries, words and word beginnings mined from the labelled rows, and
patterns of shouting and address. The labels do no more than choose the mined voters. A generative label model explains
who fires by a latent class: every voter has its own chance to fire under either class, and voters that are correlated
beyond the class form a forest, in which a voter's chance also depends on whether its parent fired. It is fitted by
expectation maximisation on the votes of a bounded sample, without the labels. Its posteriors are the targets of a
ridge logistic regression over the voters, which scores whole texts: one pass of a string automaton, whatever the
number of voters.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, rows_where, table, texts
from .language import remainder

#: The training sample: rows per label, and the longest text that is taken into it.
PER_LABEL, SAMPLE_CHARS = {0: 5000, 1: 2500}, 20_000
#: Mined voters, the fewest toxic texts that support one, its least log-odds, the deviations of that one-sided bound, and lengths of word beginnings.
MINED, SUPPORT, LOG_ODDS, BOUND, STEMS = 900, 4, 2.0, 2.2, (4, 5, 6)
#: Texts that are added to each count of a voter, those to a count beside its parent, and the likelihood ratio beyond which two voters are correlated.
SMOOTH, PRIOR, CHANCE = 0.1, 0.1, 20.0
THRESHOLD = 0.7
LEXICON = ("idiot", "idiots", "stupid", "moron", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "dumb", "ugly", "hate you", "shut up", "kill yourself", "bastard", "freak", "filthy", "garbage", "vermin", "jerk", "imbecile", "coward", "despicable")
PATTERNS = (("shouting", "!!"), ("address", " you are "), ("address_short", " you're "), ("questions", "??"))
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """weights by voter: words end with a mark, word beginnings don't."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    patterns: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    @functools.cached_property
    def automaton(self) -> ahocorasick.Automaton | None:
        a = ahocorasick.Automaton()
        for w in {**self.words, **self.stems}:
            a.add_word(w, w)
        if not len(a):
            return None
        a.make_automaton()
        return a

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def score(self, text: str) -> float:
        low, fired = text.lower(), set()
        for end, w in self.automaton.iter(low) if self.automaton else ():
            if (w, 0) in fired and (w, 1) in fired:
                continue
            at = end - len(w)
            if at >= 0 and low[at].isalpha():
                continue
            last = end + 1 == len(low) or not low[end + 1].isalpha()
            fired.add((w, 0) if last else (w, 1))
        z = self.bias + sum(self.words.get(w, 0.0) if whole == 0 else self.stems.get(w, 0.0) for w, whole in fired)
        z += sum(v for p, v in self.patterns.items() if p in low)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def traits(text: str) -> set[tuple[str, bool]]:
    """Words (True) and word beginnings shorter than their word (False) of a text."""
    words = set(WORD.findall(text.lower()))
    return {(w, True) for w in words} | {(w[:n], False) for w in words for n in STEMS if len(w) > n}


def mined(sample: list[str], toxic: np.ndarray) -> list[tuple[str, bool]]:
    """What toxic texts have and others hardly do, strongest first."""
    yes: Counter = Counter()
    for t in (t for t, y in zip(sample, toxic, strict=True) if y):
        yes.update(traits(t))
    yes = Counter({k: n for k, n in yes.items() if n >= SUPPORT})
    no: Counter = Counter()
    for t in (t for t, y in zip(sample, toxic, strict=True) if not y):
        no.update(k for k in traits(t) if k in yes)
    ny, nn = toxic.sum(), (~toxic).sum()
    low = lambda n: max(0.01, n - BOUND * np.sqrt(n))
    odds = {k: np.log(low(n) / (ny + 1)) - np.log((no[k] + BOUND * np.sqrt(no[k]) + 1) / (nn + 1)) for k, n in yes.items()}
    return sorted((k for k, v in odds.items() if v >= LOG_ODDS), key=lambda k: (-odds[k] * np.sqrt(yes[k]), k))[:MINED]


@dataclass
class LabelModel:
    """prior: of the class. parent: of each voter, or -1. chance[voter, class, whether the parent fired]: to fire."""

    prior: float
    parent: np.ndarray
    chance: np.ndarray

    def joint(self, votes: np.ndarray) -> np.ndarray:
        """Log probability of each text's votes with class 0 and with class 1; a voter that doesn't fire counts as such."""
        v = votes.astype(float)
        up = np.where(self.parent >= 0, v[:, self.parent], 0.0)
        out = np.tile(np.log([1 - self.prior, self.prior]), (len(v), 1))
        on, off = np.log(self.chance), np.log1p(-self.chance)
        for y in (0, 1):
            for given, share in ((0, 1 - up), (1, up)):
                out[:, y] += (share * v) @ on[:, y, given] + (share * (1 - v)) @ off[:, y, given]
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = self.joint(votes)
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -500, 500)))

    @classmethod
    def fitted(cls, votes: np.ndarray, q: np.ndarray, parent: np.ndarray | None = None) -> LabelModel:
        """The likeliest model where text i is of class 1 with probability q[i]; parents are found unless given."""
        v = votes.astype(float)
        both = [(v * w[:, None]).T @ v for w in (1 - q, q)]
        n = [float((1 - q).sum()), float(q.sum())]
        if parent is None:
            parent = forest_of(both, n)
        chance, at, has = np.empty((v.shape[1], 2, 2)), np.arange(v.shape[1]), parent >= 0
        for y in (0, 1):
            alone = np.diag(both[y])
            base = (alone + SMOOTH) / (n[y] + 2 * SMOOTH)
            with_, ups = np.where(has, both[y][at, parent], 0.0), np.where(has, alone[parent], 0.0)
            chance[:, y, 1] = np.where(has, (with_ + PRIOR * base) / (ups + PRIOR), base)
            chance[:, y, 0] = np.where(has, (alone - with_ + PRIOR * base) / (n[y] - ups + PRIOR), base)
        return cls(float(np.clip(q.mean(), 1e-3, 1 - 1e-3)), parent, np.clip(chance, 1e-6, 1 - 1e-6))


def forest_of(both: list[np.ndarray], n: list[float]) -> np.ndarray:
    """Each voter's parent (-1: none): the heaviest forest by what two voters tell about each other beyond the class.

    both[class][i, j]: texts of the class in which i and j fire. Pairs whose likelihood ratio is within chance have no edge.
    """
    k = len(both[0])
    told = np.zeros((k, k))
    for c, size in zip(both, n, strict=True):
        if size <= 0:
            continue
        p = np.diag(c) / size
        for i_on in (0, 1):
            for j_on in (0, 1):
                pi, pj = p if i_on else 1 - p, p if j_on else 1 - p
                seen = {(1, 1): c / size, (1, 0): p[:, None] - c / size, (0, 1): p[None, :] - c / size, (0, 0): 1 - p[:, None] - p[None, :] + c / size}[i_on, j_on]
                ratio = np.where(seen > 1e-12, seen, 1.0) / np.maximum(np.where(seen > 1e-12, np.outer(pi, pj), 1.0), 1e-12)
                told += size * np.where(seen > 1e-12, seen, 0.0) * np.log(ratio)
    np.fill_diagonal(told, 0)
    told[2 * told < CHANCE] = 0
    fires = np.diag(both[0]) + np.diag(both[1])
    parent, best = np.full(k, -1), np.zeros(k)
    left = np.ones(k, bool)
    while left.any():  # Prim: the voter with the heaviest edge to the forest, else the most frequent one as a new root
        i = int(np.where(left, best, -1).argmax()) if (left & (best > 0)).any() else int(np.where(left, fires, -1).argmax())
        left[i] = False
        better = left & (told[i] > best)
        best[better], parent[better] = told[i][better], i
    return parent


def label_model(votes: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, LabelModel]:
    """Posterior of each text and the model, from who fires (n, voters) alone.

    Begins with the share of texts in which some voter fires; the forest is found anew in the first rounds. Class 1 is the one
    in which voters fire more.
    """
    q = np.where(votes.any(1), 0.9, 0.05)
    model = LabelModel.fitted(votes, q, np.full(votes.shape[1], -1))
    for k in range(rounds):
        q = model.posterior(votes)
        model = LabelModel.fitted(votes, q, None if k in (1, 3) else model.parent)
    q = model.posterior(votes)
    if (q @ votes.sum(1)) * max(1e-9, (1 - q).sum()) < ((1 - q) @ votes.sum(1)) * q.sum():
        q, model = 1 - q, LabelModel(1 - model.prior, model.parent, model.chance[:, ::-1])
    return q, model


def logistic(x: np.ndarray, target: np.ndarray, l2: float = 0.1, rounds: int = 25, least: float = 0.02) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; weights below `least` become zero."""
    x = np.c_[x.astype(np.float64), np.ones(len(x))]
    w = np.zeros(x.shape[1])
    pull = np.r_[np.full(x.shape[1] - 1, l2), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pull)
        move = np.linalg.solve(h, x.T @ (target - p) - pull * w)
        w += move * min(1.0, 5 / (np.abs(move).max() + 1e-9))
        if np.abs(move).max() < 1e-4:
            break
    return np.where(np.abs(w[:-1]) < least, 0.0, w[:-1]), float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs (doc_id, text) and labels (doc_id, toxic), already without rows that may not be learned from."""
    sizes = dict(labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("toxic").count().collect())
    if len(sizes) < 2:
        return Model(bias=-4.0 if sizes.get(0, 1) else 4.0)
    # per label the rows of the smallest hashes: a bounded sample that is the same however the tables are cut
    share = F.when(F.col("toxic") == 1, min(1.0, 1.2 * PER_LABEL[1] / sizes[1])).otherwise(min(1.0, 1.2 * PER_LABEL[0] / sizes[0]))
    spread = F.xxhash64("doc_id", F.lit(3))
    drawn = labels.where("toxic IN (0, 1)").where(F.pmod(spread, F.lit(1_000_000)) < share * 1_000_000).select("doc_id", "toxic").distinct()
    drawn = reduce(DataFrame.unionByName, (drawn.where(F.col("toxic") == y).orderBy(spread, "doc_id").limit(n) for y, n in PER_LABEL.items()))
    ids = docs.sparkSession.createDataFrame(drawn.toPandas(), "doc_id long, toxic int")  # at most sum(PER_LABEL.values()) rows
    found = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    rows = found.orderBy(spread, "doc_id", "text", "toxic").limit(2 * sum(PER_LABEL.values())).toPandas().sort_values(["doc_id", "text", "toxic"])  # a doc_id may repeat
    if rows.empty or rows["toxic"].nunique() < 2:
        return Model(bias=-4.0)
    sample, toxic = rows["text"].tolist(), rows["toxic"].to_numpy() == 1
    voters = mined(sample, toxic)
    voters += [k for w in LEXICON for k in ((w, True),) if k not in set(voters)]
    at = {k: i for i, k in enumerate(voters)}
    votes = np.zeros((len(sample), len(voters) + len(PATTERNS)), bool)
    for i, t in enumerate(sample):
        low = t.lower()
        votes[i, [at[k] for k in traits(t) if k in at]] = True
        votes[i, [at[w, True] for w in LEXICON if " " in w and w in low]] = True
        votes[i, len(voters) :] = [p in low for _, p in PATTERNS]
    posterior, _ = label_model(votes)
    w, bias = logistic(votes, posterior)
    words = {k[0]: float(v) for k, v in zip(voters, w, strict=False) if k[1] and v}
    stems = {k[0]: float(v) for k, v in zip(voters, w, strict=False) if not k[1] and v}
    return Model(words, stems, {p: float(v) for (_, p), v in zip(PATTERNS, w[len(voters) :], strict=True) if v}, bias)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, score, predicted). Null and empty texts get the score of a text without a vote."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        s = np.array([m.score(t) for t in texts(b.column("text"))], float)
        return pa.record_batch([b.column("doc_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all columns, that score below the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return rows_where(docs, lambda batch: [sent.value.score(t) < THRESHOLD for t in batch])


def learnable(df: DataFrame) -> DataFrame:
    return df.where((remainder(3) != 1) & F.col("doc_id").isNotNull())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(learnable(docs), learnable(table(spark, sf_dir, "labels")))
    return score_documents(docs, model).select("doc_id", (remainder(3) == 1).alias("held_out"), "score", "predicted")
