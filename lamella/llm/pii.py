"""Personal data: exact rules for plain forms, and a character BiLSTM-CRF for forms that the rules miss.

The rules find e-mail addresses, IPv4 addresses, payment cards and phone numbers. The tagger is a bidirectional LSTM
over characters with a CRF on top, trained in numpy on the driver from labelled spans: those of the rules in a bounded
sample, a part of them rewritten into looser forms (an address spelled with (at) and (dot), a number without its plus).
A span of any kind holds a digit or an at sign, so only stretches around those are tagged: the whole run of address or
number characters that they are in, and a margin. That is a constraint of the decoding and loses no span. A stretch is read in overlapping windows, each position takes the scores of the
windows it is in, weighted towards their middles, and one Viterbi path is found for the whole stretch. What the tagger
adds must pass a plain check of its kind and never touches a rule's span.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, texts

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
WINDOW, STRIDE, MARGIN = 64, 32, 24
#: Positions, padding included, that are decoded at once; from so many on a stretch is decoded by itself, in blocks of so many.
CELLS, BLOCK = 1 << 18, 1 << 14
#: The training sample: documents, the longest that is taken, windows, steps, and the seed of both.
SAMPLE, SAMPLE_CHARS, WINDOWS, STEPS, SEED = 1500, 20_000, 4000, 260, 5
#: The least mean probability of a span's tags under the CRF.
SURE = 0.8

DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
COUNTRY = re.compile(r"^\+[0-9]{1,3}(?:[ .-]+|(?=\())")
TRIGGER = re.compile(r"[0-9@]|\((?:at|dot)\)")
#: From a trigger to the end of its address or number, with the words or labels that one space sets apart.
RUN = re.compile(r"(?:[A-Za-z0-9._%+@()/-]++|(?<=[0-9._()/-]) ++(?=[0-9.()]))++(?: [A-Za-z0-9-]++)?+(?: ?(?:\.|\(dot\)) ?[A-Za-z0-9-]++)*+")
BEFORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@()/-")
LOCAL = BEFORE - frozenset("@()/")
LABELS = re.compile(r"(?:[A-Za-z0-9-]|\.(?=[A-Za-z0-9-]))*+")
Span = tuple[int, int, int]  # start, end, kind


def digits(s: str) -> list[int]:
    return [ord(c) - 48 for c in s if "0" <= c <= "9"]


def luhn(d: list[int]) -> bool:
    odd = d[-1::-2]
    even = d[-2::-2]
    return (sum(odd) + sum(x * 2 - 9 * (x > 4) for x in even)) % 10 == 0


def valid_ip(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in s.split("."))


def valid_card(s: str) -> bool:
    return 12 <= len(d := digits(s)) <= 19 and luhn(d)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain, in one pass: a match has exactly one at sign."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
        end = max(end, 0)
    return out


def base_spans(text: str) -> list[Span]:
    """The rules' spans by start, then kind; leftmost and non-overlapping within a kind."""
    out = [(s, e, 0) for s, e in emails(text)]
    out += [(*m.span(), 1) for m in IP.finditer(text) if valid_ip(m[0])]
    out += [(*m.span(), 2) for m in CARD.finditer(text) if valid_card(m[0])]
    out += [(*m.span(), 3) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def back(text: str, at: int, least: int, among: frozenset[str]) -> int:
    while at > least and text[at - 1] in among:
        at -= 1
    return at


def stretches(text: str) -> list[tuple[int, int]]:
    """The runs of address or number characters that triggers are in, with a margin; stretches that meet are one."""
    out: list[list[int]] = []
    end = 0
    for m in TRIGGER.finditer(text):
        if m.start() < end:
            continue
        s = back(text, m.start(), end, BEFORE)
        if s - 1 > end and text[s - 1] == " ":
            s = back(text, s - 1, end, BEFORE)
        end = RUN.match(text, m.start()).end()
        s, e = max(0, s - MARGIN), min(len(text), end + MARGIN)
        if out and s <= out[-1][1]:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def coded(text: str) -> np.ndarray:
    """Character classes: ASCII as itself, other letters 1, the rest 2; 0 pads."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(c < 128, np.maximum(c, 3), np.where(c < 0x2000, 1, 2)).astype(np.int64)


def soft(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """p: embedding E, for each direction weights W and bias b of the four gates, output U and c, transitions T."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, embed: int = 12, hidden: int = 16, seed: int = SEED) -> Tagger:
        r = np.random.default_rng(seed)
        p = {"E": r.normal(0, 0.3, (128, embed)), "U": r.normal(0, 0.2, (2 * hidden, TAGS)), "c": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS))}
        for d in "fb":
            p["W" + d] = r.normal(0, 0.25, (embed + hidden, 4 * hidden))
            p["b" + d] = np.r_[np.ones(hidden), np.zeros(3 * hidden)]
        return cls(p)

    @property
    def barred(self) -> np.ndarray:
        """Transitions that can't be: into the inside of a kind from anything but that kind."""
        bar = np.zeros((TAGS, TAGS))
        for k in range(len(KINDS)):
            bar[:, 2 * k + 2] = -1e4
            bar[[2 * k + 1, 2 * k + 2], 2 * k + 2] = 0
        return bar

    def lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        w, b = self.p["W" + d], self.p["b" + d]
        h = np.zeros((x.shape[0], w.shape[1] // 4))
        c, out, kept, n = h, [], [], h.shape[1]
        fixed = x @ w[: x.shape[2]] + b
        for t in range(x.shape[1]) if d == "f" else reversed(range(x.shape[1])):
            z = fixed[:, t] + h @ w[x.shape[2] :]
            gates = 1 / (1 + np.exp(-z[:, : 3 * n]))
            f, i, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(z[:, 3 * n :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            kept.append((t, f, i, o, g, before, tc, h))
            h = o * tc
            out.append(h)
        return np.stack(out if d == "f" else out[::-1], 1), kept

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Emission scores (windows, positions, tags)."""
        x = self.p["E"][ids]
        return np.concatenate([self.lstm(x, "f")[0], self.lstm(x, "b")[0]], 2) @ self.p["U"] + self.p["c"]

    def step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the CRF and its gradients."""
        x, n, steps = self.p["E"][ids], len(ids), ids.shape[1]
        (hf, kf), (hb, kb) = self.lstm(x, "f"), self.lstm(x, "b")
        h = np.concatenate([hf, hb], 2)
        e, trans = h @ self.p["U"] + self.p["c"], self.p["T"] + self.barred
        a, b = [e[:, 0]], [np.zeros((n, TAGS))]
        for t in range(1, steps):
            a.append(e[:, t] + soft(a[-1][:, :, None] + trans, 1))
        for t in range(steps - 1, 0, -1):
            b.append(soft(trans + (e[:, t] + b[-1])[:, None, :], 2))
        a, b = np.stack(a, 1), np.stack(b[::-1], 1)
        z = soft(a[:, -1], 1)
        de = np.exp(a + b - z[:, None, None])
        pair = np.exp(a[:, :-1, :, None] + trans + (e + b)[:, 1:, None, :] - z[:, None, None, None])
        rows = np.arange(n)[:, None]
        np.add.at(de, (rows, np.arange(steps), tags), -1)
        dt = pair.sum((0, 1))
        np.add.at(dt, (tags[:, :-1], tags[:, 1:]), -1)
        loss = (z - np.take_along_axis(e, tags[..., None], 2).sum((1, 2)) - trans[tags[:, :-1], tags[:, 1:]].sum(1)).mean()
        g = {"U": np.einsum("nth,ntk->hk", h, de), "c": de.sum((0, 1)), "T": dt, "E": np.zeros_like(self.p["E"])}
        dh = de @ self.p["U"].T
        m = hf.shape[2]
        dx = np.zeros_like(x)
        for d, kept, part in (("f", kf, dh[:, :, :m]), ("b", kb, dh[:, :, m:])):
            w = self.p["W" + d]
            g["W" + d], g["b" + d] = np.zeros_like(w), np.zeros(w.shape[1])
            dc, back = np.zeros((n, m)), np.zeros((n, m))
            for t, f, i, o, cand, before, tc, hp in reversed(kept):
                dho = part[:, t] + back
                dc = dc + dho * o * (1 - tc**2)
                dz = np.concatenate([dc * before * f * (1 - f), dc * cand * i * (1 - i), dho * tc * o * (1 - o), dc * i * (1 - cand**2)], 1)
                g["W" + d] += np.concatenate([x[:, t], hp], 1).T @ dz
                g["b" + d] += dz.sum(0)
                both = dz @ w.T
                dx[:, t] += both[:, : x.shape[2]]
                back, dc = both[:, x.shape[2] :], dc * f
        np.add.at(g["E"], ids, dx)
        return float(loss), {k: v / n for k, v in g.items()}

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = STEPS, batch: int = 48, rate: float = 0.015) -> Tagger:
        """Adam over random batches."""
        r = np.random.default_rng(SEED)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for s in range(1, steps + 1):
            at = r.integers(0, len(ids), batch)
            _, g = self.step(ids[at], tags[at])
            norm = np.sqrt(sum((x**2).sum() for x in g.values()))
            for k, x in g.items():
                x = x * min(1.0, 5 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x**2
                self.p[k] = self.p[k] - rate * (1 - s / (steps + 1)) * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)
        return self

    def joint(self, pieces: list[np.ndarray]) -> list[np.ndarray]:
        """Emission scores of whole stretches, from overlapping windows."""
        starts = [[*range(0, max(1, len(p) - WINDOW + STRIDE), STRIDE)] for p in pieces]
        ids = np.zeros((sum(map(len, starts)), WINDOW), np.int64)
        k = 0
        for p, at in zip(pieces, starts, strict=True):
            for s in at:
                w = p[s : s + WINDOW]
                ids[k, : len(w)] = w
                k += 1
        e = np.concatenate([self.scores(ids[k : k + 2048]) for k in range(0, len(ids), 2048)]) if len(ids) else np.empty((0, WINDOW, TAGS))
        weight = 1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
        out, k = [], 0
        for p, at in zip(pieces, starts, strict=True):
            total, parts = np.zeros((len(p), TAGS)), np.zeros(len(p))
            for s in at:
                n = min(WINDOW, len(p) - s)
                total[s : s + n] += e[k, :n] * weight[:n, None]
                parts[s : s + n] += weight[:n]
                k += 1
            out.append(total / parts[:, None])
        return out

    def paths(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each stretch, those of like length together."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(scores)
        trans = self.p["T"] + self.barred
        order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
        groups: list[list[int]] = []
        for i in order:
            if not groups or len(groups[-1]) == 256 or (len(groups[-1]) + 1) * len(scores[i]) > CELLS:
                groups.append([])
            groups[-1].append(i)
        for group in groups:
            long = len(scores[group[-1]])
            e = np.zeros((len(group), long, TAGS))
            for row, i in enumerate(group):
                e[row, : len(scores[i])] = scores[i]
            best, via = e[:, 0] + np.where(np.arange(TAGS) % 2 + (np.arange(TAGS) == 0) > 0, 0, -1e4), np.zeros((len(group), long, TAGS), np.int8)
            last = np.zeros((len(group), TAGS))
            sizes = np.array([len(scores[i]) for i in group])
            last[sizes == 1] = best[sizes == 1]
            for t in range(1, long):
                all_ = best[:, :, None] + trans
                via[:, t] = all_.argmax(1)
                best = e[:, t] + all_.max(1)
                last[sizes == t + 1] = best[sizes == t + 1]
            tag = last.argmax(1)
            for row, i in enumerate(group):
                path, k = np.empty(sizes[row], np.int64), tag[row]
                for t in range(sizes[row] - 1, -1, -1):
                    path[t] = k
                    k = via[row, t, k]
                out[i] = path
        return out

    def block(self, codes: np.ndarray, at: int) -> np.ndarray:
        """Emission scores of a stretch's block that begins at `at`, as joint() has them for the whole stretch."""
        start, end = max(0, at - STRIDE), min(len(codes), at + BLOCK + STRIDE)
        return self.joint([codes[start:end]])[0][at - start : at - start + BLOCK]

    def long_path(self, codes: np.ndarray) -> np.ndarray:
        """The best tags of a stretch of any length, block by block with carried scores: 17 bytes a position."""
        trans, n = self.p["T"] + self.barred, len(codes)
        via, path = np.zeros((n, TAGS), np.int8), np.empty(n, np.int64)
        best = np.where(np.arange(TAGS) % 2 + (np.arange(TAGS) == 0) > 0, 0, -1e4)
        for at in range(0, n, BLOCK):
            for t, e in enumerate(self.block(codes, at), at):
                if not t:
                    best = e + best
                    continue
                every = best[:, None] + trans
                via[t] = every.argmax(0)
                best = e + every.max(0)
        k = int(best.argmax())
        for t in range(n - 1, -1, -1):
            path[t] = k
            k = via[t, k]
        return path

    def long_marginals(self, codes: np.ndarray, path: np.ndarray) -> np.ndarray:
        """The CRF's probability of a stretch's tags at each position, block by block with carried scores."""
        trans, n = self.p["T"] + self.barred, len(codes)

        def forward(at: int, a: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            e = self.block(codes, at)
            out = e.copy()
            for t in range(len(e)):
                if a is not None:
                    out[t] += soft(a[:, None] + trans, 0)
                a = out[t]
            return e, out

        carried: list[np.ndarray | None] = [None]
        for at in range(0, n, BLOCK):
            carried.append(forward(at, carried[-1])[1][-1])
        z, b, out = soft(carried[-1], 0), np.zeros(TAGS), np.empty(n)
        for k in range(len(carried) - 2, -1, -1):
            e, a = forward(k * BLOCK, carried[k])
            for t in range(len(e) - 1, -1, -1):
                tag = path[k * BLOCK + t]
                out[k * BLOCK + t] = np.exp(a[t, tag] + b[tag] - z)
                b = soft(trans + (e[t] + b)[None, :], 1)
        return out

    def marginals(self, e: np.ndarray) -> np.ndarray:
        """The CRF's probability of each tag at each position of one stretch (positions, tags)."""
        trans, a, b = self.p["T"] + self.barred, e.copy(), np.zeros_like(e)
        for t in range(1, len(e)):
            a[t] += soft(a[t - 1][:, None] + trans, 0)
        for t in range(len(e) - 1, 0, -1):
            b[t - 1] = soft(trans + (e[t] + b[t])[None, :], 1)
        return np.exp(a + b - soft(a[-1], 0))

    def added(self, batch: list[str], base: list[list[Span]]) -> list[list[Span]]:
        """For each text the spans that the tagger finds beside the rules' ones."""
        where = [(i, s, e) for i, t in enumerate(batch) for s, e in stretches(t)]
        out: list[list[Span]] = [[] for _ in batch]

        def take(i: int, s: int, path: np.ndarray, likely: Callable[[], np.ndarray]) -> None:
            sure = None
            for a, b, k in runs(path) if path.any() else []:
                first, last = a, b
                while a < b and batch[i][s + a].isspace():
                    a += 1
                while a < b and batch[i][s + b - 1] in " .,;:\n\t":
                    b -= 1
                span = whole(batch[i], (s + a, s + b, k))
                if span and plausible(batch[i][span[0] : span[1]], k) and all(span[1] <= x[0] or span[0] >= x[1] for x in [*base[i], *out[i][-1:]]):
                    sure = likely() if sure is None else sure
                    if sure[first:last].mean() >= SURE:
                        out[i].append(span)

        some: list[tuple[int, int, int]] = []
        held = 0
        for i, s, e in [*where, (-1, 0, 0)]:
            if i < 0 or held + e - s > CELLS:
                joint = self.joint([coded(batch[j][a:b]) for j, a, b in some])
                for (j, a, _), scores, path in zip(some, joint, self.paths(joint), strict=True):
                    take(j, a, path, lambda scores=scores, path=path: self.marginals(scores)[np.arange(len(path)), path])
                some, held = [], 0
            if e - s >= BLOCK:
                codes = coded(batch[i][s:e])
                path = self.long_path(codes)
                take(i, s, path, lambda codes=codes, path=path: self.long_marginals(codes, path))
            elif i >= 0:
                some.append((i, s, e))
                held += e - s
        for x in out:
            x.sort()
        return out


def runs(path: np.ndarray) -> list[Span]:
    out, t = [], 0
    while t < len(path):
        if path[t] == 0:
            t += 1
            continue
        k, s = (int(path[t]) - 1) // 2, t
        t += 1
        while t < len(path) and path[t] == 2 * k + 2:
            t += 1
        out.append((s, t, k))
    return out


def whole(text: str, span: Span) -> Span | None:
    """The span, an address widened to the ends of its local part and domain; None for a piece of a longer number."""
    s, e, k = span
    if k == 0:
        return back(text, s, 0, LOCAL), LABELS.match(text, e).end(), k
    cut = (s and text[s - 1].isalnum() and text[s].isalnum()) or (e < len(text) and text[e].isalnum() and text[e - 1].isalnum())
    return None if cut else span


def plausible(s: str, kind: int) -> bool:
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+(?: ?\(dot\) ?[A-Za-z0-9._%+-]+)* ?(?:@|\(at\)) ?[A-Za-z0-9-]+(?: ?(?:\.|\(dot\)) ?[A-Za-z0-9-]+)+", s))
    if kind == 1:
        return s.count(".") == 3 and bool(re.fullmatch(r"[0-9]+(?: ?\. ?[0-9]+){3}", s)) and valid_ip(s.replace(" ", ""))
    if kind == 2:
        return bool(re.fullmatch(r"[0-9][0-9 ./_-]+[0-9]", s)) and valid_card(s)
    return 9 <= len(digits(s)) <= 15 and bool(re.fullmatch(r"\(?[0-9][0-9 ().-]+[0-9]", s)) and bool(re.search(r"[0-9][ ().-]+[0-9]", s)) and not valid_card(s)


def loosened(text: str, spans: list[Span], r: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with about half its spans in looser forms; spans that overlap others stay as they are."""
    out, at, new = [], 0, []
    size = 0
    for s, e, k in spans:
        if s < at:
            continue
        v = text[s:e]
        if r.random() < 0.5:
            if k == 0:
                v = v.replace("@", " (at) ").replace(".", " (dot) ") if r.random() < 0.5 else v.replace("@", "(at)")
            elif k == 2:
                v = re.sub(r"([0-9]{4})(?=[0-9])", lambda m, by=r.choice([" ", "-", "."]): m[1] + by, v.replace(" ", "").replace("-", ""))
            elif k == 3:
                short = COUNTRY.sub("", v)
                v = short if len(digits(short)) >= 9 else v
        out += [text[at:s], v]
        size += s - at
        new.append((size, size + len(v), k))
        size += len(v)
        at = e
    return "".join([*out, text[at:]]), new


def train(docs: DataFrame) -> Tagger | None:
    """A tagger from a bounded sample of documents that have triggers; None where there are no spans to learn from."""
    hit = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS)).select("text")
    n = hit.count()
    share, spread = min(1.0, 2 * SAMPLE / n) if n else 0.0, F.xxhash64("text")
    # distinct texts of the smallest hashes: the same sample however the table is cut, whatever its copies
    drawn = hit.where(F.pmod(spread, F.lit(1_000_000)) < int(1_000_000 * share)).distinct().orderBy(spread, "text").limit(SAMPLE).toPandas()
    r = np.random.default_rng(SEED)
    ids, tags = [], []
    for text in sorted(drawn["text"]):
        text, spans = loosened(text, base_spans(text), r)
        y = np.zeros(len(text), np.int64)
        for s, e, k in spans:
            if s == e:
                continue
            y[s:e] = 2 * k + 2
            y[s] = 2 * k + 1
        x = coded(text)
        for s, e in stretches(text):
            for a in range(s, max(s + 1, e - WINDOW + STRIDE), STRIDE):
                if len(ids) < WINDOWS:
                    b = min(len(text), a + WINDOW)
                    ids.append(np.r_[x[a:b], np.zeros(WINDOW - (b - a), np.int64)])
                    tags.append(np.r_[y[a:b], np.zeros(WINDOW - (b - a), np.int64)])
    if not ids or not any(t.any() for t in tags):
        return None
    ids, tags = np.stack(ids), np.stack(tags)
    for t in tags:  # a window may begin inside a span
        if t[0] and t[0] % 2 == 0:
            t[0] -= 1
    return Tagger.new().fit(ids, tags)


def find(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """docs (doc_id, text, ...) -> all columns but text, then base and added: arrays of (start, end, kind).

    A null text is empty. Positions are code points, ends exclusive. Columns of these two names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tagger)
    keep = [c for c in docs.columns if c not in ("text", "base", "added")]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = texts(b.column("text"))
        base = [base_spans(t) for t in got]
        more = sent.value.added(got, base) if sent.value else [[] for _ in got]
        as_rows = lambda spans: pa.array([[{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))
        return pa.record_batch([*(b.column(c) for c in keep), as_rows(base), as_rows(more)], names=[*keep, "base", "added"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in keep)
    spans = "array<struct<start: bigint, end: bigint, kind: string>>"
    return map_batches(docs, run, f"{fields}base {spans}, added {spans}", 512)


def report(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """docs (doc_id, text) -> a row for each: counts and digest of the rules' spans, and all spans."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = texts(b.column("text"))
        base = [base_spans(t) for t in got]
        more = sent.value.added(got, base) if sent.value else [[] for _ in got]
        count = [pa.array([sum(s[2] == k for s in x) for x in base], pa.int64()) for k in range(len(KINDS))]
        digest = pa.array([hashlib.sha256(written(x).encode()).hexdigest() for x in base], pa.string())
        every = pa.array([written(sorted(x + y, key=lambda s: (s[0], s[2]))) for x, y in zip(base, more, strict=True)], pa.string())
        added = pa.array([len(x) for x in more], pa.int64())
        return pa.record_batch([b.column("doc_id"), *count, digest, every, added], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long", 512)


def masked(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """docs with every span of a text replaced by [KIND]; null texts stay null. Other columns are as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger)
    at = docs.columns.index("text")

    def clean(text: str, spans: list[Span]) -> str:
        out, end = [], 0
        for s, e, k in spans:
            if s >= end:
                out += [text[end:s], f"[{KINDS[k].upper()}]"]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        got = texts(b.column("text"))
        base = [base_spans(t) for t in got]
        more = sent.value.added(got, base) if sent.value else [[] for _ in got]
        new = [clean(t, sorted(x + y, key=lambda s: (s[0], s[2]))) for t, x, y in zip(got, base, more, strict=True)]
        new = pa.array(new, pa.string(), mask=b.column("text").is_null().to_numpy(zero_copy_only=False))
        return pa.record_batch([new if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return map_batches(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), 512)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return report(docs, train(docs))
