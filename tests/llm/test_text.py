"""Tokens, language, toxicity and personal data against the library, brute force and held-out rows."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lamella.llm import bpe_stream, language, library_bpe, pii, token_files, toxicity
from lamella.llm.bpe_stream import Decoder, Transducer, decode_documents, encode_documents, round_trip, word_bpe

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "B", " ", "  ", "\n", ".", "'s", "1", "é", "_", "<|endoftext|>", "\t", "日", " \n", "\xa0", "\x1c", "²", "ΑΣ", "İ", "word", "é"]
ODD = [None, "", " ", "x" * 30_000, "a  b   c", "\n \n", "don't we'll", "<|endoftext|> a", "日本 語", "<|startoftext|>"]


def mixed(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("kept", [500_000, 20])
def test_word_encoder(monkeypatch, kept):
    monkeypatch.setattr(library_bpe, "WORDS", kept)
    own, library = library_bpe.WordEncoder(BYTE), Tokenizer.from_file(BYTE)
    texts = mixed(3000) + ODD
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        for t, ids in zip(part, own(pa.array(part, pa.string())), strict=True):
            assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_token_files(spark, make, tmp_path):
    texts = [*mixed(60, 1), *ODD]
    docs = make(*((len(texts) - i, t) for i, t in enumerate(texts)), (5, "twice"), extra=True)
    index = token_files.write_tokens(docs, f"file://{tmp_path}/tokens", BYTE)
    got = sorted(token_files.read_tokens(index).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in docs.collect())
    library, by, start = Tokenizer.from_file(BYTE), {}, 0
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        by.setdefault(r.doc_id, set()).add((len(ids), zlib.crc32(ids)))
    for r in got:
        assert (r.start, (r.n_tokens, r.ids_crc32) in by[r.doc_id]) == (start, True)
        start += r.n_tokens


def test_token_file_batches(tmp_path):
    w = token_files.Writer(f"file://{tmp_path}/t.arrows", np.dtype("<u2"), 16, 4)
    ids = np.arange(1000, dtype="<u2")
    for part in np.split(ids, [3, 200, 201, 950]):
        w.add(part)
    w.close()
    r = token_files.Reader(f"file://{tmp_path}/t.arrows")
    for start, n in ((0, 1000), (63, 2), (999, 1), (5, 500), (0, 0)):
        assert np.concatenate([np.empty(0, "<u2"), *r.tokens(start, n)]).tolist() == ids[start : start + n].tolist()
    assert r.masks(0).all() and r.masks(62).sum() == 1000 - 62 * 16
    with pa.memory_map(f"{tmp_path}/t.arrows") as f:  # any Arrow reader can read it
        whole = pa.ipc.open_stream(f).read_all()
    assert np.concatenate([c.values.to_numpy() for c in whole["ids"].chunks])[:1000].tolist() == ids.tolist()


def test_empty_tokens(spark, make, tmp_path):
    none = make((1, "x")).where("false")
    assert token_files.read_tokens(token_files.write_tokens(none, f"file://{tmp_path}/none", BYTE)).count() == 0
    assert round_trip(none, WORD).count() == 0


def test_round_trip(spark, make):
    texts = [*mixed(300, 2), *ODD]
    library = Tokenizer.from_file(WORD)
    for r in round_trip(make(*enumerate(texts), extra=True), WORD).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        out = library.decode(ids, skip_special_tokens=False)
        want = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(out.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want, texts[r.doc_id]


@pytest.mark.parametrize("chars", [7, 60, None])
def test_blocks_of_documents(monkeypatch, chars):
    """Blocks of any size, ids and bytes in portions that cut characters: the same digests; every word is fed."""
    monkeypatch.setattr(bpe_stream, "CHARS", chars or bpe_stream.CHARS)
    monkeypatch.setattr(bpe_stream, "IDS", 3)
    monkeypatch.setattr(bpe_stream, "PORTION", 5)
    own, library = bpe_stream.WordBpe(WORD), Tokenizer.from_file(WORD)
    texts = [*mixed(200, 5), *ODD, "word " * 40, "日本語é" * 40 + " x"]
    for t, (n, ids, out) in zip(texts, own.digests(pa.array(texts, pa.string())), strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert (n, ids, out) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()), t
    if not chars:  # what is kept came from the transducer, word by word
        words = {w for t in texts if t for part, added in own.segments(t) if added is None for c in part.split(" ") if c for w in own.SPLIT.findall(c)}
        assert own.fed >= len(words)
        again = own.fed
        own.digests(pa.array(["word word"], pa.string()))
        assert own.fed == again and own.known["word"][0].decode() == " ".join(map(str, library.encode("word").ids))


def test_a_long_word_takes_constant_memory():
    own = bpe_stream.WordBpe(WORD)
    tracemalloc.start()
    peaks = []
    for n in (30_000, 120_000):
        word = "abcdefgh" * (n // 8)
        data = word.encode()
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        out = bpe_stream.Running(Decoder(own.names, b" "))
        ids = own.transducer.feed(data)
        while some := list(bpe_stream.islice(ids, 1000)):
            out.add(len(some), " ".join(map(str, some)).encode(), b" ".join(own.names[i] for i in some))
        rest = [*own.transducer.close()]
        out.add(len(rest), b"1", b"1")
        peaks.append(tracemalloc.get_traced_memory()[1] - before)
    tracemalloc.stop()
    assert peaks[1] < peaks[0] + 50_000


def test_encode_decode_documents(spark, make):
    coded = encode_documents(make((1, "Hello wörld"), (2, None)), WORD)
    assert {r.doc_id: r.text for r in decode_documents(coded, WORD).collect()} == {1: Tokenizer.from_file(WORD).decode(word_bpe(WORD).encode("Hello wörld")), 2: ""}
    assert word_bpe(WORD).plain_text(word_bpe(WORD).encode("Hello wörld")) == "hello wörld "


@pytest.mark.parametrize("window", [None, 64])
def test_transducer_needs_no_more_than_its_lookahead(window):
    bpe, library, r = word_bpe(WORD), Tokenizer.from_file(WORD), random.Random(3)
    parts = [t.removesuffix("</w>") for t in list(bpe.merges.names.values())[600:49000]]
    parts = [p for p in parts if p.isascii() and p.isalpha()]
    for k in range(40):
        word = "".join(r.choice(parts) if k % 3 else r.choice("aeth") for _ in range(300)).lower()
        t = Transducer(bpe.merges, window)
        got, most = [], 0
        for at in range(0, len(word), 11):
            got += t.feed(word[at : at + 11].encode())
            most = max(most, len(t.held))
        assert got + [*t.close()] == library.encode(word, add_special_tokens=False).ids
        assert most <= t.window + bpe.merges.lookahead + 64


def test_decoder_waits_for_whole_characters():
    d = Decoder({0: b"\xe6", 1: b"\x97\xa5", 2: b"a"})
    assert [d.feed([0]), d.feed([1]), d.feed([2, 0]), d.close()] == ["", "日", "a", "�"]


def brute_spans(text):
    rules = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    count = lambda s: len(re.sub("[^0-9]", "", s))

    def luhn(s):
        d = [int(c) for c in s if c.isdigit()][::-1]
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0

    tests = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 12 <= count(s) <= 19 and luhn(s), lambda s: 9 <= count(s) <= 15]
    return sorted(((m.start(), m.end(), k) for k in range(4) for m in re.finditer(rules[k], text) if tests[k](m[0])), key=lambda x: (x[0], x[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"0123456789.- @+()aB", "255", "4242424242424242", "1.2.3.4", "a@b.c", "+1 (301) 555-2222", "é", "_%"]), max_size=40).map("".join))
def test_rules(text):
    assert pii.base_spans(text) == brute_spans(text)


PEOPLE = [(i, f"{'Lorem ipsum dolor ' * (i % 5)}write to ab{i}.c@mail{i % 9}.example.com or call +1 ({200 + i % 700}) 555-{1000 + i} from 10.{i % 256}.3.{i % 200}, card 4242 4242 4242 4242, version {i}.0 of {i * 37} items.") for i in range(300)]


def test_pii(spark, make):
    docs = make(*PEOPLE, (900, None), (901, ""), (902, "nothing here"), (903, "1" * 50_000), (903, "1" * 50_000), extra=True)
    tagger = pii.train(docs)
    rows = pii.report(docs, tagger).collect()
    by = {r.doc_id: r for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        base = brute_spans(by[r.doc_id].text or "") if r.doc_id != 903 else []
        if r.doc_id != 903:
            assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
            assert set(filter(None, pii.written(base).split(","))) <= set(r.spans.split(","))
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in base) for k in range(4))
    clean = {r.doc_id: r.text for r in pii.masked(docs, tagger).collect()}
    assert "[EMAIL] or call [PHONE] from [IP], card [CARD], version 7.0 of 259 items" in clean[7]
    assert clean[900] is None and clean[902] == "nothing here"
    found = pii.find(docs.where("doc_id = 7"), tagger).first()
    assert {s.kind for s in found.base} == {"email", "ip", "card", "phone"}
    # looser forms that the rules don't know
    loose = "please write to ab7.c(at)mail3.example.com or call (301) 555-7777 from here"
    assert pii.base_spans(loose) == []
    added = tagger.added([loose], [[]])[0]
    assert {loose[s:e] for s, e, _ in added} & {"ab7.c(at)mail3.example.com", "(301) 555-7777"}


def test_recall_of_added_spans(spark, make):
    """Looser forms in texts that weren't trained on: nine of ten are added, and hardly anything else."""
    tagger = pii.train(make(*PEOPLE))
    r = np.random.default_rng(11)
    wanted = found = extra = 0
    for i in range(1000, 1200):
        text = f"please write to ab{i}.c@mail{i % 9}.example.com or call +1 ({200 + i % 700}) 555-{1000 + i} at once, version {i}.0 of {i * 37} items."
        loose, spans = pii.loosened(text, pii.base_spans(text), r)
        base = pii.base_spans(loose)
        need = {(s, e, k) for s, e, k in spans if (s, e, k) not in base}
        got = set(tagger.added([loose], [base])[0])
        wanted, found, extra = wanted + len(need), found + len(need & got), extra + len(got - need)
    assert wanted > 100 and found >= 0.9 * wanted and extra <= 0.02 * wanted, (wanted, found, extra)


def test_pii_sample_does_not_depend_on_partitions(spark, make, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE", 40)
    monkeypatch.setattr(pii, "STEPS", 3)
    docs = make(*PEOPLE, *((2000 + i, PEOPLE[3][1]) for i in range(200)))
    one, many = (pii.train(docs.repartition(n)) for n in (1, 7))
    assert all((one.p[k] == many.p[k]).all() for k in one.p)


def test_pii_without_examples(spark, make):
    docs = make((1, "no digits"), (2, None))
    assert pii.train(docs) is None
    assert {r.spans for r in pii.report(docs, None).collect()} == {""}
    assert pii.report(docs.where("false"), None).count() == 0


def test_loosened_phones(spark, make):
    """Numbers without separators keep their digits; a country code goes only where a number is left."""
    for phone, short in (("+14155550123", "+14155550123"), ("+1 (743) 555-3824", "(743) 555-3824"), ("+44(20)79460958", "(20)79460958"), ("+49 30 123456", "+49 30 123456"), ("+1415-555-0123", "+1415-555-0123")):
        seen = set()
        for seed in range(20):
            text, spans = pii.loosened("call " + phone, [(5, 5 + len(phone), 3)], np.random.default_rng(seed))
            assert [(s, e) for s, e, _ in spans] == [(5, len(text))]
            seen.add(text[5:])
        assert seen == {phone, short}
    assert pii.train(make(*((i, f"please call {i % 7} +1415555{1000 + i}") for i in range(60)))) is not None


LONG = ["christopher.montgomery-whitfield(at)example(dot)com", "name(at)averyverylongdomainnamethatgoeson.com", "name @ averyveryveryverylongdomainname.com", "christopher.montgomery-whitfield (at) example (dot) com", "name @ averyveryveryverylongdomainname . averyveryveryverylonglabel", "4242" + " " * 60 + "4242 4242 4242"]


def test_stretches_hold_whole_runs():
    for v in LONG:
        text = "so " + "write " * 20 + v + " soon" * 20
        at = text.index(v)
        assert any(s <= at and e >= at + len(v) for s, e in pii.stretches(text)), v
    for text in ("1 " * 200_000, "a" * 300_000 + "@" * 300_000, "1 . " * 100_000, "(at) " * 100_000, "x (dot) " * 100_000):
        got = pii.stretches(text)
        assert all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False)) and got[-1][1] <= len(text)


def test_long_addresses_are_masked_whole():
    """A tagger that sees only an address's middle: the span goes to the address's ends, and pieces of numbers go."""

    class Middle(pii.Tagger):
        def added(self, batch, base):
            self.paths = lambda scores: [self.middle(len(x)) for x in scores]
            self.marginals = lambda e: np.ones((len(e), pii.TAGS))
            return super().added(batch, base)

    text = "mail christopher.montgomery-whitfield(at)example(dot)com today"
    tagger = Middle.new()
    at = text.index("whitfield") - pii.stretches(text)[0][0]
    tagger.middle = lambda n: np.array([1 if t == at else 2 if at < t < at + 26 else 0 for t in range(n)])
    assert [text[s:e] for s, e, _ in tagger.added([text], [[]])[0]] == ["christopher.montgomery-whitfield(at)example(dot)com"]
    assert pii.whole("x 301 555 77771", (2, 14, 3)) is None


def test_blocks_are_exact(monkeypatch):
    r = np.random.default_rng(3)
    tagger = pii.Tagger.new()
    for n in (1, 63, 128, 129, 160, 191, 192, 700):
        codes = r.integers(3, 128, n)
        e = tagger.joint([codes])[0]
        monkeypatch.setattr(pii, "BLOCK", 64)
        assert np.allclose(np.concatenate([tagger.block(codes, at) for at in range(0, n, 64)]), e)
        path = tagger.long_path(codes)
        assert (path == tagger.paths([e])[0]).all()
        assert np.allclose(tagger.long_marginals(codes, path), tagger.marginals(e)[np.arange(n), path])


def test_long_stretches_are_bounded():
    """A text of many digits beside short ones takes little memory; two million took 150 s and under 500 MB."""
    tagger = pii.Tagger.new()
    few = [f"call {i} now" for i in range(255)]
    few_e = [np.zeros((40, pii.TAGS)) for _ in range(255)]
    tracemalloc.start()
    tagger.paths([*few_e, np.zeros((50_000, pii.TAGS))])
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.reset_peak()
    text = "7" * 200_000
    assert len(tagger.added([*few, text], [[] for _ in range(256)])) == 256
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_crf_gradients():
    t, r = pii.Tagger.new(3, 4), np.random.default_rng(1)
    ids, tags = r.integers(0, 128, (3, 6)), np.array([[0, 1, 2, 0, 3, 4], [0, 0, 5, 6, 6, 0], [7, 8, 0, 0, 0, 1]])
    _, g = t.step(ids, tags)
    for k in ("E", "Wf", "Wb", "bf", "U", "c", "T"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, h = t.p[k][at], 1e-5
        t.p[k][at] = old + h
        up = t.step(ids, tags)[0]
        t.p[k][at] = old - h
        down = t.step(ids, tags)[0]
        t.p[k][at] = old
        assert abs((up - down) / (2 * h) - g[k][at]) < 1e-4 * max(1, abs(g[k][at]))


WORDS = {"en": ["the", "and", "with", "house", "water", "this", "other"], "de": ["der", "und", "nicht", "häuser", "wasser", "diese", "schön"], "fr": ["le", "et", "avec", "maison", "l'eau", "cette", "été"]}


def corpus(n=360, seed=0):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randint(5, 60))), lang) for i, lang in ((i, ("en", "de", "fr")[i % 3]) for i in range(n))]


def test_language(spark, make):
    docs = make(*corpus(), (1000, None), (1001, "123 !!"), (1002, ""), (None, "the house"), extra=True)
    model = language.train(docs.where((language.remainder(4) != 2) & docs.doc_id.isNotNull()))
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in corpus() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(right) / len(right) >= 0.97
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[1000].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language.identified(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id >= 1000").count() == 0 and kept.count() >= 355
    assert language.train(docs.where("false")).predict("the house") == ("und", 0.0)


def test_every_language_is_learned(spark, make, monkeypatch):
    """Twelve languages one after the other and a sample of less than they have: none is left out."""
    monkeypatch.setattr(language, "SAMPLE", 120)
    monkeypatch.setattr(language, "FLOOR", 20)
    rows = [(i, " ".join(chr(97 + 2 * (i // 60)) * 3 + chr(97 + (i + j) % 24) for j in range(8)), f"l{i // 60:02}") for i in range(720)]
    docs = make(*rows)
    model = language.train(docs)
    assert model.languages == [f"l{k:02}" for k in range(12)]
    none = make((1, "the house", None), (2, "123", None), (3, None, None))
    learned = language.train(none)
    assert learned.languages == [] and [r.doc_id for r in language.identified(none, learned).collect()] == [1]


def test_language_blocks(monkeypatch):
    text = "Größe und schöne Häuser, 12 mal. " * 50
    one = np.sort(np.concatenate([h for h, _ in language.ngrams(text)]))
    for block in (1, 2, 3, 64):
        monkeypatch.setattr(language, "BLOCK", block)
        assert (np.sort(np.concatenate([h for h, _ in language.ngrams(text)])) == one).all()


def test_ftrl_and_temperature():
    """Against the rule by hand: one coordinate a step; the elastic net leaves unused weights at zero; the best temperature."""
    rows = [(np.array([3]), np.array([1.0])), (np.array([5]), np.array([2.0]))] * 30
    y = np.array([0, 1] * 30)
    w, bias = language.ftrl(rows, y, 2)
    assert (np.abs(w[[3, 5]]).min() > 0.1) and not np.delete(w, [3, 5], 0).any()
    assert all((bias + x @ w[at]).argmax() == c for (at, x), c in zip(rows, y, strict=True))
    w1, _ = language.ftrl(rows[:1], y[:1], 2, rounds=1)  # z = g, n = g^2, g = p - 1 = -1/2 for the right class
    g = np.array([-0.5, 0.5])
    assert np.allclose(w1[3], -(g - np.sign(g) * 0.02) / ((1 + np.sqrt(g * g)) / 0.5 + 0.05))
    strong, _ = language.ftrl(rows, y, 2, l1=1e6)
    assert not strong.any()
    scores = np.array([[2.0, 0.0]] * 8 + [[0.0, 2.0]] * 2)
    loss = lambda t: -np.mean([np.log(np.exp(s[0] / t) / np.exp(s / t).sum()) for s in scores])
    t = language.calibrated(scores, np.zeros(10, int))
    assert loss(t) <= min(loss(t * 1.1), loss(t / 1.1))


def test_label_model_is_a_distribution():
    """Against enumeration: the votes of a class sum to one, posteriors are those of the joint, counts give the chances."""
    m = toxicity.LabelModel(0.3, np.array([-1, 0, 1, -1]), np.random.default_rng(0).uniform(0.05, 0.95, (4, 2, 2)))
    votes = np.array([[i >> k & 1 for k in range(4)] for i in range(16)], bool)
    want = np.empty((16, 2))
    for i, v in enumerate(votes.astype(int)):
        for y in (0, 1):
            p = (0.7, 0.3)[y]
            for j, up in enumerate((-1, 0, 1, -1)):
                c = m.chance[j, y, v[up] if up >= 0 else 0]
                p *= c if v[j] else 1 - c
            want[i, y] = p
    assert np.allclose(np.exp(m.joint(votes)), want) and np.isclose(want.sum(), 1)
    assert np.allclose(m.posterior(votes), want[:, 1] / want.sum(1))


def test_label_model_recovers_accuracies_and_correlations():
    """Votes drawn from a known model, no labels given: chances and class come out, and a voter's echo is its child."""
    r = np.random.default_rng(1)
    y = r.random(8000) < 0.3
    yes, no = np.array([0.7, 0.6, 0.5, 0.8, 0.4, 0.6]), np.array([0.05, 0.1, 0.02, 0.1, 0.05, 0.02])
    votes = r.random((8000, 6)) < np.where(y[:, None], yes, no)
    echo = np.where(r.random(8000) < 0.9, votes[:, 0], r.random(8000) < 0.3)
    q, m = toxicity.label_model(np.c_[votes, echo])
    assert ((q > 0.5) == y).mean() > 0.95 and abs(m.prior - 0.3) < 0.03
    assert m.parent[6] == 0 or m.parent[0] == 6
    for j in range(1, 6):
        if m.parent[j] < 0:
            assert abs(m.chance[j, 1, 0] - yes[j]) < 0.06 and abs(m.chance[j, 0, 0] - no[j]) < 0.06


def test_toxicity_sample_does_not_depend_on_partitions(spark, make, monkeypatch):
    monkeypatch.setattr(toxicity, "PER_LABEL", {0: 60, 1: 40})
    rows = [(i, f"{'idiot vequa' if i % 3 == 0 else 'house'} water {i % 7}") for i in range(300)]
    docs, marks = make(*rows), spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    models = [toxicity.train(docs.repartition(n), marks.repartition(n)) for n in (1, 7)]
    assert models[0] == models[1] and models[0].words


def test_toxicity(spark, make):
    r = random.Random(0)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [r.choice(WORDS["en"]) for _ in range(40)] + ([r.choice(["vequa", "vequé", "vequon", "idiot"])] * 2 if bad else [])
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = make(*rows, (900, None), (901, ""), (902, "Idiot!! " * 3000), extra=True)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(toxicity.learnable(docs), toxicity.learnable(marks))
    got = {x.doc_id: x for x in toxicity.score_documents(docs, model).collect()}
    held = [(got[i].predicted, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == y for p, y in held) / len(held) >= 0.97
    assert got[900].predicted == got[901].predicted == 0 and got[902].predicted == 1
    assert toxicity.clean(docs, model).columns == docs.columns
    assert toxicity.train(docs, marks.where("false")).score("x") < 0.5
