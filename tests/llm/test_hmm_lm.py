"""The language model: likelihood by enumeration, counts by hand, gain on held-out texts."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratalens.llm import hmm_lm, queries


def small(k=2, c=3, seed=0):
    rng = np.random.default_rng(seed)
    d = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s) + 0.1)
    return hmm_lm.Hmm(d(k), d(k, k), d(k, c))


def paths(h, x):
    for z in itertools.product(range(len(h.start)), repeat=len(x)):
        p = h.start[z[0]] * h.emit[z[0], x[0]]
        for t in range(1, len(x)):
            p *= h.move[z[t - 1], z[t]] * h.emit[z[t], x[t]]
        yield z, p


def test_likelihood_sums_over_all_paths():
    h, seqs = small(), [[0, 1, 2, 1], [2], [1, 1, 0]]
    got = hmm_lm.log10_likelihood(h, [np.array(s, "<u2").tobytes() for s in seqs])
    assert np.allclose(got, [math.log10(sum(p for _, p in paths(h, s))) for s in seqs])
    long = np.array([0, 1, 2] * 7000, "<u2").tobytes()
    assert np.isfinite(hmm_lm.log10_likelihood(h, [long])).all()


def test_expected_counts():
    h, seqs = small(), [[0, 1, 2, 1], [2], [1, 1, 0]]
    starts, pairs, emits = hmm_lm.expected(h, *hmm_lm.stretches([np.array(s, "<u2").tobytes() for s in seqs]))
    s2, p2, e2 = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    for x in seqs:
        total = sum(p for _, p in paths(h, x))
        for z, p in paths(h, x):
            s2[z[0]] += p / total
            for t, k in enumerate(z):
                e2[k, x[t]] += p / total
                if t:
                    p2[z[t - 1], k] += p / total
    assert np.allclose(starts, s2, atol=1e-5) and np.allclose(pairs, p2, atol=1e-5) and np.allclose(emits, e2, atol=1e-5)


def base(texts):
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in (t or "").encode().lower().split())
    c[None] = len(train)
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in texts.items():
        words = [*(t or "").encode().lower().split(), None]
        out[i] = (len(words), sum(c.get(w, 0) > 0 for w in words), n, sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in words))
    return out


@pytest.mark.parametrize("known", [100_000, 50])
def test_base_by_hand_and_gain(spark, smallest, known):
    """Also with so few known words that most counts are joined."""
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    want = base({r.doc_id: r.text for r in docs.collect()})
    got = hmm_lm.score(docs, known=known, own=40, rest=64, states=4, first_rounds=10).collect()
    assert len(got) == len(want)
    for r in got:
        n, known_n, total, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known_n, total) and abs(r.base_score - score) < 1e-6 * abs(score)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_query_gains_on_held_out(spark, smallest):
    held = [r for r in queries.op7_lm_score(spark, smallest).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_is_a_distribution():
    """All words of a corpus and one unseen one in each shared class have probabilities that sum to one."""
    h = small(2, 4)
    mass = np.array([5.1, 3.1, 6.3, 2.2])
    classes = hmm_lm.Classes({b"own": 0}, np.array([3.0]), 1, 2, 5, mass)
    in_rest = {2: [4.1, 2.1, 0.1], 3: [2.1, 0.1]}
    p = (h.start @ h.emit)[:2].sum() + sum((h.start @ h.emit)[k] * sum(v) / mass[k] for k, v in in_rest.items())
    assert abs(p - 1) < 1e-9 and classes.number() == 4


def test_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0), (None, "a", 0), (4, "c " * 30_000, 0)]
    got = hmm_lm.score(spark.createDataFrame(rows, "doc_id long, text string, score int"), states=2, first_rounds=3).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 1), (2, 1), (3, 3), (3, 3), (4, 30_001)]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert hmm_lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = hmm_lm.score(spark.createDataFrame([(alone, "x y")], "doc_id long, text string")).first()
    assert (r.held_out, r.train_tokens, r.n_known, r.base_score) == (True, 0, 0, 0.0)


def test_every_round_sees_all_texts(spark, monkeypatch):
    """Texts of 32 stretches whose words change from stretch to stretch, against rounds over all of them in one piece."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(f"w{20 * (t // 64) + w}" for t, w in enumerate(rng.integers(0, 20, 2047).tolist()))) for i in range(30)]
    held, real = [], hmm_lm.train

    def kept(coded, classes, *rest):
        held.append((coded, classes, real(coded, classes, *rest)))
        return held[-1][2]

    monkeypatch.setattr(hmm_lm, "train", kept)
    hmm_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), states=3, rounds=0, first_rounds=4)
    [(coded, classes, got)] = held
    unigram = classes.mass / classes.mass.sum()
    emit = unigram * np.random.default_rng(5).gamma(2.0, 0.5, size=(3, classes.number()))
    want = hmm_lm.Hmm(np.full(3, 1 / 3), np.full((3, 3), 0.1 / 3) + 0.9 * np.eye(3), emit / emit.sum(axis=1, keepdims=True))
    cut = hmm_lm.stretches([bytes(r.codes) for r in coded.collect()])
    for _ in range(4):
        want = hmm_lm.maximise(*hmm_lm.expected(want, *cut), unigram, 20.0)
    assert np.allclose(got.emit, want.emit, rtol=1e-2, atol=1e-6) and np.allclose(got.move, want.move, rtol=1e-2, atol=1e-6)


def test_long_texts_count_as_if_whole(monkeypatch):
    """Counts over stretches against those over whole texts: starts exactly, the rest to what LEAD tokens leave."""
    rng = np.random.default_rng(3)
    h = hmm_lm.Hmm(np.array([0.9, 0.1, 0.0]), np.array([[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6]]), rng.dirichlet(np.ones(12), 3))
    codes = [rng.integers(0, 12, n).astype("<u2").tobytes() for n in (1, 255, 256, 257, 700, 1500)]
    cut = hmm_lm.expected(h, *hmm_lm.stretches(codes))
    monkeypatch.setattr(hmm_lm, "STRETCH", 10_000)
    whole = hmm_lm.expected(h, *hmm_lm.stretches(codes))
    for a, b in zip(cut, whole, strict=True):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-3)
    assert np.isclose(cut[0].sum(), 6) and np.isclose(cut[1].sum(), 2969 - 6, rtol=1e-4) and np.isclose(cut[2].sum(), 2969, rtol=1e-4)


def test_score_of_the_table_by_brute_force(spark, smallest, monkeypatch):
    """score: the forward recursion, written out in log space, times each word's share of its class."""
    docs, kept, real = spark.read.parquet(f"{smallest}/documents.parquet"), [], hmm_lm.train

    def train(coded, classes, *rest):
        kept.append((classes, real(coded, classes, *rest)))
        return kept[-1][1]

    monkeypatch.setattr(hmm_lm, "train", train)
    got = {r.doc_id: r.score for r in hmm_lm.score(docs, known=30, own=20, rest=16, states=3, first_rounds=3, rounds=0).collect()}
    [(cl, h)] = kept
    texts = {r.doc_id: hmm_lm.tokens(r.text) for r in docs.collect()}
    counts = {}
    for i, ws in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            for w in ws:
                counts[w] = counts.get(w, 0) + 1
    names = list(cl.known)[: cl.own]
    mass = np.zeros(cl.number())  # of the shared classes: counts of their words, each and one unseen word with 0.1 more
    for w, n in counts.items():
        if w not in names:
            mass[cl.rest_class(w)] += n + 0.1
    mass += 0.1
    for i, ws in texts.items():
        if len(ws) > 3000:
            continue
        x = [names.index(w) + 1 if w in names else cl.rest_class(w) for w in ws] + [0]
        with np.errstate(divide="ignore"):
            a = np.log(h.start) + np.log(h.emit[:, x[0]])
            for c in x[1:]:
                a = np.logaddexp.reduce(a[:, None] + np.log(h.move), axis=0) + np.log(h.emit[:, c])
        want = np.logaddexp.reduce(a) / np.log(10) + sum(math.log10((counts.get(w, 0) + 0.1) / mass[c]) for w, c in zip(ws, x) if w not in names)
        assert abs(got[i] - want) < 1e-7 * max(1, abs(want)), i


def test_classes_of_endings_are_worked_out_once(monkeypatch):
    """As rest_class has them, whatever the words and however few endings are held."""
    classes = hmm_lm.Classes({}, np.zeros(0), 5, 7, 1, np.ones(13))
    words = [f"{i}-{i % 30:03d}".encode() for i in range(3000)] + [b"a", b"ab", "\u00e9".encode()]
    want, calls = [classes.rest_class(w) for w in words], []
    real = hmm_lm.Classes.rest_class
    monkeypatch.setattr(hmm_lm.Classes, "rest_class", lambda self, w: (calls.append(w), real(self, w))[1])
    endings, few = hmm_lm.Endings(classes), hmm_lm.Endings(classes, 4)
    assert [endings[w[-3:]] for w in words] == want and len(calls) == 33
    assert [few[w[-3:]] for w in words] == want and len(few) <= 4


def test_scores_of_texts_of_uneven_lengths_do_not_depend_on_each_other():
    rng = np.random.default_rng(1)
    h = hmm_lm.Hmm(np.array([0.7, 0.3]), np.array([[0.9, 0.1], [0.4, 0.6]]), np.array([[0.2, 0.5, 0.3], [0.6, 0.1, 0.3]]))
    codes = [rng.integers(0, 3, n).astype("<u2").tobytes() for n in (1, 40, 3, 16, 17, 1, 200)]
    alone = [hmm_lm.log10_likelihood(h, [c])[0] for c in codes]
    assert np.allclose(hmm_lm.log10_likelihood(h, codes), alone, rtol=1e-12)


def test_words_of_many_texts_at_once():
    """As tokens has them: white space and capitals of ASCII alone, empty and null texts, blanks at the ends."""
    texts = ["", None, "  ", " A b\x0bc\x0cd\te\nf\rg ", "x\x1cy\x1fz \x85q\xa0R s t　u", "ÉA İ", "a\x00b  c", "\n", "END"]
    for kind in (pa.string(), pa.large_string()):
        for some in (texts, texts[:3], ["a b"], []):
            words, sizes = hmm_lm.split_words(pa.array(some, kind))
            want = [hmm_lm.tokens(t) for t in some]
            assert words.to_pylist() == [w for ws in want for w in ws] and sizes.tolist() == [len(ws) for ws in want]


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_counts_sent_on_in_parts_add_up(spark, held):
    rows = [(" ".join(f"w{i % n}" for n in (2, 7, 50)),) for i in range(200)] + [(None,), ("",), (" ",)]
    got = {bytes(r.word): r.c for r in hmm_lm.word_counts(spark.createDataFrame(rows, "text string"), held).collect()}
    assert got == Counter(w for (t,) in rows for w in hmm_lm.tokens(t))


def test_copies_count_as_often_as_they_occur():
    """Expected counts of sequences with numbers against those of the copies written out."""
    rng = np.random.default_rng(4)
    h, times = small(3, 12), [1, 40, 3, 7, 2]
    codes = [rng.integers(0, 12, n).astype("<u2").tobytes() for n in (1, 2, 255, 700, 5)]
    got = hmm_lm.expected(h, *hmm_lm.stretches(codes, times))
    want = hmm_lm.expected(h, *hmm_lm.stretches([c for c, n in zip(codes, times, strict=True) for _ in range(n)]))
    for a, b in zip(got, want, strict=True):
        assert np.allclose(a, b, rtol=1e-5, atol=1e-4)
    assert np.isclose(got[0].sum(), 53)


def test_posteriors_counted_in_parts(monkeypatch):
    """However many are counted at a time, and in arrays that earlier slices used."""
    rng = np.random.default_rng(5)
    h, room = small(3, 12), hmm_lm.Room()
    codes = [rng.integers(0, 12, n).astype("<u2").tobytes() for n in (400, 3, 60, 1, 60)]
    hmm_lm.expected(h, *hmm_lm.stretches(codes * 3), room)
    want = hmm_lm.expected(h, *hmm_lm.stretches(codes))
    monkeypatch.setattr(hmm_lm, "COUNTED", 1)
    for a, b in zip(hmm_lm.expected(h, *hmm_lm.stretches(codes), room), want, strict=True):
        assert np.allclose(a, b, rtol=1e-9)


def test_training_works_on_copies_once(spark, monkeypatch):
    """The model of a corpus with copies is that of all its texts in one piece, from a table of the different ones."""
    rows = [(i, ("a b c " * 5, "b d", "", f"c a {i % 3}")[i % 4]) for i in range(120)]
    held, tables, real, written = [], {}, hmm_lm.train, hmm_lm.materialize

    def kept(coded, classes, *rest):
        held.append((coded, classes, real(coded, classes, *rest)))
        return held[-1][2]

    monkeypatch.setattr(hmm_lm, "train", kept)
    monkeypatch.setattr(hmm_lm, "materialize", lambda df, tag, **how: tables.setdefault(tag, written(df, tag, **how)))
    hmm_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), states=3, rounds=0, first_rounds=3)
    [(coded, classes, got)] = held
    codes = [bytes(r.codes) for r in coded.collect()]
    assert tables["lm-texts"].count() == len(set(codes)) < len(codes) == tables["lm-texts"].groupBy().sum("times").first()[0]
    unigram = classes.mass / classes.mass.sum()
    emit = unigram * np.random.default_rng(5).gamma(2.0, 0.5, size=(3, classes.number()))
    want = hmm_lm.Hmm(np.full(3, 1 / 3), np.full((3, 3), 0.1 / 3) + 0.9 * np.eye(3), emit / emit.sum(axis=1, keepdims=True))
    for _ in range(3):
        want = hmm_lm.maximise(*hmm_lm.expected(want, *hmm_lm.stretches(codes)), unigram, 20.0)
    assert np.allclose(got.emit, want.emit, rtol=1e-3, atol=1e-7) and np.allclose(got.move, want.move, rtol=1e-3, atol=1e-7)


def test_even_slices_go_on_across_batches():
    """All rows in order, in slices that are about full, whatever the batches; a row is never cut."""
    sizes = [3, 0, 40, 100, 7, 5_000, 1, *[50] * 300]
    rows = [bytes([i % 250]) * n for i, n in enumerate(sizes)]
    for step in (1, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + step], pa.binary())], names=["codes"]) for i in range(0, len(rows), step)]
        got = [x.column("codes").to_pylist() for x in hmm_lm.even_slices(batches, "codes", 1600)]
        assert [r for x in got for r in x] == rows
        full = [sum(map(len, x)) for x in got]
        assert all(n <= 1600 or len(x) == 1 for n, x in zip(full, got, strict=True)) and min(full[3:-1]) >= 1450
    assert list(hmm_lm.even_slices([], "codes", 10)) == []


def test_scores_of_rare_classes_stay_in_range():
    """Texts of classes as improbable as a prior count in a billion tokens, scaled at every APART-th step."""
    emit = np.array([[1 - 2e-18, 2e-18], [1 - 1e-18, 1e-18]])
    h = hmm_lm.Hmm(np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), emit)
    codes = [np.ones(n, "<u2").tobytes() for n in (1, 7, 8, 9, 500)]
    got = hmm_lm.log10_likelihood(h, codes)
    for x, y in zip(got, codes, strict=True):
        a = np.log(h.start) + np.log(emit[:, 1])
        for _ in range(len(y) // 2 - 1):
            a = np.logaddexp.reduce(a[:, None] + np.log(h.move), axis=0) + np.log(emit[:, 1])
        assert np.isclose(x, np.logaddexp.reduce(a) / np.log(10), rtol=1e-12)


def test_stretches_among_texts_of_all_lengths(monkeypatch):
    """What is read before and after a stretch reaches it as if the text were whole, for ends of all lengths and with copies."""
    rng = np.random.default_rng(8)
    h = hmm_lm.Hmm(np.array([0.9, 0.1, 0.0]), np.array([[0.7, 0.2, 0.1], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6]]), rng.dirichlet(np.ones(12), 3))
    sizes = [1, 24, 255, 256, *range(257, 300, 3), 511, 512, 513, 530, 540, 768, 769, 2000]
    codes, times = [rng.integers(0, 12, n).astype("<u2").tobytes() for n in sizes], [1 + i % 5 for i in range(len(sizes))]
    flat, *cut = hmm_lm.stretches(codes, times)
    total = int(np.dot(sizes, times))
    assert int((cut[1] * cut[4]).sum()) == total and (cut[2] <= hmm_lm.LEAD).all() and ((cut[2] == 0) | (cut[1] == hmm_lm.STRETCH)).all()
    got = hmm_lm.expected(h, flat, *cut)
    monkeypatch.setattr(hmm_lm, "STRETCH", 10_000)
    for a, b in zip(got, hmm_lm.expected(h, *hmm_lm.stretches(codes, times)), strict=True):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-3)
    assert np.isclose(got[2].sum(), total, rtol=1e-5) and np.isclose(got[1].sum(), total - sum(times), rtol=1e-5)
