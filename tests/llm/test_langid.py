"""Language ID: exact inference on small chains, held-out accuracy."""

import itertools

import numpy as np
import pytest

from stratalens.llm import langid, queries


def test_marginals_by_enumeration():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 4])
    scores, trans, start = rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = langid.marginals(scores.copy(), lengths, trans, start)
    pairs = langid._pairs(scores, lengths, trans, start)
    at, want, want_pairs = 0, [], np.zeros((3, 3))
    for n in lengths:
        weight, p2 = np.zeros((n, 3)), np.zeros((3, 3))
        total = 0.0
        for y in itertools.product(range(3), repeat=int(n)):
            w = np.exp(start[y[0]] + sum(scores[at + t, y[t]] for t in range(n)) + sum(trans[y[t - 1], y[t]] for t in range(1, n)))
            total += w
            for t in range(n):
                weight[t, y[t]] += w
                if t:
                    p2[y[t - 1], y[t]] += w
        want.append(weight / total)
        want_pairs += p2 / total
        at += n
    assert np.allclose(got, np.concatenate(want)) and np.allclose(pairs, want_pairs)


def test_features_depend_on_the_word_alone():
    a, b = langid.emissions(["straße", "a"], np.eye(2, langid.BUCKETS) + 1), langid.emissions(["x", "straße"], np.eye(2, langid.BUCKETS) + 1)
    assert np.allclose(a[0], b[1])


@pytest.fixture(scope="module")
def model(spark, smallest):
    return langid.train(spark.read.parquet(f"{smallest}/documents.parquet"))


def test_held_out_accuracy(spark, smallest):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{smallest}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op3_language_id(spark, smallest).collect()]
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_cases(spark, model):
    rows = [(1, None), (2, ""), (3, "12 34 !²"), (4, "der und die nicht lich keit ung"), (4, "der und die nicht lich keit ung"), (5, "the and of " * 30_000)]
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "en")} == got
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_code_switching(model):
    text = "the and that with from which ation tion ering " * 3 + "der und nicht einer lich keit schung heiten verach " * 3
    runs = model.decide([text])[2][0]
    assert [r["lang"] for r in runs if r["words"] >= 10] == ["en", "de"]


def test_without_labels(spark):
    m = langid.train(spark.createDataFrame([(1, "abc", None), (2, None, "x")], "doc_id long, text string, lang string"))
    assert m.labels == [] and m.decide(["abc"])[0] == ["und"]
    one = langid.train(spark.createDataFrame([(i, "abc def", "x") for i in range(20)], "doc_id long, text string, lang string"))
    assert one.decide(["anything"])[:2] == (["x"], [1.0])


def test_filter_keeps_columns(spark, model):
    df = spark.createDataFrame([(1, "the and of that", 1.5), (2, "", 2.5)], "doc_id long, text string, score double")
    assert [tuple(r) for r in langid.keep_identified(df, model).collect()] == [(1, "the and of that", 1.5)]
