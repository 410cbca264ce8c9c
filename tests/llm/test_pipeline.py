"""The pipeline, stage by stage, against plain code."""

import re

import pytest
from test_near_dup import classes

import corpus_pipeline as pipeline
from stratalens.llm.common import materialize


@pytest.fixture(scope="module")
def steps(spark, smallest):
    docs = [spark.read.parquet(f"{smallest}/documents.parquet")]
    for name, stage in pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], smallest), f"test-{name.split()[0]}"))
    return docs


def test_columns(steps):
    assert all(d.dtypes == steps[0].dtypes for d in steps[:-1])
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "exact dedup", "near dedup", "mixing", "BPE"]


def test_language_keeps_texts_with_words(steps):
    kept = {r.doc_id for r in steps[1].collect()}
    assert kept >= {r.doc_id for r in steps[0].collect() if len(re.findall(r"[^\W\d_]+", r.text or "")) >= 5}
    assert not [r for r in steps[1].collect() if not re.search(r"[^\W\d_]", r.text or "")]


def test_exact(steps):
    last = {}
    for r in steps[1].collect():
        key = re.sub("[A-Z]", lambda m: m[0].lower(), r.text)
        last[key] = max(last.get(key, -1), r.doc_id)
    assert {r.doc_id for r in steps[2].collect()} == set(last.values())


def test_near(steps):
    rows = sorted(steps[2].collect(), key=lambda r: r.doc_id)
    assert {r.doc_id for r in steps[3].collect()} == {rows[k].doc_id for k in classes([r.text for r in rows])}


def test_mix_and_encode(spark, smallest, steps):
    words = lambda t: len(t.split())
    before, after = sum(words(r.text) for r in steps[3].collect()), sum(words(r.text) for r in steps[4].collect())
    assert abs(after - 1.5 * before) <= 20
    assert steps[5].count() == steps[4].count()
    assert steps[5].where("n_tokens = 0").count() == 0


def test_run(spark, smallest, steps):
    assert pipeline.run(spark, smallest).count() == steps[5].count()


def test_odd_rows_pass_all_stages(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "the and of " * 30_000, "en", "a", 1), (3, "der die das und", "de", None, 5), (3, "der die das und", "de", None, 5), (4, "the of and in", "en", "b", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id for r in got} <= {2, 3, 4} and got
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert pipeline.run(spark, f"file://{tmp_path}/none").count() == 0
