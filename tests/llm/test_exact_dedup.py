"""Exact dedup on small cases, and with a hash that collides."""

import hashlib

from pyspark.sql import functions as F

from stratalens.llm import exact_dedup as op

SCHEMA = "doc_id long, text string, kept string, keep_id int"
ROWS = [(1, "Ab"), (2, "aB"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "ab"), (7, "ab"), (None, "ab"), (8, "zz")]


def run(spark, rows=ROWS, **options):
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA)
    return sorted(((r.doc_id if r.doc_id is not None else -1, r.keep_id, r.group_size, r.kept) for r in op.exact_dedup(df, **options).collect()), key=str)


def test_largest_stays(spark):
    got = run(spark, keep="max")
    assert sorted(x for x in got if x[1] == 7) == [(-1, 7, 5, False), (1, 7, 5, False), (2, 7, 5, False), (7, 7, 5, False), (7, 7, 5, True)]
    assert (3, 3, 1, True) in got and (4, 4, 1, True) in got  # only A-Z are lower-cased
    assert (5, 6, 2, False) in got and (6, 6, 2, True) in got


def test_smallest_stays_and_null_ids_lose(spark):
    got = run(spark, keep="min")
    assert (1, 1, 5, True) in got and (-1, 1, 5, False) in got
    assert run(spark, [(None, "a"), (None, "a")], keep="min").count((-1, None, 2, True)) == 1


def test_collisions_are_told_apart(spark):
    def weak(norm):
        return F.unhex(F.substring(F.md5(F.length(norm).cast("string")), 1, 8))

    assert run(spark, keep="max", key=weak) == run(spark, keep="max")


def test_empty_table_and_filter(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(*r, "x", 0) for r in ROWS], SCHEMA)
    left = op.keep_one(df, keep="max")
    assert left.columns == df.columns
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 6, 7, 8]


def test_hashes_on_a_table(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    texts = {r.doc_id: (r.text or "") for r in docs.collect()}
    lower = str.maketrans(op.UPPER, op.LOWER)
    want = {}
    for i, t in texts.items():
        want.setdefault(t.translate(lower), []).append(i)
    for r in op.exact_dedup(docs, keep="max").collect():
        norm = texts[r.doc_id].translate(lower)
        assert (r.keep_id, r.group_size, r.kept) == (max(want[norm]), len(want[norm]), r.doc_id == max(want[norm]))
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
