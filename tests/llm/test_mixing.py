"""Mixing: targets by the stated procedure, exact quotas, reruns."""

import re

import pytest
from pyspark.sql import functions as F

from stratalens.llm import mixing, queries


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def targets(rows, weights=(5, 2, 1), share=1.5, cap=2.0):
    size = {}
    for _, s, t in rows:
        size[s] = size.get(s, 0) + words(t)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full = set()
    while True:
        rest, total = share * sum(size.values()) - sum(cap * size[s] for s in full), sum(w[s] for s in size if s not in full)
        goal = {s: cap * size[s] if s in full else rest * w[s] / total for s in size}
        over = {s for s in size if s not in full and goal[s] > cap * size[s] * (1 + 1e-12)}
        if not over:
            return size, goal
        full |= over


@pytest.fixture(scope="module")
def rows(spark, smallest):
    return [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{smallest}/documents.parquet").collect()]


def test_targets_and_quotas(spark, smallest, rows):
    size, goal = targets(rows)
    got = queries.op6_mixing(spark, smallest).collect()
    source, text = {i: s for i, s, _ in rows}, {i: t for i, _, t in rows}
    taken = dict.fromkeys(size, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.size == words(text[r.doc_id]) and r.source_size == size[s] and abs(r.target - goal[s]) < 1e-6 * (1 + goal[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - goal[s]) <= 0.5 + 1e-9 for s in size)
    again = {r.doc_id: r.taken for r in queries.op6_mixing(spark, smallest).collect()}
    assert all(again[r.doc_id] == r.taken for r in got)


def test_pieces_are_disjoint_and_sharded(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    pieces = mixing.mix(docs, shards=4).where("epoch is not null").collect()
    assert {p.shard for p in pieces} == {0, 1, 2, 3}
    by = {}
    for p in pieces:
        assert 0 <= p.words_from < p.words_to <= p.size
        by.setdefault((p.row_id, p.epoch), []).append((p.words_from, p.words_to))
    for spans in by.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_split_is_hypergeometric(spark):
    """Mean and variance over many nodes of quotas (30, 10), halved."""
    nodes = spark.range(4000).select(F.col("id").alias("node"), F.expr("array(named_struct('sid', 1, 'quota', 30L), named_struct('sid', 2, 'quota', 10L))").alias("blocks"))
    halves = mixing.split(nodes, 3).select("node", F.col("blocks")[0]["quota"].alias("a"), F.col("blocks")[1]["quota"].alias("b"))
    assert halves.where("a + b <> 20").count() == 0
    r = halves.where("node % 2 = 0").agg(F.avg("a"), F.var_samp("a")).first()
    assert abs(r[0] - 15) < 0.15 and abs(r[1] - 20 * 0.75 * 0.25 * 20 / 39) < 0.25


def test_cases(spark):
    df = spark.createDataFrame([(1, "a b c", None, 3), (1, "a b c", None, 3), (None, None, "x", 0), (4, "", "y", 0), (5, "w " * 50_000, "z", 0)], "doc_id long, text string, source string, size int")
    got = mixing.taken(mixing.mix(df)).collect()
    assert len(got) == 5 and sum(r.taken for r in got if r.doc_id == 1) == 12
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mixing.taken(mixing.mix(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, shards=3)


def test_mixed_documents_keep_their_columns(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    out = mixing.apply_mix(docs)
    assert out.dtypes == docs.dtypes
    got = out.collect()
    _, goal = targets([(r.doc_id, r.source, r.text) for r in docs.collect()])
    held = {}
    for r in got:
        assert r.n_chars == len(r.text)
        held[r.source] = held.get(r.source, 0) + words(r.text)
    assert all(abs(held[s] - goal[s]) <= 1 for s in goal)


def test_leaf_quotas_bind(spark):
    """Each shard draws as many blocks of each source as the tree's leaf says, from disjoint blocks; all shards are of one size."""
    sources = spark.createDataFrame([("a", 1, 100_000, 150_000.0), ("b", 2, 3_000, 6_000.0), ("c", 3, 50, 7.0)], "source string, sid int, source_size long, target double")
    found = {}
    for seed in (1, 2):
        blocks = mixing.plan_blocks(sources, 8, 64, seed).collect()
        assert len({(b.sid, b.epoch, b.block) for b in blocks}) == len(blocks)
        each = {}
        for b in blocks:
            each[b.shard, b.sid] = each.get((b.shard, b.sid), 0) + 1
        quotas = {}
        for b in blocks:
            quotas[b.sid] = quotas.get(b.sid, 0) + 1
        nodes = spark.createDataFrame([(1, sorted(quotas.items()))], "node long, blocks array<struct<sid:int,quota:long>>")
        for _ in range(3):
            nodes = mixing.split(nodes, seed)
        assert {(r.shard, r.sid): r.quota for r in mixing.leaf_quotas(nodes, 8).collect() if r.quota} == each
        sizes = [sum(n for (s, _), n in each.items() if s == k) for k in range(8)]
        assert max(sizes) - min(sizes) <= 1
        found[seed] = each
    assert found[1] != found[2]


def test_rows_come_by_shard_and_place(spark, smallest):
    docs = spark.read.parquet(f"{smallest}/documents.parquet").withColumnRenamed("lang", "__row").withColumn("a.b", F.lit(1))
    out = mixing.apply_mix(docs, shards=4)
    assert out.columns == docs.columns
    pieces = {}
    for p in mixing.mix(docs, shards=4).where("epoch is not null").collect():
        at = pieces.setdefault((p.doc_id, p.epoch), (p.words_from, p.shard, p.place))
        pieces[p.doc_id, p.epoch] = min(at, (p.words_from, p.shard, p.place))
    order = {}
    for (i, _), (_, shard, place) in pieces.items():
        order.setdefault(i, []).append((shard, place))
    got = out.select("doc_id", F.spark_partition_id().alias("p")).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, x in order.items() for _ in x)
    for p in {r.p for r in got}:
        ids = [r.doc_id for r in got if r.p == p]
        at = (-1, 0)
        for i in ids:  # some order of each document's passes ascends
            at = min(x for x in order[i] if x >= at)


def test_pieces_of_the_query(spark, smallest):
    for r in queries.op6_mixing(spark, smallest).collect():
        assert sum(p.words_to - p.words_from for p in r.pieces) == r.taken and all(0 <= p.shard < 8 for p in r.pieces)
