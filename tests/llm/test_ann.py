"""Nearest neighbours: recall against brute force, ties, odd vectors."""

import numpy as np
import pytest

from stratalens.llm import ann, queries


def brute(ids, x, every=20, top=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        others = np.flatnonzero(np.arange(len(ids)) != i)
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in others[np.lexsort((ids[others], -s[others]))][:top]]
    return out


#: The production parameters of one block.
OPTIONS = {"projections": 256, "threshold": 0.65, "miss": 0.03, "width": 0.2, "grow": 2.0, "ahead": 80, "seed": 11}


def vectors(kind, n, d):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, d))
    if kind == "gauss":
        return x
    if kind == "clustered":
        x = np.repeat(rng.standard_normal((n // 40, d)), 40, 0) + 0.05 * x
    x /= np.sqrt((x * x).sum(1))[:, None]
    if kind == "one long":
        x[17] *= 5.0
    if kind == "lognormal":
        x *= rng.lognormal(0.0, 0.5, (n, 1))
    return x


@pytest.mark.parametrize("kind, n, d", [("unit", 500, 64), ("unit", 2000, 64), ("gauss", 5000, 64), ("clustered", 4000, 64), ("lognormal", 4000, 64), ("one long", 4000, 64), ("unit", 4000, 384)])
def test_recall_through_the_index(kind, n, d):
    """The same rule at every size: no vector is found but by its collisions."""
    x, ids = vectors(kind, n, d), np.arange(n)
    q = ids[:: n // 100]
    found = ann.search_block(ids, ids, x, q, x[q], 20, **OPTIONS)
    want = brute(ids, x, n // 100)
    hits = [len({j for j, _ in want[int(q[i])]} & set(at.tolist())) / 20 for i, at, _ in found]
    assert len(hits) == len(q) and np.mean(hits) >= 0.95 and min(hits) >= 0.7


def test_clustered_vectors_need_few_products():
    x, ids = vectors("clustered", 4000, 64), np.arange(4000)
    seen = []
    real = ann.Best.add
    try:
        ann.Best.add = lambda self, at, v, q: (seen.append(len(at)), real(self, at, v, q))[1]
        list(ann.search_block(ids, ids, x, ids[:50], x[:50], 20, **OPTIONS))
    finally:
        ann.Best.add = real
    assert sum(seen) < 0.1 * 50 * 4000


def test_isolated_vectors_are_counted_twice():
    """Once to learn how near neighbours are, once at the last width; all neighbours that count are among those."""
    x, ids = vectors("unit", 4000, 64), np.arange(4000)
    counted = []
    recount, entered = ann.Projections.recount, ann.Projections.entered
    try:
        ann.Projections.recount = lambda self, counts, low, high: (counted.append(len(counts)), recount(self, counts, low, high))[1]
        ann.Projections.entered = lambda self, *a: (counted.append(1), entered(self, *a))[1]
        list(ann.search_block(ids, ids, x, ids[:50], x[:50], 20, **OPTIONS))
    finally:
        ann.Projections.recount, ann.Projections.entered = recount, entered
    assert sum(counted) <= 2 * 50


def test_recount_in_parts_counts_the_same(monkeypatch):
    x = np.random.default_rng(0).standard_normal((300, 8))
    p = ann.Projections(x, float(np.sqrt((x * x).sum(1).max())), 10, 6, 0.03, 1)
    low, high = np.tile(np.arange(7) * 20, (10, 1)), np.tile(np.arange(7) * 20 + 90, (10, 1))
    whole, parts = np.empty((7, 300), np.uint8), np.empty((7, 300), np.uint8)
    p.recount(whole, low, high)
    monkeypatch.setattr(ann, "AT_HAND", 600)  # two queries at a time
    p.recount(parts, low, high)
    assert (whole == parts).all() and whole.sum() == 7 * 10 * 90


def test_copies_rank_by_id():
    x, ids = np.repeat(vectors("unit", 300, 64), 10, 0), np.arange(3000)[::-1].copy()
    for i, at, scores in ann.search_block(np.arange(3000), ids, x, np.arange(0, 3000, 60), x[::60], 20, **OPTIONS):
        own = 60 * i
        copies = [k for k in range(own // 10 * 10, own // 10 * 10 + 10) if k != own]
        assert at[:9].tolist() == sorted(copies, key=lambda k: ids[k]) and len(set(scores[:9])) == 1
        assert all(ids[a] < ids[b] for a, b, s, t in zip(at, at[1:], scores, scores[1:]) if s == t)


def test_collisions_count_windows():
    x = np.random.default_rng(0).standard_normal((300, 8))
    p = ann.Projections(x, float(np.sqrt((x * x).sum(1).max())), 10, 6, 0.03, 1)
    low, high = np.full((10, 1), 20), np.full((10, 1), 90)
    want = np.zeros(300, int)
    for k in range(10):
        want[p.order[k, 20:90]] += 1
    counts = np.zeros((1, 300), np.uint16)
    p.recount(counts, low, high)
    assert (counts[0] == want).all()
    p.recount(counts, low * 0, low * 0 + 300)
    assert (counts == 10).all()
    step, middle = np.zeros(300, np.uint16), np.full(10, 50)
    for a, b in ((45, 55), (45, 55), (20, 90)):
        new = np.stack([np.full(10, a), np.full(10, b)])
        p.entered(step, middle if middle.ndim == 2 else np.stack([middle, middle]), new)
        middle = new
    assert (step == want).all()


def test_window_factor_bounds_misses():
    f = ann.window_factor(256, 166, 0.03)
    hits = (np.abs(np.random.default_rng(2).standard_normal((20_000, 256))) <= f).sum(1)
    assert abs((hits >= 166).mean() - 0.97) < 0.005  # four standard errors
    assert ann.window_factor(256, 166, 0.0) == float("inf")


@pytest.mark.parametrize("components", [1 << 20, 64 * 100])
def test_table(spark, smallest, components):
    """All in one block, and in several."""
    rows = spark.read.parquet(f"{smallest}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    want = brute(ids, x)
    got = {}
    for r in ann.nearest(spark.read.parquet(f"{smallest}/embeddings.parquet"), components=components, query_block=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    at = {int(v): k for k, v in enumerate(ids)}
    assert all(abs(s - x[at[q]] @ x[at[v]]) < 1e-12 for q, found in got.items() for v, s in found)


def test_odd_vectors_and_ties(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (7, [0.5, 0.5]), (1, [0.5, 0.5]), (None, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (40, [1.0, nan]), (60, [1.0, 2.0, 3.0]), (4, []), (5, [None, 1.0]), (6, [float("inf"), 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = [tuple(r) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (0, 3, 7, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5), (20, 3, 7, 0.5)]
    assert ann.nearest(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [3.0])], "vec_id long, embedding array<float>")
    assert sorted(r.score for r in ann.nearest(twice).collect()) == [2.0, 2.0, 3.0, 6.0]


def test_query(spark, smallest):
    assert queries.op10_nearest(spark, smallest).columns == ["query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("kind, d", [("one long", 64), ("lognormal", 64), ("unit", 384), ("clustered", 64)])
def test_exact_where_projections_separate_poorly(kind, d):
    """With a chance of missing of 0, every true neighbour is found."""
    n = 8000
    x, ids = vectors(kind, n, d), np.arange(n)
    q = ids[ids % 200 == 0]
    found = ann.search_block(ids, ids, x, q, x[q], 20, **(OPTIONS | {"miss": 0.0}))
    want = brute(ids, x, 200)
    for i, at, scores in found:
        assert at.tolist() == [j for j, _ in want[int(q[i])]]
        assert np.allclose(scores, x[at] @ x[q[i]], rtol=0, atol=1e-12)
