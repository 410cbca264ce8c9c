"""Planner operators on small cases."""

import pytest
from pyspark.sql import functions as F

from stratalens.operators import plan

LAYER = "pair string, layer_idx int, digest string, size long, media_type string"


def layers(spark, *rows, pair="p"):
    return spark.createDataFrame([(pair, i, d, n, "m") for i, (d, n) in enumerate(rows)], LAYER)


def prints(spark, **held):
    return spark.createDataFrame([(layer, f, n) for layer, files in held.items() for f, n in files.items()], "layer_digest string, file_digest string, size long")


def test_plan_keeps_order_and_repeats(spark):
    got = plan.compute_plan(layers(spark, ("b", 1), ("d", 2), ("d", 2)), layers(spark, ("a", 1), ("b", 1), ("b", 1), ("c", 1)))
    assert [(r.layer_idx, r.digest, r.part) for r in got.orderBy("layer_idx").collect()] == [(0, "b", "required"), (1, "d", "shipped"), (2, "d", "shipped")]


def test_plan_empty_sides(spark):
    some, none = layers(spark, ("a", 1)), layers(spark)
    assert [r.part for r in plan.compute_plan(some, none).collect()] == ["shipped"]
    assert plan.compute_plan(none, some).count() == 0


def test_score_weighs_by_the_target(spark):
    t, c = layers(spark, ("t", 150)), layers(spark, ("c", 300))
    got = plan.similarity_scores(t, c, prints(spark, t={"s": 100, "a": 50}, c={"s": 100, "b": 200}))
    assert [r.score for r in got.collect()] == [100]
    assert plan.similarity_scores(t, c, prints(spark, t={"a": 1}, c={"b": 1})).count() == 0


def test_top_k_ties_fallback_and_clamp(spark):
    base = layers(spark, ("A", 100), ("B", 200), ("C", 300))
    target = layers(spark, ("t", 150))
    scores = plan.similarity_scores(target, base, prints(spark, t={"s": 100}, A={"s": 50}, B={"s": 80}))
    rank = lambda s, k: [r.candidate_digest for r in plan.pick_top_k(target, base, s, k).orderBy("rank").collect()]
    assert rank(scores, 2) == ["A", "B"]  # equal scores, equal distance: by digest
    assert rank(None, 2) == ["A", "B"]
    assert rank(scores, 9) == ["A", "B", "C"]
    assert rank(scores, 0) == []
    near = plan.pick_top_k(layers(spark, ("t", 240)), layers(spark, ("x", 100), ("y", 250)), None, 2)
    assert [r.candidate_digest for r in near.orderBy("rank").collect()] == ["y", "x"]


def test_best_needs_a_strict_gain_and_a_single_use(spark):
    ship = layers(spark, ("one", 100), ("two", 100), ("two", 100), ("tie", 100))
    trials = spark.createDataFrame(
        [("p", "one", "r1", 1, 60, 80), ("p", "one", "r2", 2, 60, 80), ("p", "two", "r1", 1, 10, 80), ("p", "tie", "r1", 1, 80, 80)],
        "pair string, target_digest string, candidate_digest string, rank int, cost long, ceiling long",
    )
    got = {(r.digest): (r.encoding, r.patch_from_digest, r.archive_size) for r in plan.choose_best(ship, plan.ship_refs(ship), trials).collect()}
    assert got == {"one": ("patch", "r1", 60), "two": ("full", None, 100), "tie": ("full", None, 100)}


def test_pool_takes_the_first_and_refs_count_repeats(spark):
    a = layers(spark, ("x", 1), ("y", 2), pair="a").unionByName(layers(spark, ("y", 2), ("x", 1), pair="b"))
    assert {r.digest: (r.pair, r.layer_idx) for r in plan.blob_pool(a).collect()} == {"x": ("a", 0), "y": ("a", 1)}
    assert {r.digest: r.ship_refs for r in plan.ship_refs(a).collect()} == {"x": 2, "y": 2}


def test_budgets(spark):
    big = layers(spark, ("s", 1), ("l", 200 << 20), ("xl", 2 << 30))
    assert [r.digest for r in plan.over_budget(big, 1 << 30).collect()] == ["xl"]
    assert plan.over_budget(big, 0).count() == 0
    assert plan.over_budget(big, 8 << 30).count() == 0
    images = big.select(F.lit("i").alias("image"), "digest", "size")
    assert plan.image_rss(images).first().est_rss == 4 << 30
    blobs = spark.createDataFrame([("s", 1)], "digest string, size long")
    assert plan.image_rss(images, blobs).first().est_rss == 256 << 20
    assert plan.image_rss(images, blobs.limit(0)).first().est_rss == 0
    assert plan.images_over_budget(plan.image_rss(images), 1 << 30).count() == 1


@pytest.mark.parametrize("parts", ["1", "4", "16"])
def test_ranking_does_not_depend_on_partitions(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        base = layers(spark, *[(f"d{i}", i % 3) for i in range(20)])
        got = plan.pick_top_k(layers(spark, ("t", 1)), base, None, 5).orderBy("rank").collect()
        assert [r.candidate_digest for r in got] == ["d1", "d10", "d13", "d16", "d19"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_top_k_against_all_pairs(spark):
    """Sizes with many ties and gaps, some candidates with scores, against every candidate of the pair compared."""
    import random

    rnd = random.Random(6)
    sizes = [0, 1, 2, 3, 50, 50, 51, 1000, 1001, 10**6, 10**9]
    targets = [(p, f"t{i}", rnd.choice(sizes)) for p in ("a", "b", "c") for i in range(25)]
    cands = [(p, f"c{i:02d}", rnd.choice(sizes)) for p, n in (("a", 40), ("b", 2)) for i in range(n)]
    scores = [(p, t, c, rnd.randint(1, 3)) for p, t, _ in targets for q, c, _ in cands if p == q and rnd.random() < 0.05]
    df = lambda rows: spark.createDataFrame([(p, 0, d, s, "m") for p, d, s in rows], "pair string, layer_idx int, digest string, size long, media_type string")
    held = spark.createDataFrame(scores, "pair string, target_digest string, candidate_digest string, score long")
    for given in (None, held):
        known = {} if given is None else {(p, t, c): s for p, t, c, s in scores}
        for k in (0, 1, 3, 7):
            want = []
            for p, t, size in targets:
                order = sorted((-known.get((p, t, c), 0), abs(size - s), c) for q, c, s in cands if p == q)
                want += [(p, t, c, i + 1) for i, (_, _, c) in enumerate(order[:k])]
            got = plan.pick_top_k(df(targets), df(cands), given, k).select("pair", "target_digest", "candidate_digest", "rank").collect()
            assert sorted(map(tuple, got)) == sorted(want), k


def shared_files(spark, seed, ends):
    """Random layers of two pairs whose files are few, so that many layers share several, and many have the same files."""
    import random

    rnd = random.Random(seed)
    files = {f"f{i}": rnd.choice((5, 5, 7, 12, 30)) for i in range(14)}
    held, targets, cands = {}, [], []
    for pair in ("a", "b"):
        for side, out in (("t", targets), ("c", cands)):
            for i in range(ends):
                d = f"{pair}{side}{i:03d}"
                held[d] = {f for j, f in enumerate(files) if rnd.random() < (0.6 if j == 0 else 0.5 / (j + 1))}
                out.append((pair, 0, d, rnd.choice((1, 2, 3, 40, 41, 41, 900)), "m"))
    schema = "pair string, layer_idx int, digest string, size long, media_type string"
    prints = spark.createDataFrame([(d, f, files[f]) for d, x in held.items() for f in x], "layer_digest string, file_digest string, size long")
    scores = {(p, t, c): sum(files[f] for f in held[t] & held[c]) for p, _, t, _, _ in targets for q, _, c, _, _ in cands if p == q and held[t] & held[c]}
    return spark.createDataFrame(targets, schema), spark.createDataFrame(cands, schema), prints, scores


@pytest.mark.parametrize("seed", [1, 2])
def test_leading_scores_give_the_same_references(spark, seed):
    target, base, prints_, scores = shared_files(spark, seed, 60)
    every = spark.createDataFrame([(*k, v) for k, v in scores.items()], "pair string, target_digest string, candidate_digest string, score long")
    for k in (1, 3, 8):
        rows = [sorted(map(tuple, plan.pick_top_k(target, base, s, k).select("pair", "target_digest", "candidate_digest", "score", "distance", "rank").collect())) for s in (every, plan.leading_scores(target, base, prints_, k))]
        assert rows[0] == rows[1], k


def test_leading_scores_of_a_file_that_all_layers_hold(spark):
    """Of 300 x 300 pairs that share a file, each target meets at most six."""
    names = [f"{i:03d}" for i in range(300)]
    target, base = (layers(spark, *[(x + n, i % 50) for i, n in enumerate(names)]) for x in "tc")
    got = plan.leading_scores(target, base, prints(spark, **{x + n: {"license": 9} for x in "tc" for n in names}), 3)
    assert 900 <= got.count() <= 1800
    top = plan.pick_top_k(target, base, got, 3)
    assert top.count() == 900 and top.where("score <> 9 or distance > 0").count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_similarity_scores_against_all_pairs(spark, seed):
    target, base, prints_, scores = shared_files(spark, seed, 60)
    got = plan.similarity_scores(target, base, prints_).collect()
    assert len(got) == len(scores) and {(r.pair, r.target_digest, r.candidate_digest): r.score for r in got} == scores
