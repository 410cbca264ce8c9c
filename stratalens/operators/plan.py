"""Producer side: what ships, how similar layers are, which reference a patch takes.

Frames: ``target`` and ``baseline`` have (pair, layer_idx, digest, size, media_type);
``fingerprints`` has (layer_digest, file_digest, size), one row per distinct file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sizes
from ..storage import written


def compute_plan(target: DataFrame, baseline: DataFrame) -> DataFrame:
    """``target`` with ``part``: required if the pair's baseline has the digest, else shipped. Order and repeats stay."""
    have = baseline.select("pair", "digest").distinct().withColumn("_have", F.lit(True))
    return target.join(have, ["pair", "digest"], "left").withColumn("part", F.when(F.col("_have"), "required").otherwise("shipped")).drop("_have")


def dedup_fingerprints(files: DataFrame) -> DataFrame:
    """One row per layer and file content."""
    return files.groupBy("layer_digest", "file_digest").agg(F.max("size").alias("size"))


def _classed(layers: DataFrame, fingerprints: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Layers (pair, digest, size) and ``other`` by the files they share: two tables (cls, pair, digest, size, files).

    ``files`` are those of a layer that some layer of the other side in its pair has
    too, as (n, file, file_size, held): layers of both sides and of the other side that
    hold it, rarest first; ``file`` is a number for pair and digest. Layers without such
    files are left out. ``cls`` is one for layers of a pair with the same files: they
    have the same score with any layer of the other side.
    """
    keys = ["pair", "file_digest"]
    prints = fingerprints.select(F.col("layer_digest").alias("digest"), "file_digest", F.col("size").alias("file_size"))
    t, c = (written(x.select("pair", "digest", "size").join(prints, "digest"), "files") for x in (layers, other))
    held = c.groupBy(*keys).agg(F.count("*").alias("held"))
    common = t.groupBy(*keys).agg(F.count("*").alias("n"), F.max("file_size").alias("file_size")).join(held, keys)
    common = written(common.select(*keys, F.struct((F.col("n") + F.col("held")).alias("n"), F.monotonically_increasing_id().alias("file"), "file_size", "held").alias("e")), "common")
    out = []
    for x in (t, c):
        own = x.join(common, keys).groupBy("pair", "digest", "size").agg(F.sort_array(F.collect_list("e")).alias("files"))
        cls = F.unhex(F.sha2(F.concat_ws(",", F.transform("files", lambda e: e["file"].cast("string"))), 256))
        out.append(written(own.select(cls.alias("cls"), "pair", "digest", "size", "files"), "classes"))
    return out[0], out[1]


def similarity_scores(targets: DataFrame, candidates: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(pair, target_digest, candidate_digest, score): size, as the target has it, of the files both share.

    ``targets`` and ``candidates`` have (pair, digest). Layers without common files
    are not listed. Scores are summed between classes of layers with the same common
    files; their members, in lists of about a hundred, are met last, so that no row of the
    result is shuffled.
    """
    t, c = (x.select("pair", "digest", F.lit(0).alias("size")).distinct() for x in (targets, candidates))
    t, c = _classed(t, fingerprints, c)
    each = lambda x, name: x.dropDuplicates(["cls"]).select(F.col("cls").alias(name), F.explode("files").alias("e")).select(name, "e.file", "e.file_size")
    scores = each(t, "t").join(each(c, "c").drop("file_size"), "file").groupBy("t", "c").agg(F.sum("file_size").cast("long").alias("score"))

    def members(x: DataFrame, name: str, *more: str) -> DataFrame:
        dealt = x.join(x.groupBy("cls").agg(F.count("*").alias("of")), "cls").withColumn("bin", F.pmod(F.xxhash64("digest"), F.ceil(F.col("of") / 100)))
        return dealt.groupBy(F.col("cls").alias(name), "bin", *more).agg(F.collect_list("digest").alias(f"{name}_list")).drop("bin")

    met = scores.join(members(t, "t", "pair"), "t").drop("t").join(members(c, "c"), "c").select("pair", "t_list", "c_list", "score")
    return met.select("pair", F.explode("t_list").alias("target_digest"), "c_list", "score").select("pair", "target_digest", F.explode("c_list").alias("candidate_digest"), "score")


def leading_scores(targets: DataFrame, baseline: DataFrame, fingerprints: DataFrame, k: int = 3) -> DataFrame:
    """What :func:`pick_top_k` needs of :func:`similarity_scores` to find the same ``k``, without all that share a file.

    ``targets`` and ``baseline`` have (pair, digest, size). A candidate that shares one
    file with a target is among the best only if it is among the ``k`` nearest in size
    that hold the file, and the file no smaller than one that ``k`` candidates hold. If
    it shares two or more, then one that is the most frequent of neither's files: these
    are joined, by classes of layers with the same files. Of classes, those with ``k``
    members of higher score before them are left out; of members, all but the ``k``
    nearest in size. Candidates may come several times; the largest score counts.
    """
    k = max(k, 1)
    size = lambda x: x.groupBy("pair", "digest").agg(F.max("size").alias("size"))
    t, c = _classed(targets.select("pair", "digest", "size").distinct(), fingerprints, size(baseline))
    # classes that share two files or more
    both = []
    for x, name in ((t, "t"), (c, "c")):
        one = x.groupBy(F.col("cls").alias(name)).agg(F.first("files").alias("files"), F.count("*").alias(f"{name}_n"))
        both.append(written(one.where(F.size("files") > 1), "shared"))
    rare = [x.select(name, f"{name}_n", F.element_at("files", -1).alias(f"{name}_last"), F.explode(F.slice("files", F.lit(1), F.size("files") - 1)).alias("e")).select(name, f"{name}_n", f"{name}_last", "e.file", "e.file_size") for x, name in zip(both, "tc", strict=True)]
    met = rare[0].drop("t_n").join(rare[1].drop("file_size"), "file").groupBy("t", "c").agg(F.sum("file_size").alias("score"), F.first("t_last").alias("t_last"), F.first("c_last").alias("c_last"), F.first("c_n").alias("c_n"))
    # the one file that both may share though it is the most frequent of one of them
    met = met.withColumn("last", F.when(F.col("t_last") < F.col("c_last"), F.col("t_last")).otherwise(F.col("c_last"))).select("t", "c", "score", "c_n", F.col("last.file").alias("file"), F.col("last.file_size").alias("file_size"))
    for x, name in zip(both, "tc", strict=True):
        met = met.join(x.select(name, F.explode("files.file").alias("file"), F.lit(1).alias(f"in_{name}")), [name, "file"], "left")
    met = met.withColumn("score", F.col("score") + F.when(F.col("in_t").isNotNull() & F.col("in_c").isNotNull(), F.col("file_size")).otherwise(0))
    above = Window.partitionBy("t").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, -1)
    kept = written(met.withColumn("above", F.coalesce(F.sum("c_n").over(above), F.lit(0))).where(F.col("above") < k).select("t", "c", F.col("score").cast("long").alias("score")), "kept")
    # targets ask files and classes for those nearest in size
    ask = lambda key: (key.alias("pair"), F.struct("pair", "digest", F.col("score").cast("long").alias("score")).alias("target_digest"), F.col("size").alias("target_size"))
    enough = F.array_max(F.transform(F.filter("files", lambda e: e["held"] >= k), lambda e: e["file_size"]))
    single = t.withColumn("enough", F.coalesce(enough, F.lit(0))).select("pair", "digest", "size", F.explode(F.filter("files", lambda e: e["file_size"] >= F.col("enough"))).alias("e"))
    asks = single.withColumn("score", F.col("e.file_size")).select(*ask(F.col("e.file").cast("string")))
    asks = written(asks.unionByName(t.withColumnRenamed("cls", "t").drop("files").join(kept, "t").select(*ask(F.hex("c")))), "asks")
    held = c.select(F.explode("files.file").alias("file"), "digest", "size").select(F.col("file").cast("string").alias("pair"), "digest", "size").unionByName(c.join(kept.select(F.col("c").alias("cls")).distinct(), "cls", "left_semi").select(F.hex("cls").alias("pair"), "digest", "size"))
    held = held.join(asks.select("pair").distinct(), "pair", "left_semi").select("pair", F.col("digest").alias("candidate_digest"), F.col("size").alias("candidate_size"))
    near = nearest_in_size(asks, held, k)
    return near.select("target_digest.pair", F.col("target_digest.digest").alias("target_digest"), "candidate_digest", "target_size", "candidate_size", "target_digest.score")


def nearest_in_size(targets: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(pair, target_digest, candidate_digest, target_size, candidate_size): of each target the ``k`` candidates next below (or equal) and above in size, ties by digest.

    The best ``k`` by distance are among these. Candidates are numbered by size within
    the pair, a target's place is the number of candidates up to its size, and places
    are joined with numbers, so a target meets 2 ``k`` candidates. Numbers are counted
    within ranges of sizes and added to the sums of the ranges before: no window
    holds all layers of a pair.
    """
    band = lambda size: F.floor(F.log2(size + 1) * 32).cast("int")
    c = candidates.withColumn("band", band(F.col("candidate_size")))
    before = Window.partitionBy("pair").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of sizes
    bases = c.groupBy("pair", "band").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("upto", F.col("base") + F.col("n"))
    own = Window.partitionBy("pair", "band")
    numbered = c.select("pair", "band", "candidate_digest", "candidate_size", *[F.row_number().over(own.orderBy("candidate_size", order)).alias(name) for name, order in (("low", F.desc("candidate_digest")), ("high", F.asc("candidate_digest")))])
    numbered = numbered.join(bases.select("pair", "band", "base"), ["pair", "band"])
    # a target's place: candidates of smaller ranges, and those of its own range up to its size
    t = targets.select("pair", "target_digest", "target_size").withColumn("band", band(F.col("target_size")))
    both = t.select("pair", "band", F.col("target_size").alias("size"), F.lit(1).alias("asks"), "target_digest").unionByName(c.select("pair", "band", F.col("candidate_size").alias("size"), F.lit(0).alias("asks"), F.lit(None).cast(targets.schema["target_digest"].dataType).alias("target_digest")))
    running = own.orderBy("size", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = both.withColumn("within", F.sum(1 - F.col("asks")).over(running)).where("asks = 1").select("pair", "band", "target_digest", F.col("size").alias("target_size"), "within")
    # ranges without candidates take the sum of the last range before them
    sums = asked.select("pair", "band").distinct().join(bases.select("pair", "band", "upto"), ["pair", "band"], "full_outer").select("pair", "band", F.max("upto").over(before).alias("below"))
    placed = asked.join(sums, ["pair", "band"], "left").withColumn("place", F.coalesce("below", F.lit(0)) + F.col("within"))
    steps = F.array(*[F.struct(F.lit(name).alias("way"), (F.col("place") + i).alias("number")) for name, places in (("low", range(1 - k, 1)), ("high", range(1, k + 1))) for i in places])
    asked = placed.select("pair", "target_digest", "target_size", F.explode(steps).alias("s")).select("pair", "target_digest", "target_size", "s.way", "s.number")
    ways = F.array(*[F.struct(F.lit(name).alias("way"), (F.col("base") + F.col(name)).alias("number")) for name in ("low", "high")])
    numbered = numbered.select("pair", "candidate_digest", "candidate_size", F.explode(ways).alias("s")).select("pair", "candidate_digest", "candidate_size", "s.way", "s.number")
    return asked.join(numbered, ["pair", "way", "number"]).select("pair", "target_digest", "candidate_digest", "target_size", "candidate_size")


def pick_top_k(targets: DataFrame, baseline: DataFrame, scores: DataFrame | None, k: int = 3) -> DataFrame:
    """The ``k`` best references per target: score down, distance in size up, digest up.

    Candidates without a score count as 0, so that size decides; without ``scores``
    (no fingerprints) size decides for all. ``k`` <= 0 or no candidate: no rows.
    Ranked are the candidates with a score and those nearest in size: if fewer than
    ``k`` have a score, the ``k`` nearest hold all that are needed besides.
    """
    t = targets.select("pair", F.col("digest").alias("target_digest"), F.col("size").alias("target_size")).where("target_digest is not null").distinct()
    c = baseline.where("digest is not null").groupBy("pair", F.col("digest").alias("candidate_digest")).agg(F.max("size").alias("candidate_size"))
    keys = ["pair", "target_digest", "candidate_digest"]
    met = nearest_in_size(t, c, max(k, 1)).withColumn("score", F.lit(0).cast("long"))
    if scores is not None:
        if "target_size" not in scores.columns:
            scores = scores.join(t, ["pair", "target_digest"]).join(c, ["pair", "candidate_digest"])
        met = met.unionByName(scores.select(*met.columns)).repartition("pair", "target_digest").groupBy(*keys, "target_size", "candidate_size").agg(F.max("score").alias("score"))
    met = met.withColumn("distance", F.abs(F.col("target_size") - F.col("candidate_size")))
    order = Window.partitionBy("pair", "target_digest").orderBy(F.desc("score"), "distance", "candidate_digest")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ship_refs(shipped: DataFrame) -> DataFrame:
    """How often each digest ships, over all pairs and repeats."""
    return shipped.groupBy("digest").agg(F.count("*").alias("ship_refs"))


def blob_pool(entries: DataFrame) -> DataFrame:
    """One entry per digest: of several, the first by (pair, layer_idx)."""
    first = F.min(F.struct("pair", "layer_idx", "size", "media_type"))
    return entries.groupBy("digest").agg(first.alias("e")).select("digest", "e.pair", "e.layer_idx", "e.size", "e.media_type")


def choose_best(shipped: DataFrame, refs: DataFrame, trials: DataFrame) -> DataFrame:
    """Encoding of each shipped layer: the best trial that pays, else full.

    ``trials`` has (pair, target_digest, candidate_digest, rank, cost, ceiling): the
    patch must be smaller than the fully compressed layer (``ceiling``) and the raw
    layer; the smallest wins, and of equals the better rank. A digest that ships more
    than once is always full.
    """
    pays = trials.join(shipped.select("pair", F.col("digest").alias("target_digest"), "size").distinct(), ["pair", "target_digest"]).where((F.col("cost") < F.col("ceiling")) & (F.col("cost") < F.col("size")))
    best = pays.groupBy("pair", F.col("target_digest").alias("digest")).agg(F.min(F.struct("cost", "rank", "candidate_digest")).alias("b"))
    out = shipped.join(refs, "digest").join(best, ["pair", "digest"], "left")
    patch = F.col("b").isNotNull() & (F.col("ship_refs") == 1)
    return out.select(
        "pair", "layer_idx", "digest", "size", "media_type",
        F.when(patch, "patch").otherwise("full").alias("encoding"),
        F.when(patch, "zstd-patch").alias("codec"),
        F.when(patch, F.col("b.candidate_digest")).alias("patch_from_digest"),
        F.when(patch, F.col("b.cost")).otherwise(F.col("size")).alias("archive_size"),
    )


def over_budget(layers: DataFrame, budget: int, asked_window: int = 0) -> DataFrame:
    """The layer of largest estimated memory, if it exceeds the budget; of equals the first by (pair, layer_idx). Budget 0: no rows."""
    est = layers.withColumn("est_rss", sizes.window_rss(sizes.window_log(F.col("size"), asked_window)))
    first = est.agg(F.min(F.struct((-F.col("est_rss")).alias("neg"), "pair", "layer_idx", "digest")).alias("m")).where("m is not null")
    return first.select("m.pair", "m.layer_idx", "m.digest", (-F.col("m.neg")).alias("est_rss")).where((F.lit(budget) > 0) & (F.col("est_rss") > budget))


def image_rss(layers: DataFrame, blobs: DataFrame | None = None, asked_window: int = 0) -> DataFrame:
    """Largest estimated memory of each image's shipped layers; 0 where all come from the baseline."""
    if blobs is not None:
        layers = layers.drop("size").join(blobs.select("digest", "size"), "digest", "left")
    est = F.when(F.col("size").isNotNull(), sizes.window_rss(sizes.window_log(F.col("size"), asked_window)))
    return layers.groupBy("image").agg(F.coalesce(F.max(est), F.lit(0)).cast("long").alias("est_rss"))


def images_over_budget(rss: DataFrame, budget: int) -> DataFrame:
    """The first image, in order, whose estimate exceeds the budget. Budget <= 0: no rows."""
    return rss.where((F.lit(budget) > 0) & (F.col("est_rss") > budget)).agg(F.min(F.struct("image", "est_rss")).alias("m")).where("m is not null").select("m.*")


def export_dry_run(shipped: DataFrame, blobs: DataFrame) -> DataFrame:
    """Per pair: shipped occurrences and archive bytes."""
    return shipped.select("pair", "digest").join(blobs.select("digest", "archive_size"), "digest").groupBy("pair").agg(F.count("*").alias("shipped_blobs"), F.sum("archive_size").cast("long").alias("archive_size"))
