"""Images, layers and files read out of the tables at hand.

The tables hold no images. In ``documents`` a source is an image, a document a
layer (its place is doc_id) and a non-empty line a file; each source is the
baseline of the next. In ``orders`` and ``lineitem`` a month is an image, a line's
part its layer, and the month before the baseline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests
from ..operators import plan
from ..storage import written

#: Sources src0 .. src19 make 19 consecutive pairs.
PAIRS = 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("source").alias("image"), F.col("doc_id").alias("layer_idx"), digests.digest(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("size"), F.col("lang").alias("media_type")
    )


def pairs(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(PAIRS).select(F.concat(F.lit("src"), i, F.lit("-src"), i + 1).alias("pair"), F.concat(F.lit("src"), i).alias("baseline_image"), F.concat(F.lit("src"), i + 1).alias("target_image"))


def side(spark: SparkSession, sf_dir: str, which: str, every: DataFrame | None = None) -> DataFrame:
    """Layers of each pair's target or baseline image; ``every``: all layers, if they are at hand."""
    own = pairs(spark).select("pair", F.col(f"{which}_image").alias("image"))
    return (layers(spark, sf_dir) if every is None else every).join(own, "image").drop("image")


def planned(spark: SparkSession, sf_dir: str, every: DataFrame | None = None) -> DataFrame:
    every = written(layers(spark, sf_dir), "layers") if every is None else every
    return plan.compute_plan(side(spark, sf_dir, "target", every), side(spark, sf_dir, "baseline", every))


def shipped(spark: SparkSession, sf_dir: str, every: DataFrame | None = None) -> DataFrame:
    return planned(spark, sf_dir, every).where("part = 'shipped'").drop("part")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per layer and distinct line; equal documents are read once."""
    texts = table(spark, sf_dir, "documents").select("text").distinct()
    lines = texts.select(digests.digest(F.col("text")).alias("layer_digest"), F.explode(F.split("text", "\n", -1)).alias("line")).where("line <> ''")
    return plan.dedup_fingerprints(lines.select("layer_digest", digests.digest(F.col("line")).alias("file_digest"), F.octet_length("line").cast("long").alias("size")))


def shared_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints of lines that two documents or more hold, digests as in :func:`short`; no other line is shared by two layers.

    Lines are told apart by 8 bytes first, which keeps a few lines too many and loses
    none; neither texts nor lines are shuffled.
    """
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("layer"), F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line")).where("line <> ''").withColumn("key", F.xxhash64("line"))
    several = lines.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    kept = lines.select("key", F.unhex("layer").alias("layer"), F.unhex(F.sha2(F.col("line").cast("binary"), 256)).alias("file"), F.octet_length("line").cast("long").alias("size")).join(several, "key", "left_semi")
    return kept.groupBy("layer", "file").agg(F.max("size").alias("size")).select(F.col("layer").alias("layer_digest"), F.col("file").alias("file_digest"), "size")


def short(df: DataFrame, *columns: str) -> DataFrame:
    """Digests as their 32 bytes, which are in the same order; less than half as long in shuffles."""
    return df.withColumns({c: F.unhex(F.substring(c, 8, 64)) for c in columns})


def named(df: DataFrame, *columns: str) -> DataFrame:
    """Digests of 32 bytes as text again."""
    return df.withColumns({c: F.concat(F.lit("sha256:"), F.lower(F.hex(c))) for c in columns})


def top_candidates(spark: SparkSession, sf_dir: str, k: int = 3, scored: bool = True, every: DataFrame | None = None, ship: DataFrame | None = None) -> DataFrame:
    every = written(layers(spark, sf_dir), "layers") if every is None else every
    ship, base = written(shipped(spark, sf_dir, every), "shipped") if ship is None else ship, side(spark, sf_dir, "baseline", every)
    ship, base = short(ship, "digest"), short(base, "digest")
    scores = plan.leading_scores(ship, base, written(shared_fingerprints(spark, sf_dir), "fingerprints"), k) if scored else None
    return named(plan.pick_top_k(ship, base, scores, k), "target_digest", "candidate_digest")


def encodings(spark: SparkSession, sf_dir: str, every: DataFrame | None = None) -> DataFrame:
    """Encoding of every shipped layer by model cost: size less shared size, one at least; patches need a shared file."""
    every = written(layers(spark, sf_dir), "layers") if every is None else every
    ship = written(shipped(spark, sf_dir, every), "shipped")
    tops = top_candidates(spark, sf_dir, every=every, ship=ship)
    trials = tops.withColumn("cost", F.greatest(F.col("target_size") - F.col("score"), F.lit(1))).withColumn("ceiling", F.when(F.col("score") > 0, F.col("target_size")).otherwise(0))
    return plan.choose_best(ship, plan.ship_refs(ship), trials)


def model_blobs(spark: SparkSession, sf_dir: str, every: DataFrame | None = None) -> DataFrame:
    """The blobs of the model archive, one per digest, written once for all that uses them."""
    best = F.min(F.struct("pair", "layer_idx", "size", "media_type", "encoding", "codec", "patch_from_digest", "archive_size")).alias("b")
    return written(encodings(spark, sf_dir, every).groupBy("digest").agg(best).select("digest", "b.size", "b.media_type", "b.encoding", "b.codec", "b.patch_from_digest", "b.archive_size"), "blobs")


def target_layers(spark: SparkSession, sf_dir: str, every: DataFrame | None = None) -> DataFrame:
    """Target layers with the pair as image."""
    return side(spark, sf_dir, "target", every).withColumnRenamed("pair", "image")


def month_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, layer_idx, digest, size): a month's order lines."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int").alias("image"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("digest"), F.floor(F.col("l_extendedprice") * F.col("l_quantity") * 256).cast("long").alias("size"))
    return lines.join(o, "l_orderkey").select("image", F.col("l_orderkey").alias("layer_idx"), "digest", "size")
