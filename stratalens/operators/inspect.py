"""Inspection of an archive: rows, savings, waste, histogram, totals.

``layers`` has (image, layer_idx, digest, size); ``blobs`` (digest, size, encoding,
patch_from_digest, archive_size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sizes


def layer_rows(layers: DataFrame, blobs: DataFrame) -> DataFrame:
    """Each layer with kind full, patch or baseline_only, its sizes and savings. Unknown encodings are full."""
    b = blobs.select("digest", "encoding", "patch_from_digest", F.col("archive_size").alias("_a"))
    met = layers.join(b, "digest", "left")
    kind = F.when(F.col("_a").isNull(), "baseline_only").when(F.col("encoding") == "patch", "patch").otherwise("full")
    met = met.withColumn("kind", kind).withColumn("archive_size", F.coalesce("_a", F.lit(0)).cast("long"))
    saved = F.when(F.col("kind") == "baseline_only", F.col("size")).otherwise(F.col("size") - F.col("archive_size"))
    met = met.withColumn("saved_bytes", saved)
    return met.select(
        "image", "layer_idx", "digest", "kind", F.col("size").alias("target_size"), "archive_size",
        F.when(F.col("kind") == "patch", F.col("patch_from_digest")).alias("patch_from"),
        "saved_bytes",
        sizes.ratio(F.col("saved_bytes"), F.col("size")).alias("saved_ratio"),
        F.when(F.col("kind") == "baseline_only", 0.0).otherwise(sizes.ratio(F.col("archive_size"), F.col("size"))).alias("ratio"),
    )


def waste(rows: DataFrame) -> DataFrame:
    """Patches that are no smaller than their layer."""
    return rows.where((F.col("kind") == "patch") & (F.col("archive_size") >= F.col("target_size"))).select("image", "layer_idx", F.lit("patch_oversized").alias("waste"), "digest", "archive_size", "target_size")


def top_savings(rows: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` rows per image that save most; ties by digest, then order; repeats stay."""
    order = Window.partitionBy("image").orderBy(F.desc("saved_bytes"), "digest", "layer_idx")
    return rows.where("saved_bytes > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("image", "rank", "digest", "saved_bytes", "saved_ratio")


def histogram(rows: DataFrame) -> DataFrame:
    """Layers per image and size bucket; empty buckets count 0. ``rows`` has (image, target_size)."""
    counts = rows.groupBy("image").agg(*[F.count_if(sizes.bucket(F.col("target_size")) == i).alias(f"b{i}") for i in range(len(sizes.BUCKETS))])
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("bucket_idx"), F.lit(label).alias("bucket"), F.col(f"b{i}").alias("layers")) for i, (_, label) in enumerate(sizes.BUCKETS)])).alias("b")
    return counts.select("image", every).select("image", "b.*")


def totals(blobs: DataFrame) -> DataFrame:
    """One row: counts and bytes by encoding, patch ratio and savings (null without patches), whether patches need decoding."""
    patch = F.col("encoding") == "patch"
    out = blobs.agg(
        F.count("*").alias("blobs"),
        F.count_if(F.col("encoding") == "full").alias("full_count"),
        F.count_if(patch).alias("patch_count"),
        F.coalesce(F.sum("archive_size"), F.lit(0)).cast("long").alias("total_archive"),
        F.coalesce(F.sum(F.when(patch, F.col("archive_size"))), F.lit(0)).cast("long").alias("patch_archive"),
        F.coalesce(F.sum(F.when(patch, F.col("size"))), F.lit(0)).cast("long").alias("patch_original"),
    )
    some = (F.col("patch_count") > 0) & (F.col("patch_original") > 0)
    return out.select(
        "*",
        F.when(some, F.col("patch_archive").cast("double") / F.col("patch_original").cast("double")).alias("patch_ratio"),
        F.when(F.col("patch_count") > 0, F.col("patch_original") - F.col("patch_archive")).alias("patch_savings"),
        (F.col("patch_count") > 0).alias("requires_zstd"),
    )


def image_details(rows: DataFrame, n: int = 10) -> DataFrame:
    """One row per image: counts, and layers, waste, top savings and histogram as arrays in order."""

    def packed(df: DataFrame, name: str, *cols: str) -> DataFrame:
        return df.groupBy("image").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))

    out = rows.groupBy("image").agg(F.count("*").alias("layer_count"), F.count_if(F.col("kind") != "baseline_only").alias("archive_layer_count"))
    out = out.join(packed(rows, "layers", "layer_idx", "digest", "kind", "target_size", "archive_size", "patch_from"), "image", "left")
    out = out.join(packed(waste(rows), "waste", "layer_idx", "waste", "digest", "archive_size", "target_size"), "image", "left")
    out = out.join(packed(top_savings(rows, n), "top_savings", "rank", "digest", "saved_bytes", "saved_ratio"), "image", "left")
    return out.join(packed(histogram(rows), "histogram", "bucket_idx", "bucket", "layers"), "image", "left")


def envelope(details: DataFrame) -> DataFrame:
    """Each row as a JSON document {schema_version: 1, data: row}."""
    return details.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.struct(*details.columns).alias("data"))).alias("json"))


def rendered(rows: DataFrame) -> DataFrame:
    """A line of text per layer, for people."""
    size = lambda c: sizes.human(F.col(c))
    line = (
        F.when(F.col("kind") == "patch", F.format_string("[P] %s  %s -> %s (%.2fx - patch from %s)", "digest", size("target_size"), size("archive_size"), "ratio", "patch_from"))
        .when(F.col("kind") == "full", F.format_string("[F] %s  %s -> %s", "digest", size("target_size"), size("archive_size")))
        .otherwise(F.format_string("[B] %s  %s (baseline only)", "digest", size("target_size")))
    )
    return rows.select("image", "layer_idx", line.alias("line"))
