"""Consumer side: what a baseline must hold, whether it does, and whether a rebuilt image is right.

``layers`` (image, layer_idx, digest, size), ``blobs`` (digest, size, encoding,
patch_from_digest, archive_size), ``have`` (image, digest): layers and config of
each image's baseline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def required(layers: DataFrame, blobs: DataFrame) -> DataFrame:
    """(image, need, digest): reuse of layers that do not ship, sources of patches; each once."""
    b = blobs.select("digest", "encoding", "patch_from_digest", F.lit(True).alias("_in"))
    met = layers.select("image", "digest").join(b, "digest", "left")
    need = F.when(F.col("_in").isNull(), "reuse").when((F.col("encoding") == "patch") & (F.coalesce("patch_from_digest", F.lit("")) != ""), "patch_source")
    what = F.when(need == "reuse", F.col("digest")).otherwise(F.col("patch_from_digest"))
    return met.select("image", need.alias("need"), what.alias("digest")).where("need is not null").distinct()


def preflight(images: DataFrame, needs: DataFrame, have: DataFrame, resolved: DataFrame) -> DataFrame:
    """Status of each image: ok, missing_patch_source (which outweighs) missing_reuse_layer, or error without a baseline.

    ``images`` (image), ``resolved`` (image). Missing digests come as sorted arrays.
    """
    lack = needs.join(have.select("image", "digest").distinct(), ["image", "digest"], "left_anti")

    def of(need: str) -> F.Column:
        return F.sort_array(F.collect_set(F.when(F.col("need") == need, F.col("digest"))))

    by = lack.groupBy("image").agg(of("patch_source").alias("missing_patch_sources"), of("reuse").alias("missing_reuse_layers"))
    out = images.select("image").join(resolved.select("image", F.lit(True).alias("_r")).distinct(), "image", "left").join(by, "image", "left")
    none = F.array().cast("array<string>")
    known = F.col("_r").isNotNull()
    patch = F.when(known, F.coalesce("missing_patch_sources", none)).otherwise(none)
    reuse = F.when(known, F.coalesce("missing_reuse_layers", none)).otherwise(none)
    status = F.when(~known, "error").when(F.size(patch) > 0, "missing_patch_source").when(F.size(reuse) > 0, "missing_reuse_layer").otherwise("ok")
    return out.select("image", status.alias("status"), patch.alias("missing_patch_sources"), reuse.alias("missing_reuse_layers"))


def layer_set_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(image, digest, side): missing from or unexpected in the rebuilt image; sets, so repeats count once."""
    e, a = (x.select("image", "digest").distinct() for x in (expected, actual))
    return e.join(a, ["image", "digest"], "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, ["image", "digest"], "left_anti").withColumn("side", F.lit("unexpected")))


def size_mismatches(expected: DataFrame, actual: DataFrame, blobs: DataFrame) -> DataFrame:
    """Layers present on both sides whose size differs from the archive's, or else the manifest's, size."""
    want = expected.select("image", "digest", "size").distinct().join(blobs.select("digest", F.col("size").alias("_b")), "digest", "left")
    want = want.withColumn("want_size", F.when(F.col("_b") > 0, F.col("_b")).otherwise(F.col("size"))).select("image", "digest", "want_size")
    got = actual.groupBy("image", "digest").agg(F.max("size").alias("got_size"))
    return want.join(got, ["image", "digest"]).where("want_size <> got_size")


def invariant(images: DataFrame, expected: DataFrame, actual: DataFrame, blobs: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """Per image: counts of missing, unexpected and wrongly sized layers, and the first reason of failure, if any.

    ``manifests`` (image, expected_digest, expected_type, actual_digest, actual_type):
    digests are compared only where the media types agree.
    """
    d = layer_set_diff(expected, actual).groupBy("image").agg(F.count_if(F.col("side") == "missing").alias("missing"), F.count_if(F.col("side") == "unexpected").alias("unexpected"))
    s = size_mismatches(expected, actual, blobs).groupBy("image").agg(F.count("*").alias("size_mismatches"))
    out = images.select("image").join(d, "image", "left").join(s, "image", "left").fillna(0, ["missing", "unexpected", "size_mismatches"])
    wrong = F.lit(False)
    if manifests is not None:
        out = out.join(manifests, "image", "left")
        wrong = F.coalesce((F.col("expected_type") == F.col("actual_type")) & (F.col("expected_digest") != F.col("actual_digest")), F.lit(False))
    reason = F.when(F.col("missing") + F.col("unexpected") > 0, "layer set mismatch").when(F.col("size_mismatches") > 0, "layer size mismatch").when(wrong, "manifest digest mismatch")
    return out.select("image", "missing", "unexpected", "size_mismatches", reason.alias("reason"))


def resolve_baselines(images: DataFrame, provided: DataFrame) -> DataFrame:
    """Status of every image and provided name: ok, mismatch, missing, or unknown name.

    ``images`` (image, expected_digest), ``provided`` (name, actual_digest). The key
    ``default`` stands for the only image if there is exactly one.
    """
    only = images.agg(F.count("*").alias("_n"), F.min("image").alias("_only"))
    named = provided.crossJoin(only).select(F.when((F.col("_n") == 1) & (F.col("name") == "default"), F.col("_only")).otherwise(F.col("name")).alias("name"), "actual_digest")  # one row on the right
    met = images.join(named, F.col("image") == F.col("name"), "full_outer")
    status = F.when(F.col("image").isNull(), "unknown_name").when(F.col("name").isNull(), "missing").when(F.col("expected_digest") != F.col("actual_digest"), "mismatch").otherwise("ok")
    return met.select(F.coalesce("image", "name").alias("name"), status.alias("status"))


def is_fatal(status: F.Column, strict: bool) -> F.Column:
    """Which resolution statuses end a run: missing baselines only in a strict one."""
    return status.isin(["mismatch", "unknown_name", *(["missing"] if strict else [])])


def apply_order(results: DataFrame, plan: DataFrame) -> DataFrame:
    """Results in the order of the plan (image, position); images outside it last, by name."""
    return results.join(plan.select("image", "position"), "image", "left").withColumn("order", F.coalesce("position", F.lit(2**31 - 1)))


def apply_report(results: DataFrame) -> DataFrame:
    """One row: totals by status, and the first image that did not succeed. ``results`` (image, position, status)."""
    bad = F.when(F.col("status") != "ok", F.struct("position", "image"))
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "ok").alias("successful"),
        F.count_if(F.col("status").startswith("failed")).alias("failed"),
        F.count_if(F.col("status") == "skipped_preflight").alias("skipped"),
        F.min(bad)["image"].alias("first_failed"),
    ).withColumn("run_failed", (F.col("total") > 0) & (F.col("successful") == 0))


def import_dry_run(layers: DataFrame, blobs: DataFrame, provided: DataFrame) -> DataFrame:
    """Per image: layers in all, in the archive, as patches, from the baseline; whether it would be imported, else why not."""
    b = blobs.select("digest", "encoding", F.lit(True).alias("_in"))
    n = layers.join(b, "digest", "left").groupBy("image").agg(
        F.count("*").alias("layer_count"), F.count("_in").alias("archive_layers"), F.count_if(F.col("encoding") == "patch").alias("patch_layers"), F.count_if(F.col("_in").isNull()).alias("baseline_layers")
    )
    out = n.join(provided.select("image", F.lit(True).alias("_p")).distinct(), "image", "left").withColumn("would_import", F.col("_p").isNotNull()).drop("_p")
    return out.withColumn("skip_reason", F.when(~F.col("would_import"), "no baseline provided"))
