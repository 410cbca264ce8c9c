"""Consumer checks on small cases."""

import pytest
from pyspark.sql import functions as F

from stratalens.operators import apply

L, B = "image string, layer_idx int, digest string, size long", "digest string, size long, encoding string, patch_from_digest string, archive_size long"


@pytest.fixture
def case(spark):
    layers = spark.createDataFrame([("i", 0, "full", 1), ("i", 1, "patch", 2), ("i", 2, "reuse", 3), ("i", 3, "reuse", 3)], L)
    return layers, spark.createDataFrame([("full", 1, "full", None, 1), ("patch", 2, "patch", "src", 1)], B)


def test_required(spark, case):
    assert {(r.need, r.digest) for r in apply.required(*case).collect()} == {("reuse", "reuse"), ("patch_source", "src")}


@pytest.mark.parametrize("have, status", [(["reuse", "src"], "ok"), (["src"], "missing_reuse_layer"), (["reuse"], "missing_patch_source"), ([], "missing_patch_source")])
def test_preflight(spark, case, have, status):
    images = spark.createDataFrame([("i",), ("gone",)], "image string")
    held = spark.createDataFrame([("i", d) for d in have], "image string, digest string")
    got = {r.image: r for r in apply.preflight(images, apply.required(*case), held, images.where("image = 'i'")).collect()}
    assert got["i"].status == status and got["gone"].status == "error" and got["gone"].missing_reuse_layers == []
    assert got["i"].missing_reuse_layers == ([] if "reuse" in have else ["reuse"])


def test_invariant(spark, case):
    layers, blobs = case
    images = spark.createDataFrame([("i",)], "image string")
    assert apply.invariant(images, layers, layers, blobs).first().reason is None
    lost = layers.where("digest <> 'full'").unionByName(spark.createDataFrame([("i", 9, "new", 1)], L))
    r = apply.invariant(images, layers, lost, blobs).first()
    assert (r.missing, r.unexpected, r.reason) == (1, 1, "layer set mismatch")
    wrong = layers.withColumn("size", F.when(F.col("digest") == "patch", 7).otherwise(F.col("size")).cast("long"))
    assert apply.invariant(images, layers, wrong, blobs).first().reason == "layer size mismatch"
    m = spark.createDataFrame([("i", "a", "t", "b", "t")], "image string, expected_digest string, expected_type string, actual_digest string, actual_type string")
    assert apply.invariant(images, layers, layers, blobs, m).first().reason == "manifest digest mismatch"
    assert apply.invariant(images, layers, layers, blobs, m.withColumn("actual_type", F.lit("u"))).first().reason is None


def test_resolution_and_default_key(spark):
    two = spark.createDataFrame([("a", "x"), ("b", "y")], "image string, expected_digest string")
    given = spark.createDataFrame([("default", "x"), ("b", "z")], "name string, actual_digest string")
    assert {r.name: r.status for r in apply.resolve_baselines(two, given).collect()} == {"a": "missing", "b": "mismatch", "default": "unknown_name"}
    one = two.where("image = 'a'")
    got = apply.resolve_baselines(one, given.where("name = 'default'"))
    assert {r.name: r.status for r in got.collect()} == {"a": "ok"}
    assert got.where(apply.is_fatal(F.col("status"), strict=True)).count() == 0


def test_report_and_dry_run(spark, case):
    results = spark.createDataFrame([("a", 0, "ok"), ("b", 1, "skipped_preflight"), ("c", 2, "failed_compose")], "image string, position int, status string")
    r = apply.apply_report(results).first()
    assert (r.total, r.successful, r.failed, r.skipped, r.first_failed, r.run_failed) == (3, 1, 1, 1, "b", False)
    assert apply.apply_report(results.where("status <> 'ok'")).first().run_failed
    assert not apply.apply_report(results.limit(0)).first().run_failed
    plan = spark.createDataFrame([("c", 0), ("a", 1)], "image string, position int")
    assert [r.image for r in apply.apply_order(results.drop("position"), plan).orderBy("order", "image").collect()] == ["c", "a", "b"]
    d = apply.import_dry_run(*case, spark.createDataFrame([], "image string")).first()
    assert (d.layer_count, d.archive_layers, d.patch_layers, d.baseline_layers, d.would_import, d.skip_reason) == (4, 2, 1, 2, False, "no baseline provided")
