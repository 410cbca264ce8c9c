"""Sidecar parsing and validation."""

import json

import pytest
from pyspark.sql import functions as F

from stratalens.operators import sidecar


def document(**change):
    blob = {"size": 10, "media_type": "m", "encoding": "full", "archive_size": 10}
    image = {"name": "svc", "baseline": {"manifest_digest": "sha256:b", "media_type": "m"}, "target": {"manifest_digest": "sha256:t", "manifest_size": 10, "media_type": "m"}}
    doc = {"version": "v1", "feature": "bundle", "tool": "x", "tool_version": "1", "created_at": "2024-01-01T00:00:00Z", "platform": "linux/amd64", "blobs": {"sha256:t": blob}, "images": [image]}
    for path, value in change.items():
        at, keys = doc, path.split("__")
        for k in keys[:-1]:
            at = at[int(k)] if isinstance(at, list) else at["sha256:t" if k == "T" else k]
        at[keys[-1]] = value
    return json.dumps(doc)


def rules(spark, text):
    df = spark.createDataFrame([(text,)], "json string").select(sidecar.parse(F.col("json")).alias("sidecar"))
    return sorted(r.rule for r in sidecar.violations(df).collect())


PATCH = {"blobs__T__encoding": "patch", "blobs__T__archive_size": 5, "blobs__T__codec": "zstd-patch", "blobs__T__patch_from_digest": "sha256:r"}


@pytest.mark.parametrize(
    "change, want",
    [
        ({}, []),
        (PATCH, []),
        ({"platform": ""}, ["platform_required"]),
        ({"images": []}, ["images_required"]),
        ({"images__0__name": "-bad"}, ["name_pattern"]),
        ({"images__0__target__manifest_digest": ""}, ["target_digest_required"]),
        ({"images__0__target__manifest_digest": "sha256:other"}, ["target_in_blobs"]),
        ({"images__0__baseline__manifest_digest": ""}, ["baseline_digest_required"]),
        ({"blobs__T__codec": "zstd-patch"}, ["full_sets_codec"]),
        ({"blobs__T__archive_size": 9}, ["full_size"]),
        ({"blobs__T__encoding": "other"}, ["encoding"]),
        (PATCH | {"blobs__T__codec": ""}, ["patch_codec"]),
        (PATCH | {"blobs__T__patch_from_digest": ""}, ["patch_from"]),
        (PATCH | {"blobs__T__archive_size": 0}, ["patch_size"]),
        (PATCH | {"blobs__T__archive_size": 10}, ["patch_size"]),
    ],
)
def test_rules(spark, change, want):
    assert rules(spark, document(**change)) == want


def test_missing_blobs_and_double_names(spark):
    doc = json.loads(document())
    del doc["blobs"]
    assert "blobs_required" in rules(spark, json.dumps(doc))
    doc = json.loads(document())
    doc["images"] *= 2
    assert rules(spark, json.dumps(doc)) == ["name_unique"]


def test_routes_and_unknown_fields(spark):
    texts = ["{", document(feature="other", version="v9"), document(version="v2"), document(), document(later=1, also=[])]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, json string").select("i", sidecar.route(F.col("json")).alias("r"), sidecar.unknown_fields(F.col("json")).alias("u")).orderBy("i").collect()
    assert [r.r for r in got] == ["invalid", "legacy", "unknown_version", "ok", "ok"]
    assert got[4].u == ["also", "later"] and got[3].u == []


def test_pairs_and_seeds(spark):
    pairs = spark.createDataFrame([("a", "dir:/x", "oci:/y"), ("a", "dir:/x", "sif:/y"), ("b!", "x", "dir:/y")], "name string, baseline_ref string, target_ref string")
    assert sorted((r.subject, r.rule) for r in sidecar.pair_violations(pairs).collect()) == [("a", "name_unique"), ("a", "target_ref"), ("b!", "baseline_ref"), ("b!", "name_pattern")]
    images = spark.createDataFrame([("m", 5, "t", "c", 2, "t")], "target_manifest_digest string, target_manifest_size long, target_media_type string, config_digest string, config_size long, config_media_type string")
    layers = spark.createDataFrame([("c", 2, "t", "patch", "z", "r", 1)], "digest string, size long, media_type string, encoding string, codec string, patch_from_digest string, archive_size long")
    assert {r.digest: r.encoding for r in sidecar.seed_blobs(images, layers).collect()} == {"m": "full", "c": "full"}
