"""Inspection on small cases."""

import json

from stratalens.operators import inspect

MIB = 1 << 20


def frames(spark, layers, blobs):
    return (
        spark.createDataFrame([("i", k, d, n) for k, (d, n) in enumerate(layers)], "image string, layer_idx int, digest string, size long"),
        spark.createDataFrame(blobs, "digest string, size long, encoding string, patch_from_digest string, archive_size long"),
    )


def test_rows(spark):
    got = inspect.layer_rows(*frames(spark, [("f", 100), ("p", 200), ("b", 300), ("z", 0)], [("f", 100, "full", None, 100), ("p", 200, "patch", "r", 50), ("z", 0, "full", None, 0)])).orderBy("layer_idx").collect()
    assert [(r.kind, r.saved_bytes, r.saved_ratio, r.ratio) for r in got] == [("full", 0, 0.0, 1.0), ("patch", 150, 0.75, 0.25), ("baseline_only", 300, 1.0, 0.0), ("full", 0, 0.0, 0.0)]
    assert [r.patch_from for r in got] == [None, "r", None, None]


def test_waste_top_savings_and_limits(spark):
    rows = inspect.layer_rows(*frames(spark, [(f"d{i:02}", 100 + i) for i in range(15)], [(f"d{i:02}", 100 + i, "patch", "r", 100) for i in range(15)]))
    top = inspect.top_savings(rows).orderBy("rank").collect()
    assert [r.saved_bytes for r in top] == list(range(14, 4, -1))
    assert inspect.waste(rows).select("digest").collect()[0].digest == "d00"
    ties = inspect.layer_rows(*frames(spark, [("zzz", 9), ("aaa", 9), ("mmm", 9), ("aaa", 9)], []))
    assert [r.digest for r in inspect.top_savings(ties).orderBy("rank").collect()] == ["aaa", "aaa", "mmm", "zzz"]


def test_histogram(spark):
    sizes = [0, MIB - 1, MIB, 10 * MIB, 100 * MIB - 1, 100 * MIB, 1024 * MIB]
    got = inspect.histogram(spark.createDataFrame([("i", n) for n in sizes], "image string, target_size long"))
    assert [r.layers for r in got.orderBy("bucket_idx").collect()] == [2, 1, 2, 1, 1]


def test_totals_of_nothing(spark):
    r = inspect.totals(frames(spark, [], [])[1]).first()
    assert (r.blobs, r.total_archive, r.patch_ratio, r.requires_zstd) == (0, 0, None, False)


def test_details_and_envelope(spark):
    rows = inspect.layer_rows(*frames(spark, [("a", 12 * MIB), ("b", 8 * MIB), ("c", 5 * MIB)], [("a", 12 * MIB, "full", None, 12 * MIB), ("b", 8 * MIB, "patch", "r", MIB)]))
    d = inspect.image_details(rows)
    r = d.first()
    assert (r.layer_count, r.archive_layer_count, [h.layers for h in r.histogram]) == (3, 2, [0, 2, 1, 0, 0])
    doc = json.loads(inspect.envelope(d).first().json)
    assert doc["schema_version"] == 1 and len(doc["data"]["layers"]) == 3
    assert "8.0 MiB -> 1.0 MiB (0.13x" in inspect.rendered(rows).where("layer_idx = 1").first().line
