"""From images to an archive and back."""

import hashlib
import json
import random

import pytest

from stratalens import bundle
from stratalens.config import Settings
from stratalens.functions.errors import ContentError, UserError
from stratalens.operators import apply
from stratalens.sources import archives, tarfiles

FAST = Settings(level=3, candidates=2)


def image(path, layers):
    for name, data in archives.oci_image(layers).items():
        full = path / name
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data)
    return f"oci:{path}"


@pytest.fixture(scope="module")
def case(tmp_path_factory):
    """Baseline: shared, app, decoy of nearly the target's size. Target: shared, app with one file changed, new."""
    top = tmp_path_factory.mktemp("bundle")
    r = random.Random(7)
    files = [(f"f{i}", r.randbytes(9000)) for i in range(10)]
    shared = tarfiles.pack([("shared", r.randbytes(50_000))])
    app1, app2 = tarfiles.pack(files), tarfiles.pack([*files[:-1], ("f9", r.randbytes(9000))])
    decoy, new = tarfiles.pack([("d", r.randbytes(len(app2) - 2048))]), tarfiles.pack([("n", b"new\n")])
    return top, image(top / "v1", [shared, app1, decoy]), image(top / "v2", [shared, app2, new])


def test_round_trip(spark, case):
    top, v1, v2 = case
    path = bundle.diff(spark, [bundle.Pair("svc", v1, v2)], str(top / "a.tar"), FAST)
    totals, details = bundle.inspect_archive(spark, path)
    d = details.first()
    assert [x.kind for x in d.layers][:2] == ["baseline_only", "patch"] and d.layers[2].kind != "baseline_only"
    app1 = json.loads(next((top / "v1" / "blobs" / "sha256").glob(json.loads((top / "v1" / "index.json").read_text())["manifests"][0]["digest"][7:])).read_text())["layers"][1]["digest"]
    assert d.layers[1].patch_from == app1 and d.layers[1].archive_size < 15_000
    assert totals.first().patch_count >= 1 and totals.first().requires_zstd
    run = bundle.dry_run(spark, [bundle.Pair("svc", v1, v2)], FAST).first()
    assert run.shipped_blobs == 2
    for place in (f"oci:{top}/out", f"oci-archive:{top}/out.tar", f"dir:{top}/plain"):
        got = bundle.unbundle(spark, path, {"default": v1}, {"default": place})
        assert [(r.image, r.status, r.error) for r in got.collect()] == [("svc", "ok", None)]
    assert not apply.apply_report(got).first().run_failed


def test_archive_does_not_depend_on_order_of_work(spark, case):
    top, v1, v2 = case
    one, two = (bundle.diff(spark, [bundle.Pair("svc", v1, v2)], str(top / f"{n}.tar"), FAST) for n in "xy")
    assert open(one, "rb").read() == open(two, "rb").read()


def test_shared_layers_ship_whole_and_partial_runs(spark, case):
    top, v1, v2 = case
    path = bundle.diff(spark, [bundle.Pair("a", v1, v2), bundle.Pair("b", v1, v2)], str(top / "two.tar"), FAST)
    assert bundle.inspect_archive(spark, path)[0].first().patch_count == 0
    got = bundle.unbundle(spark, path, {"a": v1}, {"a": f"oci:{top}/part"}, strict=False)
    assert [(r.image, r.status) for r in got.orderBy("position").collect()] == [("a", "ok"), ("b", "skipped_preflight")]
    with pytest.raises(ContentError, match="b: missing"):
        bundle.unbundle(spark, path, {"a": v1}, {"a": f"oci:{top}/part"})
    with pytest.raises(ContentError, match="mismatch"):
        bundle.unbundle(spark, path, {"a": v2, "b": v1}, {}, strict=False)


@pytest.mark.parametrize("damage", ["missing", "truncated"])
def test_a_damaged_blob_fails_its_image_alone(spark, case, tmp_path, damage):
    """The baseline of ``b`` loses its first layer after the archive is made; ``a`` is rebuilt all the same."""
    top, v1, v2 = case
    r = random.Random(8)
    kept = tarfiles.pack([("k", r.randbytes(40_000))])
    other1, other2 = image(tmp_path / "o1", [kept]), image(tmp_path / "o2", [kept, tarfiles.pack([("n", b"other\n")])])
    path = bundle.diff(spark, [bundle.Pair("b", other1, other2), bundle.Pair("a", v1, v2)], str(tmp_path / "two.tar"), FAST)
    blob = tmp_path / "o1" / "blobs" / "sha256" / hashlib.sha256(kept).hexdigest()
    blob.unlink() if damage == "missing" else blob.write_bytes(kept[:100])
    got = bundle.unbundle(spark, path, {"a": v1, "b": other1}, {"a": f"oci:{tmp_path}/a", "b": f"oci-archive:{tmp_path}/b.tar"}, strict=False)
    found = {r.image: (r.status, r.error) for r in got.collect()}
    assert found["a"] == ("ok", None)
    assert found["b"][0] == "failed_compose" and hashlib.sha256(kept).hexdigest() in found["b"][1] and "\n" not in found["b"][1]
    assert not (tmp_path / "b.tar").exists() and not (tmp_path / "b.tar.folder").exists()


def test_memory_budget(spark, case):
    top, v1, v2 = case
    small = Settings(level=3, candidates=2, memory_budget="1KiB")
    with pytest.raises(UserError, match="memory budget is 1024"):
        bundle.diff(spark, [bundle.Pair("svc", v1, v2)], str(top / "small.tar"), small)
    path = bundle.diff(spark, [bundle.Pair("svc", v1, v2)], str(top / "large.tar"), Settings(level=3, candidates=2, memory_budget="0"))
    with pytest.raises(UserError, match="svc needs"):
        bundle.unbundle(spark, path, {"svc": v1}, {"svc": f"oci:{top}/small"}, settings=small)
    assert not (top / "small.tar").exists() and not (top / "small").exists()


def test_sizes_of_patches_are_those_of_the_trials(spark, case):
    top, v1, v2 = case
    path = bundle.diff(spark, [bundle.Pair("svc", v1, v2)], str(top / "sizes.tar"), FAST)
    written = {f"{n.split('/')[1]}:{n.split('/')[2]}": len(d) for n, d in archives.read_members(path, None) if n.startswith("blobs/")}
    blobs = bundle.open_archive(spark, path).blobs.collect()
    assert any(b.encoding == "patch" for b in blobs) and all(written[b.digest] == b.archive_size for b in blobs)


def test_off_and_refusals(spark, case):
    top, v1, v2 = case
    path = bundle.diff(spark, [bundle.Pair("svc", v1, v2)], str(top / "off.tar"), Settings(intra_layer="off"))
    assert bundle.inspect_archive(spark, path)[0].first().patch_count == 0
    for bad in ([], [bundle.Pair("!", v1, v2)], [bundle.Pair("a", v1, v2)] * 2, [bundle.Pair("a", "sif:x", v2)]):
        with pytest.raises(UserError):
            bundle.diff(spark, bad, str(top / "no.tar"), FAST)
    archives.write_archive(str(top / "old.tar"), '{"version": "v1", "feature": "single"}', spark.createDataFrame([], "digest string, content binary"))
    with pytest.raises(ContentError, match="older"):
        bundle.open_archive(spark, str(top / "old.tar"))


def test_pair_file(tmp_path):
    (tmp_path / "p.json").write_text('{"pairs": [{"name": "a", "baseline": "oci:x", "target": "dir:/y"}]}')
    assert bundle.read_pairs(str(tmp_path / "p.json")) == [bundle.Pair("a", f"oci:{tmp_path}/x", "dir:/y")]
