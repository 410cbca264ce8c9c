"""Images and archives on disk."""

import io
import random
import tarfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratalens import config
from stratalens.functions import digests
from stratalens.functions.errors import ContentError, EnvironmentFault, UserError
from stratalens.operators import plan
from stratalens.sources import archives, images, tarfiles


@pytest.fixture(scope="module")
def versions(tmp_path_factory):
    """Two versions as oci folders and archives: a shared base and a small layer of their own."""
    top = tmp_path_factory.mktemp("images")
    shared = tarfiles.pack([("shared.bin", random.Random(42).randbytes(100_000))], "gzip")
    for v in ("v1", "v2"):
        files = archives.oci_image([shared, tarfiles.pack([("version.txt", f"{v}\n".encode())])])
        (top / f"{v}.tar").write_bytes(tarfiles.pack(sorted(files.items())))
        for name, data in files.items():
            path = top / v / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(data)
    return top


def test_layers_and_plan(spark, versions):
    archives.register(spark)
    load = lambda ref: spark.read.format("layers").load(ref).select(F.lit("p").alias("pair"), "layer_idx", "digest", "size", "media_type")
    got = plan.compute_plan(load(f"oci-archive:{versions}/v2.tar"), load(f"oci:{versions}/v1")).orderBy("layer_idx").collect()
    assert [r.part for r in got] == ["required", "shipped"]


def test_content_and_filter_reach_the_source(spark, versions):
    archives.register(spark)
    df = spark.read.format("layers").option("content", "true").load(f"oci-archive:{versions}/v1.tar")
    all_ = df.orderBy("layer_idx").collect()
    assert df.where(digests.verified(F.col("content"), F.col("digest"))).count() == 2
    assert [r.digest for r in df.where(F.col("digest") == all_[1].digest).collect()] == [all_[1].digest]


def test_fingerprints(spark):
    twice = tarfiles.pack([("a", b"same"), ("b", b"same"), ("c", b"other")])
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for kind in (tarfile.DIRTYPE, tarfile.SYMTYPE, tarfile.LNKTYPE, tarfile.FIFOTYPE):
            info = tarfile.TarInfo("x" + kind.decode())
            info.type, info.linkname = kind, "a"
            tar.addfile(info)
    rows = [("twice", twice), ("gz", tarfiles.pack([("a", b"same")], "gzip")), ("zst", tarfiles.pack([("a", b"same")], "zstd")), ("none", out.getvalue()), ("cut", tarfiles.pack([("a", random.Random(1).randbytes(5000))], "gzip")[:2000]), ("junk", b"junk")]
    got = tarfiles.fingerprint(spark.createDataFrame(rows, "digest string, content binary")).collect()
    by = {d: [(r.ok, r.file_digest is not None) for r in got if r.layer_digest == d] for d, _ in rows}
    assert by == {"twice": [(True, True)] * 2, "gz": [(True, True)], "zst": [(True, True)], "none": [(True, False)], "cut": [(False, False)], "junk": [(False, False)]}


def test_archives(spark, tmp_path):
    blobs = spark.createDataFrame([("sha256:b", b"bb"), ("sha256:a", b"aa"), ("sha256:a", b"aa")], "digest string, content binary")
    path = str(tmp_path / "delta.tar")
    archives.write_archive(path, '{"version": "v1", "feature": "bundle"}', blobs)
    assert [n for n, _ in archives.read_members(path)] == ["sidecar.json", "blobs/sha256/a", "blobs/sha256/b"]
    got = archives.extract(spark, path)
    assert got.where("digest = ''").first().sidecar.version == "v1"
    assert [bytes(r.content) for r in got.where("digest = 'sha256:b'").collect()] == [b"bb"]
    with pytest.raises(ContentError):
        list(archives.read_members(path, {"blobs/sha256/zz"}))
    with pytest.raises(EnvironmentFault):
        list(archives.read_members(str(tmp_path / "none")))


def test_refusals(spark, versions):
    archives.register(spark)
    for ref in ("sif:/x", "nothing", "oci:", "ftp:/x"):
        with pytest.raises(UserError):
            images.open_image(ref)
    with pytest.raises(EnvironmentFault):
        images.open_image("docker://h/r:t")
    with pytest.raises(ContentError):
        tarfiles.safe_name("../x")
    with pytest.raises(PySparkException):
        spark.read.format("layers").load("oci:/does/not/exist").collect()


def test_platforms():
    index = {"manifests": [{"digest": a, "platform": {"os": "linux", "architecture": a, "variant": v}} for a, v in (("amd64", None), ("arm", "v7"))]}
    assert images.select_platform(index, "linux/arm/v7")["digest"] == "arm"
    for bad in ("", "linux", "linux/s390x", "linux/arm/v8"):
        with pytest.raises(UserError):
            images.select_platform(index, bad)
    with pytest.raises(ContentError):
        images.parse_manifest(b'{"manifests": []}')
    with pytest.raises(ContentError):
        images.parse_manifest(b"{}", "text/plain")


def test_settings(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"level": 5, "workers": 2}')
    s = config.load(str(f), level=9, workers=None)
    assert (s.level, s.workers, s.candidates) == (9, 2, 3)
    f.write_text('{"nope": 1}')
    with pytest.raises(UserError):
        config.load(str(f))
    got = {r.check: r.status for r in config.doctor(spark, path=str(f)).collect()}
    assert got["config"] == "fail" and got["workdir"] == "ok"
