"""Scalar functions, codec and signatures."""

import doctest

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalens.functions import codec, errors, refs, signing, sizes
from stratalens.functions.errors import ContentError, UserError


def test_doctests():
    for module in (sizes, signing):
        assert doctest.testmod(module).failed == 0


def test_windows(spark):
    mib, gib = 1 << 20, 1 << 30
    cases = [(0, 64 * mib, 27), (0, 128 * mib, 27), (0, 128 * mib + 1, 30), (0, gib, 30), (0, gib + 1, 31), (30, 64 * mib, 30), (10, gib, 10)]
    df = spark.createDataFrame(cases, "asked int, size long, want int").withColumn("got", sizes.window_log(F.col("size"), F.col("asked")))
    assert df.where("got <> want").count() == 0
    rss = [r.r for r in spark.range(26, 33).select(sizes.window_rss(F.col("id")).alias("r")).collect()]
    assert rss == [4 * gib, 256 * mib, 512 * mib, gib, 2 * gib, 4 * gib, 4 * gib]


def test_human(spark):
    got = [r.h for r in spark.createDataFrame([(0,), (1023,), (1024,), (1280,), (1792,), (5 << 20,), (3 << 30,)], "n long").select(sizes.human(F.col("n")).alias("h")).collect()]
    assert got == ["0 B", "1023 B", "1.0 KiB", "1.2 KiB", "1.8 KiB", "5.0 MiB", "3.0 GiB"]


@pytest.mark.parametrize("bad", ["", "-1", "1.5GiB", "12XB", "GiB"])
def test_bad_budgets(bad):
    with pytest.raises(ValueError):
        sizes.parse_budget(bad)


def test_references(spark):
    cases = [
        ("docker://h/r:t", "docker", "ok", "h/r:t"), ("oci:/a/b:v1", "oci", "ok", "b:v1"), ("dir:/a/b/", "dir", "ok", "b"), ("docker-archive:x.tar", "docker-archive", "ok", "x.tar"),
        ("oci:", "oci", "empty_path", "."), ("x", "", "missing_transport", "x"), (":x", "", "missing_transport", ":x"), ("sif:/a", "sif", "reserved_transport", "sif:/a"), ("ftp:/a", "ftp", "unsupported_transport", "ftp:/a"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "r string").select("r", refs.transport(F.col("r")), refs.ref_status(F.col("r")), refs.source_hint(F.col("r")))
    assert [tuple(r) for r in df.collect()] == cases


def test_errors(spark):
    cases = [("unauthorized: manifest not found", False, "auth", False), ("x not found", False, "missing", False), ("Schema Version", False, "invalid", False), ("boom", True, "network", True), ("503 Service Unavailable", False, "other", True), (None, False, "other", False)]
    df = spark.createDataFrame([c[:2] for c in cases], "m string, n boolean").select("m", "n", errors.registry_class(F.col("m"), F.col("n")), errors.retryable(F.col("m"), F.col("n")))
    assert [tuple(r) for r in df.collect()] == cases
    assert (UserError().exit_code, ContentError().exit_code) == (2, 4)


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=3000), st.binary(max_size=3000), st.sampled_from([1, 3, 19]))
def test_patch_round_trip(reference, target, level):
    assert codec.decode(reference, codec.encode(reference, target, level)) == target
    assert codec.decode(None, codec.encode(None, target, level)) == target


def test_near_reference_beats_others():
    import random

    a, b = random.Random(1).randbytes(200_000), random.Random(2).randbytes(200_000)
    near = bytearray(a)
    near[0] ^= 1
    assert len(codec.encode(bytes(near), a)) < 1000 < len(codec.encode(b, a))
    assert codec.encode(a, b"") == codec.EMPTY_FRAME and codec.resolve_mode("off") == "off"


def test_canonical_json():
    assert signing.canonical_bytes(b'{"b": [1.0, 1e30, "\\u00e9\\n"], "a": {"\\ud83d\\ude00": null, "\\ufb33": true}}') == '{"a":{"😀":null,"דּ":true},"b":[1,1e+30,"é\\n"]}'.encode()
    with pytest.raises(ContentError):
        signing.canonical_bytes(b"{")


@settings(max_examples=100, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_keep_their_value(x):
    assert float(signing.number(x)) == x


def test_signatures(spark, tmp_path):
    private, public = signing.new_key(spark)
    digest = signing.payload_digest(b'{"a": 1}')
    assert digest == signing.payload_digest(b'{ "a" : 1.0 }')
    signature = signing.sign(spark, digest, private)
    archive = str(tmp_path / "x.tar")
    signing.write_signature(archive, signature)
    assert signing.verify(spark, digest, signing.read_signature(archive), public)
    assert not signing.verify(spark, bytes(32), signature, public)
    assert not signing.verify(spark, digest, b"junk", public)
    with pytest.raises(UserError):
        signing.sign(spark, digest, "no key")


def test_packed_contents_give_the_same_patches(spark):
    """Contents packed for the way or not, with an empty one; both sides of a pair read one column."""
    rows = [("a", b"one line\n" * 50), ("b", b"one line\n" * 49 + b"another"), ("c", b"")]
    plain = spark.createDataFrame(rows, "digest string, content binary")
    pairs = spark.createDataFrame([("p", t, c, 1) for t in "abc" for c in "abc"], "pair string, target_digest string, candidate_digest string, rank int")
    packed = codec.packed(plain)
    assert packed.columns == ["digest", "packed"]
    got = [sorted(map(tuple, codec.trial_sizes(pairs, x).collect())) for x in (plain, packed)]
    assert got[0] == got[1] and len(got[0]) == 9
    back = codec.decode_patches(codec.encode_patches(pairs, packed), packed).collect()
    assert len(back) == 9 and all(bytes(r.content) == dict(rows)[r.target_digest] for r in back)
