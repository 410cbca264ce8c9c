"""WARC round trips."""

import base64
import gzip
import hashlib

import pytest

from stratalens.llm import queries, warc

ROWS = [(1, "http://a/b?x", "<p>é\r\n\r\nWARC/1.1"), (2, None, "<p>é\r\n\r\nWARC/1.1"), (3, "u\r\nx", None), (4, "", ""), (4, "", ""), (None, "z", "q"), (9, "http://h", "x" * 300_000)]


@pytest.fixture(scope="module")
def captures(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, payload string")
    return warc.round_trip(df).collect()


def test_payloads_come_back(captures):
    assert len(captures) == len(ROWS)
    held = sorted(bytes(r.payload) for r in captures if r.warc_type == "response")
    assert held == sorted({(h or "").encode() for _, _, h in ROWS})
    for r in captures:
        if r.warc_type == "response":
            assert r.payload_digest == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
            assert r.http_length == len(r.payload) and r.original is None


def test_revisits_refer_to_the_largest_id(captures):
    got = sorted((r.metadata.fields["source-id"], r.original.source_id) for r in captures if r.warc_type == "revisit")
    assert got == [("1", 2), ("3", 4), ("4", 4)]


def test_transactions_are_nested(captures):
    assert all(r.request.record_id and r.metadata.fields["payload-bytes"] == str(r.http_length) for r in captures)
    assert len({r.record_id for r in captures} | {r.request.record_id for r in captures}) == 2 * len(ROWS)
    assert {r.target_uri for r in captures} >= {"u%0D%0Ax", "http://a/b?x"}


def test_files_are_plain_warc(spark, tmp_path):
    df = spark.createDataFrame(ROWS[:2], "page_id long, url string, html string")
    warc.write_warc(df, f"file://{tmp_path}/w")
    files = sorted((tmp_path / "w" / "captures").glob("part-*"))
    records = [x for f in files for x in warc.parse_warc(gzip.decompress(f.read_bytes()))]
    assert sorted(x["warc_type"] for x in records) == ["response", "revisit"]
    assert warc.inflate(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab" and warc.inflate(b"plain") == b"plain"


def test_damage_is_noticed():
    ok = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: 19\r\n\r\nHTTP/1.1 200\r\n\r\nabc\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        list(warc.parse_warc(ok))
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_warc(ok[:-9]))
    with pytest.raises(ValueError, match="no WARC"):
        list(warc.parse_warc(b"junk"))
    assert list(warc.parse_warc(b"")) == []


def test_least_bytes_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = warc.round_trip(df, least=3).collect()
    assert sorted((r.metadata.fields["source-id"], r.warc_type) for r in got) == [("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response")]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_query_against_sql(spark, smallest):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{smallest}/pages.parquet'")
    want = sorted(map(str, c.execute(queries.OP5_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in queries.op5_warc(spark, smallest).collect()) == want
