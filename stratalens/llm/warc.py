"""WARC: writing transactions, reading archives, assembling captures."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, row_id, shared_dir

CRLF = "\r\n"
#: Digits of radix 32 and of base 32.
RADIX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A profile of WARC 1.1 for records that repeat an earlier payload.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, warc_date string, "
    "payload_digest string, http_length long, fields map<string, string>, payload binary"
)


def base32_sha1(data: Column) -> Column:
    """Upper-case base-32 SHA-1: 20 bits, which are 5 hex digits, give 4 letters."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), RADIX, BASE32)


def record_uri(kind: str, *cols: Column) -> Column:
    """A urn:uuid from the kind and the columns: the same again on a retry."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("\x1e")) for c in cols]))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), *[x for i, n in ((9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.lit("-"), F.substring(h, i, n))], F.lit(">"))


def header(name: str, value: Column) -> Column:
    """A named field with its line end; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def one_line(col: Column) -> Column:
    """Line ends in a field value, percent-encoded."""
    return F.replace(F.replace(col, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record(kind: Column, block: Column, content_type: str, *fields: tuple[str, Column]) -> Column:
    """A record without the two line ends that close it; the writer adds them."""
    head = [header("WARC-Type", kind), *[header(n, v) for n, v in fields], header("Content-Type", F.lit(content_type)), header("Content-Length", F.octet_length(block).cast("string"))]
    return F.concat(F.lit("WARC/1.1" + CRLF), *head, F.lit(CRLF), block)


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2000-01-01T00:00:00Z", least: int = 0, per_file: int = 1000) -> None:
    """Write a request, a response or revisit, and a metadata record for every row.

    Responses and revisits go to ``path``/captures, the others to ``path``/notes,
    as gzip-compressed WARC files of ``per_file`` rows at most, through Spark's
    text writer: a record is a row and the line separator is the record's end. Of
    rows with equal payloads of ``least`` bytes or more, the one of largest id is
    the response (rows tied on it: the last of the scan) and the others revisit
    it. Null html is an empty payload. Only digests and ids of repeated payloads
    are joined back, so a payload of any number of copies is one row of that side.
    """
    rows = df.select(
        row_id().alias("row"),
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("key", F.unhex(F.concat(F.sha1(F.col("html").cast("binary")), F.md5(F.col("html").cast("binary"))))).withColumn("n", F.octet_length("html").cast("long"))
    best = F.max(F.struct(F.col("id").isNotNull(), "id", "row")).alias("best")
    repeated = rows.where(F.col("n") >= least).groupBy("key").agg(best, F.count("*").alias("copies")).where("copies > 1")
    # written out, its size is known: a small side is broadcast, a large one meets rows that can be split by key
    repeated = materialize(repeated.select(F.col("key").alias("copied"), F.col("best.id").alias("first_id"), F.col("best.row").alias("first_row")), "warc-repeated", gathered=True)
    joined = rows.join(repeated, (F.col("key") == F.col("copied")) & (F.col("n") >= least), "left")
    again = F.col("first_row").isNotNull() & (F.col("first_row") != F.col("row"))
    name = record_uri("capture", F.col("id"), F.col("row"))
    uri, when = one_line(F.col("url")), F.lit(date)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    capture = record(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html"))),
        "application/http; msgtype=response",
        ("WARC-Record-ID", name),
        ("WARC-Date", when),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("html").cast("binary")))),
        ("WARC-Profile", F.when(again, F.lit(REVISIT))),
        ("WARC-Refers-To", F.when(again, record_uri("capture", F.col("first_id"), F.col("first_row")))),
    )
    common = (("WARC-Date", when), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", name))
    path_of = F.coalesce(F.nullif(F.regexp_extract(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    request = record(F.lit("request"), F.concat(F.lit("GET "), path_of, F.lit(f" HTTP/1.1{CRLF}{CRLF}")), "application/http; msgtype=request", ("WARC-Record-ID", record_uri("request", F.col("id"), F.col("row"))), *common)
    note = record(F.lit("metadata"), F.concat(header("source-id", F.col("id").cast("string")), header("payload-bytes", F.col("n").cast("string"))), "application/warc-fields", ("WARC-Record-ID", record_uri("metadata", F.col("id"), F.col("row"))), *common)

    def save(records: DataFrame, to: str) -> None:
        records.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(f"{path}/{to}")

    save(joined.select(capture.alias("value")), "captures")
    save(rows.select(F.explode(F.array(request, note)).alias("value")), "notes")


def inflate(data: bytes) -> bytes:
    """A file's content, whether plain or in one or many gzip members."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data:
        unpack = zlib.decompressobj(31)
        parts.append(unpack.decompress(data) + unpack.flush())
        data = unpack.unused_data.lstrip(b"\0")
    return b"".join(parts)


def parse_fields(block: bytes) -> dict[str, str]:
    """Named fields, one a line, by lower-cased name."""
    found = {}
    for line in block.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return found


def parse_warc(data: bytes) -> Iterator[dict]:
    """The records of an archive, by their content lengths; a digest that does not fit its payload is an error."""
    at = 0
    while (at := _skip_ends(data, at)) < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        body = data.index(b"\r\n\r\n", at) + 4
        head = parse_fields(data[at:body])
        end = body + int(head["content-length"])
        if end > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        block, at = data[body:end], end
        kind, fields, payload, length = head.get("warc-type", ""), {}, None, None
        if head.get("content-type", "").startswith("application/http"):
            top, _, rest = block.partition(b"\r\n\r\n")
            fields = parse_fields(top.partition(b"\r\n")[2])
            length = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else None
            payload = rest if kind == "response" else None
        elif kind == "metadata":
            fields = parse_fields(block)
        digest = head.get("warc-payload-digest")
        if payload is not None and digest and digest.startswith("sha1:") and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest[5:]:
            raise ValueError(f"payload of {head.get('warc-record-id')} does not fit its digest")
        yield {
            "warc_type": kind,
            "record_id": head.get("warc-record-id"),
            "concurrent_to": head.get("warc-concurrent-to"),
            "refers_to": head.get("warc-refers-to"),
            "target_uri": head.get("warc-target-uri"),
            "warc_date": head.get("warc-date"),
            "payload_digest": digest,
            "http_length": length,
            "fields": list(fields.items()),
            "payload": payload,
        }


def _skip_ends(data: bytes, at: int) -> int:
    while data[at : at + 2] == b"\r\n":
        at += 2
    return at


SCHEMA = pa.schema(
    [(n, pa.string()) for n in ("warc_type", "record_id", "concurrent_to", "refers_to", "target_uri", "warc_date", "payload_digest")]
    + [("http_length", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


def read_warc(spark: SparkSession, path: str, most_bytes: int = 4 << 20) -> DataFrame:
    """All records of the archives in a folder of any store: see ``RECORD``.

    A file is read whole, records leave it in slices of about ``most_bytes`` of
    payload. Record types other than those written here come out too, with what
    of the columns they have. A missing folder is an error; one without files is
    an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for row in parse_warc(inflate(content.as_py())):
                    held.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size >= most_bytes:
                        yield pa.RecordBatch.from_pylist(held, SCHEMA)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, SCHEMA)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(captures: DataFrame, notes: DataFrame) -> DataFrame:
    """One nested row per capture: its record, with request and metadata joined through concurrent-to.

    ``captures`` and ``notes`` are frames of records, which may be the same frame.
    Request and metadata records are first reduced to one row per capture they
    name (of several of a kind, that of smallest record id counts), so the join
    adds no rows. Captures without them have nulls there; notes that name no
    capture are left out. Revisits get ``original``: address and source id of the
    capture they refer to, as its notes have them, null if there are none. Only
    revisits, which carry no payload, take part in that join.
    """
    side = notes.where(F.col("warc_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())

    def of(kind: str) -> Column:
        held = F.struct("record_id", "target_uri", F.map_entries("fields").alias("fields"))
        return F.min(F.when(F.col("warc_type") == kind, held)).alias(kind)

    side = materialize(side.groupBy(F.col("concurrent_to").alias("capture")).agg(of("request"), of("metadata")), "warc-notes", gathered=True)
    fields = F.map_from_entries(F.col("metadata.fields"))
    request = F.when(F.col("request").isNotNull(), F.struct(F.col("request.record_id").alias("record_id"), F.col("request.target_uri").alias("target_uri")))
    metadata = F.when(F.col("metadata").isNotNull(), F.struct(F.col("metadata.record_id").alias("record_id"), fields.alias("fields")))
    side = side.select("capture", request.alias("request"), metadata.alias("metadata"))
    original = F.struct(F.coalesce("request.target_uri", F.lit(None)).alias("target_uri"), F.element_at("metadata.fields", "source-id").cast("long").alias("source_id"))
    referred = side.select(F.col("capture").alias("original_id"), original.alias("original"))

    def nested(kind: str) -> DataFrame:
        own = captures.where(F.col("warc_type") == kind).drop("concurrent_to")
        return own.join(side, own["record_id"] == side["capture"], "left").drop("capture")

    responses, revisits = nested("response"), nested("revisit")
    revisits = revisits.join(referred, F.col("refers_to") == F.col("original_id"), "left").drop("original_id")
    return responses.unionByName(revisits, allowMissingColumns=True)


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write ``df`` as archives in the shared folder, read them back and assemble the captures."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(df, path, id_col, url_col, html_col, least=least)
    return assemble(read_warc(spark, f"{path}/captures"), read_warc(spark, f"{path}/notes"))
