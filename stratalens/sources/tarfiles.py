"""Tar archives and layers, read member by member."""

from __future__ import annotations

import gzip
import hashlib
import io
import posixpath
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.errors import ContentError

# First bytes of gzip and zstd.
GZIP, ZSTD = b"\x1f\x8b", b"\x28\xb5\x2f\xfd"


def safe_name(name: str) -> str:
    """A member's path below the root; one that leaves it is an error."""
    clean = posixpath.normpath(name)
    if clean.startswith(("/", "../")) or clean == ".." or "\0" in clean:
        raise ContentError(f"entry leaves the archive: {name!r}")
    return clean


def opened(raw: io.BufferedIOBase) -> io.BufferedIOBase:
    """A stream without its outer gzip or zstd, by magic bytes."""
    head = io.BufferedReader(raw) if not isinstance(raw, io.BufferedReader) else raw
    magic = head.peek(4)[:4]
    if magic[:2] == GZIP:
        return gzip.GzipFile(fileobj=head)
    if magic == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(head)
    return head


def members(raw: io.BufferedIOBase) -> Iterator[tuple[tarfile.TarInfo, io.BufferedIOBase | None]]:
    """Entries of a tar in order, read as a stream."""
    with tarfile.open(fileobj=opened(raw), mode="r|") as tar:
        for info in tar:
            yield info, tar.extractfile(info) if info.isfile() else None


def layer_files(content: bytes) -> Iterator[tuple[str, int]]:
    """Digest and size of each distinct regular file of a layer; the first size of a digest counts."""
    seen = set()
    for info, f in members(io.BytesIO(content)):
        if not info.isreg() or f is None:
            continue
        h, n = hashlib.sha256(), 0
        while block := f.read(1 << 20):
            h.update(block)
            n += len(block)
        name = f"sha256:{h.hexdigest()}"
        if name not in seen:
            seen.add(name)
            yield name, n


def fingerprint(blobs: DataFrame) -> DataFrame:
    """(layer_digest, ok, file_digest, size) of layer blobs (digest, content).

    A blob that is no readable tar has one row with ok false, an empty layer one
    with ok true; both with null file. Links, folders and devices do not count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("digest").to_pylist(), batch.column("content"), strict=True):
                try:
                    files, ok = list(layer_files(content.as_py() or b"")), True
                except (tarfile.TarError, OSError, EOFError, ValueError, RuntimeError, ImportError):
                    files, ok = [], False
                except Exception as e:  # zstd's own error class is known only where it is installed
                    if type(e).__name__ != "ZstdError":
                        raise
                    files, ok = [], False
                rows = files or [(None, None)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows)), pa.array([ok] * len(rows)), pa.array([d for d, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], names=["layer_digest", "ok", "file_digest", "size"]
                )

    return blobs.select("digest", "content").mapInArrow(run, "layer_digest string, ok boolean, file_digest string, size long")


def pack(files: list[tuple[str, bytes]], compress: str = "") -> bytes:
    """A tar of the files, byte for byte the same for the same input; compress is "", gzip or zstd."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for name, data in files:
            info = tarfile.TarInfo(safe_name(name))
            info.size, info.mode = len(data), 0o644
            tar.addfile(info, io.BytesIO(data))
    if compress == "gzip":
        return gzip.compress(out.getvalue(), mtime=0)
    if compress == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(out.getvalue())
    return out.getvalue()
