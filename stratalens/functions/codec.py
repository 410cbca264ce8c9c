"""Patches of one blob against another, and blobs compressed whole, by zstd.

A patch is a zstd frame whose dictionary is the reference's raw content, so the
zstd program reads it with ``--patch-from`` and this code reads the program's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sizes

#: Fixed value: the frame of an empty blob.
EMPTY_FRAME = bytes.fromhex("28b52ffd2000010000")


def available() -> tuple[bool, str]:
    """Whether the codec can be used here, and its version or what is missing."""
    try:
        import zstandard
    except ImportError as e:
        return False, str(e)
    return True, zstandard.__version__


def resolve_mode(asked: str) -> str:
    """auto, off or required to auto or off: auto without a codec is off, required without one an error."""
    from .errors import EnvironmentFault, UserError

    ok, why = available()
    if asked not in ("auto", "off", "required"):
        raise UserError(f"unknown mode {asked!r}")
    if asked == "required" and not ok:
        raise EnvironmentFault(f"patches are required, but the codec is missing: {why}")
    return "auto" if asked != "off" and ok else "off"


def fit_window(asked: int, *blobs: bytes) -> int:
    """A window that spans reference and target, within what the codec allows."""
    import zstandard

    need = max(sum(map(len, blobs)), 1).bit_length()
    return min(max(asked if asked else zstandard.WINDOWLOG_MIN, need, zstandard.WINDOWLOG_MIN), zstandard.WINDOWLOG_MAX)


def encode(reference: bytes | None, target: bytes, level: int = sizes.DEFAULT_LEVEL, window: int = 0) -> bytes:
    """The target as a frame that needs the reference; without one, compressed whole."""
    import zstandard

    if not target:
        return EMPTY_FRAME
    level = level or sizes.DEFAULT_LEVEL
    params = zstandard.ZstdCompressionParameters.from_level(level, window_log=fit_window(window, reference or b"", target), enable_ldm=True)
    if reference:
        held = zstandard.ZstdCompressionDict(reference, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(compression_params=params, dict_data=held).compress(target)
    return zstandard.ZstdCompressor(compression_params=params).compress(target)


def decode(reference: bytes | None, frame: bytes) -> bytes:
    """The target of a frame; a frame that does not fit raises an error."""
    import zstandard

    if frame == EMPTY_FRAME:
        return b""
    held = zstandard.ZstdCompressionDict(reference, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if reference else None
    reader = zstandard.ZstdDecompressor(dict_data=held, max_window_size=1 << 31) if held else zstandard.ZstdDecompressor(max_window_size=1 << 31)
    return reader.decompressobj().decompress(frame)


def packed(contents: DataFrame) -> DataFrame:
    """(digest, packed) of (digest, content): contents compressed for the way, with their lengths, in one column so that both sides of a pair read one exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shrink = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            found = batch.column("content").to_pylist()
            out = [None if x is None else {"data": shrink(x), "bytes": len(x)} for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.struct([("data", pa.binary()), ("bytes", pa.int64())]))], names=["digest", "packed"])

    return contents.select("digest", "content").mapInArrow(run, "digest string, packed struct<data: binary, bytes: long>")


def _unpacked(column: pa.Array) -> list[bytes | None]:
    import zstandard

    grow = zstandard.ZstdDecompressor().decompress
    return [None if x is None else grow(x) for x in column.to_pylist()]


def _with_bytes(pairs: DataFrame, contents: DataFrame, window: int) -> DataFrame:
    """``pairs`` with packed contents and the target's window; ``contents`` as (digest, content) or :func:`packed`."""
    held = contents if "packed" in contents.columns else packed(contents)
    t = held.select(F.col("digest").alias("target_digest"), F.col("packed.data").alias("_target"), sizes.window_log(F.col("packed.bytes"), window).alias("_log"))
    c = held.select(F.col("digest").alias("candidate_digest"), F.col("packed.data").alias("_reference"))
    return pairs.join(c, "candidate_digest").join(t, "target_digest")  # so that a target's rows end side by side


def trial_sizes(candidates: DataFrame, contents: DataFrame, level: int = sizes.DEFAULT_LEVEL, window: int = 0) -> DataFrame:
    """``candidates`` with ``cost``, the patch's bytes, and ``ceiling``, those of the target compressed whole.

    Windows are those of :func:`encode_patches`, so ``cost`` is what it will write.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            target, reference, log = _unpacked(batch.column("_target")), _unpacked(batch.column("_reference")), batch.column("_log").to_pylist()
            cost = [len(encode(r, t, level, w)) for t, r, w in zip(target, reference, log, strict=True)]
            names = batch.column("target_digest").to_pylist()
            once = {n: (t, w) for n, t, w in zip(names, target, log, strict=True)}
            once = {n: len(encode(None, t, level, w)) for n, (t, w) in once.items()}
            whole = [once[n] for n in names]
            kept = [batch.column(c) for c in ("pair", "target_digest", "candidate_digest", "rank")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(cost, pa.int64()), pa.array(whole, pa.int64())], names=["pair", "target_digest", "candidate_digest", "rank", "cost", "ceiling"])

    full = _with_bytes(candidates, contents, window)
    return full.select("pair", "target_digest", "candidate_digest", "rank", "_target", "_reference", "_log").mapInArrow(run, "pair string, target_digest string, candidate_digest string, rank int, cost long, ceiling long")


def encode_patches(pairs: DataFrame, contents: DataFrame, level: int = sizes.DEFAULT_LEVEL, window: int = 0) -> DataFrame:
    """(pair, target_digest, candidate_digest, patch, patch_size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            target, reference, log = _unpacked(batch.column("_target")), _unpacked(batch.column("_reference")), batch.column("_log").to_pylist()
            patches = [encode(r, t, level, w) for t, r, w in zip(target, reference, log, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pair", "target_digest", "candidate_digest")), pa.array(patches, pa.binary())], names=["pair", "target_digest", "candidate_digest", "patch"])

    full = _with_bytes(pairs, contents, window).select("pair", "target_digest", "candidate_digest", "_target", "_reference", "_log")
    return full.mapInArrow(run, "pair string, target_digest string, candidate_digest string, patch binary").withColumn("patch_size", F.octet_length("patch").cast("long"))


def decode_patches(patches: DataFrame, contents: DataFrame) -> DataFrame:
    """``patches`` with ``content`` rebuilt from each reference; null where a frame cannot be decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            out = []
            for patch, reference in zip(batch.column("patch").to_pylist(), _unpacked(batch.column("_reference")), strict=True):
                try:
                    out.append(decode(reference, patch))
                except zstandard.ZstdError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pair", "target_digest", "candidate_digest", "patch_size")), pa.array(out, pa.binary())], names=["pair", "target_digest", "candidate_digest", "patch_size", "content"])

    held = contents if "packed" in contents.columns else packed(contents)
    c = held.select(F.col("digest").alias("candidate_digest"), F.col("packed.data").alias("_reference"))
    full = patches.join(c, "candidate_digest").select("pair", "target_digest", "candidate_digest", "patch", "patch_size", "_reference")
    return full.mapInArrow(run, "pair string, target_digest string, candidate_digest string, patch_size long, content binary")
