"""Near-duplicates by BagMinHash signatures of word shingles, banded and verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import condensed, dealt_anew, fresh, give_back, materialize, numbered, row_id, slices, small_batches
from .graph import components

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))
#: Bits of the filter that tells which texts are read again: sixteen a wanted text, within these bounds (128 KB and 32 MB).
FILTER_BITS = 1 << 20, 1 << 28


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from scrambled bits."""
    return ((mixed(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()


def bags(texts: list[str | None], width: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[bytes | None]]:
    """Of each text the multiset of its word shingles (sorted 64-bit hashes, counts), and a key of its word sequence.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. A
    text of fewer than ``width`` words is one shingle; one without words has none,
    and no key.
    """
    if len(HASHES) > 200_000:
        HASHES.clear()
    words = [t.encode().lower().split() if t else [] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.fromiter(map(HASHES.__getitem__, (w for ws in words for w in ws)), np.uint64, int(sizes.sum()))
    keys = [hashlib.md5(b" ".join(ws)).digest() if ws else None for ws in words]
    found, end = [], 0
    with np.errstate(over="ignore"):
        rolled = flat.copy()
        for _ in range(width - 1):
            flat = flat[1:]
            rolled = rolled[: len(flat)] * _MIX[2] + flat
        rolled = mixed(rolled)
        start = 0
        for ws, n in zip(words, sizes.tolist(), strict=True):
            end = start + n
            if n >= width:
                found.append(np.unique(rolled[start : end - width + 1], return_counts=True))
            elif n:
                found.append((np.array([xxhash.xxh3_64_intdigest(b" ".join(ws))], np.uint64), np.ones(1, np.int64)))
            else:
                found.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            start = end
    return found, keys


def bag_min_hash(many: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """BagMinHash signatures: equal components of two bags are as frequent as their weighted Jaccard similarity.

    The weight axis is cut into dyadic intervals [0,1), [1,2), [2,4), [4,8) ... For
    every shingle and interval below its count (one level of the hierarchy: an
    interval is not split again), a Poisson process of rate ``size`` times the
    interval's width yields points in order of time; a point has a place on the
    weight axis, which counts if it lies below the shingle's count, and
    falls on a random component, which keeps its earliest point. Seeds depend on
    shingle and interval alone, so bags share the points of the weight they share.
    A process stops when its next point is later than the latest component, which
    after the first points ends nearly all of them.
    """
    docs = len(many)
    doc = np.repeat(np.arange(docs), [len(h) for h, _ in many])
    h, w = (np.concatenate([x[i] for x in many]) for i in (0, 1))
    earliest = np.full(docs * size, np.inf)
    with np.errstate(over="ignore"):
        levels = np.ceil(np.log2(np.maximum(w, 1))).astype(np.int64) + 1
        node = np.concatenate([np.arange(n) for n in levels[levels > 1]]) if (levels > 1).any() else np.zeros(0, np.int64)
        one, more = levels == 1, levels > 1
        doc = np.r_[doc[one], np.repeat(doc[more], levels[more])]
        seed = np.r_[h[one], np.repeat(h[more], levels[more])]
        count = np.r_[w[one], np.repeat(w[more], levels[more])].astype(np.float64)
        node = np.r_[np.zeros(int(one.sum()), np.int64), node]
        low = np.where(node > 0, 2.0 ** (node - 1), 0.0)
        width = np.maximum(low, 1.0)
        seed = mixed(seed + (node.astype(np.uint64) + np.uint64(1)) * _MIX[2])
        part = low + width > count  # some of its points lie above the count
        rate = size * width
        time = np.zeros(len(seed))
        latest = np.full(docs, np.inf)
        step = np.uint64(0)
        while len(seed):
            time = time - np.log(uniform(seed + (step + np.uint64(1)) * _MIX[2])) / rate
            live = time < latest[doc]
            if not live.all():
                doc, seed, count, low, width, part, rate, time = (x[live] for x in (doc, seed, count, low, width, part, rate, time))
                if not len(seed):
                    break
            at = doc * size + (mixed(seed + (step + np.uint64(2)) * _MIX[2]) % np.uint64(size)).astype(np.int64)
            inside = np.ones(len(seed), bool)
            if part.any():
                inside[part] = (low + width * uniform(seed + (step + np.uint64(3)) * _MIX[2]))[part] < count[part]
            np.minimum.at(earliest, at[inside], time[inside])
            active = np.unique(doc) if len(doc) < docs else np.arange(docs)
            latest[active] = earliest.reshape(docs, size)[active].max(axis=1)
            step += np.uint64(3)
    return earliest.reshape(docs, size)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of ``rows`` components."""
    bits = np.ascontiguousarray(signatures).view(np.uint64).reshape(len(signatures), -1, rows)
    key = np.arange(1, bits.shape[1] + 1, dtype=np.uint64)[None, :].repeat(len(signatures), 0)
    with np.errstate(over="ignore"):
        for i in range(rows):
            key = mixed(key * _MIX[2] + bits[:, :, i])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Shared over united weight of two bags."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    hit = a[0][at] == b[0]
    both = np.minimum(a[1][at[hit]], b[1][hit]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def unpack(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.int32).astype(np.int64)


def filter_bits(wanted: int) -> int:
    """A power of two of about sixteen bits a wanted row, within bounds."""
    return min(max(1 << (16 * max(wanted, 1) - 1).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])


def reread(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(row, hashes, counts, size) of the texts whose row is in ``wanted``, a written table.

    A bit filter, built from the wanted rows' hashes, is tested while the texts are
    scanned, so that few others are hashed and shuffled; what it lets pass by chance
    (one row in sixteen, or more beyond 2^24 wanted rows) is dropped by a join.
    ``size`` is that of the bag in bytes.
    """
    n = filter_bits(wanted.count())
    slot = F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(n)) + 1  # bitmap buckets count from 1
    bits = np.zeros(n // 8, np.uint8)
    maps = wanted.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    for r in maps.toLocalIterator():  # 4 KB for each stretch of the filter, at most
        bits[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.m, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.column("slot").to_numpy() - 1
            hit = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            for batch in slices([whole.filter(pa.array(hit.astype(bool)))], "text"):
                found, _ = bags(batch.column("text").to_pylist(), width)
                arrays = [batch.column("row"), pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary()), pa.array([12 * len(h) for h, _ in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "hashes", "counts", "size"])
        HASHES.clear()
        give_back()

    return docs.select("row", "text", slot.alias("slot")).mapInArrow(run, "row long, hashes binary, counts binary, size long").join(wanted, "row", "left_semi")


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose bags overlap by ``least`` or more, exactly."""
    left = pairs.join(texts.select(F.col("row").alias("u"), F.col("hashes").alias("uh"), F.col("counts").alias("uc")), "u")
    both = left.join(texts.select(F.col("row").alias("v"), F.col("hashes").alias("vh"), F.col("counts").alias("vc")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "uh"):
            cols = [batch.column(c).to_pylist() for c in ("uh", "uc", "vh", "vc")]
            ok = [similarity(unpack(a, b), unpack(c, d)) >= least for a, b, c, d in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.select("u", "v", "uh", "uc", "vh", "vc").mapInArrow(run, "u long, v long")


def link_cells(members: DataFrame, texts: DataFrame, least: float, chunk: int) -> DataFrame:
    """Links among members (bucket, row, part) of buckets that one centre did not settle.

    The rows of a bucket are dealt into chunks of about ``chunk`` bytes of bags: a
    part that fills a chunk has chunks of its own, smaller parts stay whole and share.
    A task gets two chunks, or one, and compares rows of different parts until they
    are linked, pairs of different chunks where there are two. Every two chunks meet
    but those of one part, so no link between parts is lost, rows beside a part of
    any size make it come out once for each of their chunks, and a task's memory is
    that of two chunks.
    """
    sized = members.join(texts.select("row", "size"), "row")
    parts = sized.groupBy("bucket", "part").agg(F.least(F.ceil(F.sum("size") / chunk).cast("long"), F.count("*")).alias("n"), F.sum("size").alias("bytes"))
    shared = parts.where("n = 1").groupBy("bucket").agg(F.least(F.ceil(F.sum("bytes") / chunk).cast("long"), F.count("*")).alias("m"))
    parts = materialize(parts.join(shared, "bucket", "left").select("bucket", "part", F.when(F.col("n") > 1, F.col("part")).otherwise(-1).alias("own"), F.when(F.col("n") > 1, F.col("n")).otherwise(F.col("m")).alias("n")), "near-parts", gathered=True)
    place = F.pmod(F.when(F.col("own") >= 0, F.xxhash64("row")).otherwise(F.xxhash64("part")), F.col("n"))
    dealt = sized.join(parts, ["bucket", "part"]).select("bucket", "row", "part", F.struct("own", place.alias("i")).alias("chunk"))
    chunks = parts.select("bucket", "own", "n").distinct().select("bucket", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("bucket", F.struct("own", "i").alias("chunk"))
    chunks = materialize(chunks, "near-chunks", gathered=True)
    met = chunks.withColumnRenamed("chunk", "a").join(chunks.withColumnRenamed("chunk", "b"), "bucket").where("a <= b and (a.own <> b.own or a.own < 0)")
    cells = met.select("bucket", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("chunk"))
    full = cells.join(dealt, ["bucket", "chunk"]).join(texts.select("row", "hashes", "counts"), "row")
    full = full.select("bucket", F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"), (F.col("chunk") == F.col("a")).alias("left"), (F.col("a") == F.col("b")).alias("within"), "row", "part", "hashes", "counts")

    def run(table: pa.Table) -> pa.Table:
        rows, parts, left, within = (table.column(c).to_pylist() for c in ("row", "part", "left", "within"))
        held = [unpack(h, c) for h, c in zip(table.column("hashes").to_pylist(), table.column("counts").to_pylist(), strict=True)]
        weights = [int(c.sum()) for _, c in held]
        root = {p: p for p in parts}

        def top(p: int) -> int:
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        sides = [i for i, x in enumerate(left) if x], [i for i, x in enumerate(left) if not x]
        links = []
        for x, y in combinations(sides[0], 2) if within[0] else product(*sides):
            p, q = top(parts[x]), top(parts[y])
            if p != q and min(weights[x], weights[y]) >= least * max(weights[x], weights[y]) and similarity(held[x], held[y]) >= least:
                root[max(p, q)] = min(p, q)
                links.append((rows[x], rows[y]))
        return pa.table({"u": pa.array([u for u, _ in links], pa.int64()), "v": pa.array([v for _, v in links], pa.int64())})

    return full.groupBy("bucket", "a", "b").applyInArrow(run, "u long, v long")


def components_of(df: DataFrame, id_col: str, text_col: str, width: int, least: float, bands: int, band_rows: int, chunk: int, row_col: str | None) -> DataFrame:
    """(row, id, part) of each text: ``part`` is the smallest row of its component of links; see :func:`near_duplicates`."""
    number = F.col(f"`{row_col}`") if row_col else row_id()
    docs = df.select(number.alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if not row_col:
        docs = materialize(docs, "near-docs")  # texts are read again by these numbers

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            found, keys = bags(batch.column("text").to_pylist(), width)
            full = [i for i, (h, _) in enumerate(found) if len(h)]
            banded: list = [None] * len(found)
            if full:
                for i, k in zip(full, band_keys(bag_min_hash([found[i] for i in full], bands * band_rows), band_rows), strict=True):
                    banded[i] = k
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(keys, pa.binary()), pa.array(banded, pa.list_(pa.int64()))], names=["row", "id", "key", "bands"])
        HASHES.clear()
        give_back()

    signed = materialize(small_batches(docs).mapInArrow(sign, "row long, id long, key binary, bands array<long>"), "near-signed")
    copies = signed.where("key is not null").groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    rows = signed.join(dealt_anew(copies, "key"), "key", "left").withColumn("first", F.coalesce("first", "row"))
    rows = materialize(rows.select("row", "id", "first", F.when(F.col("row") == F.col("first"), F.col("bands")).alias("bands")), "near-rows", gathered=True)
    banded = rows.where("bands is not null").select("row", F.posexplode("bands").alias("band", "key")).select("row", F.xxhash64("band", "key").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("row").alias("centre"), F.count("*").alias("n")).where("n > 1")
    met = materialize(banded.join(dealt_anew(shared, "bucket"), "bucket"), "near-met", gathered=True)
    pairs = met.where("row <> centre").select(F.col("row").alias("u"), F.col("centre").alias("v")).distinct()
    wanted = materialize(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct(), "near-wanted", gathered=True)
    texts = materialize(reread(docs, wanted, width), "near-texts", gathered=True)
    parts = components(verify(pairs, texts, least))

    # what a bucket's centre left open: its other rows, where they are in several components
    linked = parts.select(F.col("u").alias("row"), F.col("v").alias("part"))
    named = met.where("n > 2 and row <> centre").select("bucket", "row").join(linked, "row", "left").withColumn("part", F.coalesce("part", "row"))
    named = materialize(named.select("bucket", "row", "part"), "near-named", gathered=True)
    # buckets of the same rows are compared once
    several = named.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("rows")).where("p < q")
    open_ = several.groupBy("n", "rows").agg(F.min("bucket").alias("bucket")).select("bucket")
    more = materialize(link_cells(named.join(dealt_anew(open_, "bucket"), "bucket"), texts, least, chunk), "near-more")
    if not more.isEmpty():
        parts = components(parts.unionByName(more))

    return rows.join(parts.select(F.col("u").alias("first"), F.col("v").alias("part")), "first", "left").select("row", "id", F.coalesce("part", "first").alias("part"))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, bands: int = 24, band_rows: int = 4, chunk: int = 2 << 20, row_col: str | None = None
) -> DataFrame:
    """Classes of texts linked by a multiset similarity of ``width``-word shingles of ``least`` or more.

    Equal word sequences count once. Of the others, ``bands`` times ``band_rows``
    BagMinHash components are banded: a pair of similarity 0.8 shares a band with a
    probability of 0.999997. Rows of a band's bucket are verified against its
    smallest row, exactly, by multiset overlap; buckets whose other rows are then
    in several components are compared pair by pair in bounded cells, so a bucket's
    links are all found. Components of the links are the classes.

    Returns per input row: row_id, ``id_col`` (long), class_id (smallest id of the
    class), class_size, kept (one row of each class: that of the smallest id, null
    ids last, then the first of the scan). Texts without words (null, empty, white
    space) are classes of their own. Repeated rows are one class. An empty table
    gives an empty result; other columns are not read. ``row_col``: numbers that the
    written rows of ``df`` have already.
    """
    placed = condensed(lambda: components_of(df, id_col, text_col, width, least, bands, band_rows, chunk, row_col), "near-placed")
    best = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("best")
    classes = placed.groupBy("part").agg(best, F.count("*").alias("n")).where("n > 1").select("part", F.col("best.id").alias("class_id"), F.col("best.row").alias("stays"), "n")
    out = placed.join(dealt_anew(classes, "part"), "part", "left")
    alone = F.col("n").isNull()
    return out.select(
        F.col("row").alias("row_id"),
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("class_size"),
        (alone | (F.col("row") == F.col("stays"))).alias("kept"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of ``df``, with all their columns whatever their names, that :func:`near_duplicates` keeps.

    One row of each class of similar texts, that of the smallest id, null ids last,
    ties by the place in the scan. Texts without words (null, empty, white space)
    all stay; long texts are compared whole; an empty table gives an empty result.
    """
    row = fresh(df.columns, "__row")
    df = numbered(df, "near-docs", row)
    found = near_duplicates(df, id_col, text_col, row_col=row, **options)
    gone = materialize(found.where(~F.col("kept")).select(F.col("row_id").alias(row)), "near-gone", gathered=True)
    return df.join(gone, row, "left_anti").drop(row)
