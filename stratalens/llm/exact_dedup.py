"""Exact deduplication by 128-bit content hash with byte comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, fresh, keyed, materialize, row_id

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(text: Column) -> Column:
    """Lower-case A-Z alone; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def content_hash(norm: Column) -> Column:
    """128 bits of the normalised bytes."""
    return F.unhex(F.md5(norm.cast("binary")))


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", key: Callable[[Column], Column] = content_hash, row_col: str | None = None
) -> DataFrame:
    """Group rows of equal normalised text and choose the one that stays.

    Rows are grouped by a 128-bit hash. The bytes inside groups of several rows are
    compared by grouping on (hash, text), where copies collapse before the shuffle; a hash
    that turns out to have several texts is split by the texts' SHA-256. Only
    narrow rows (ids and hashes) are joined back, so a group of any size is a
    counter in the aggregates and a splittable side of one join.

    Returns a row per input row: ``row_id`` (of the scan), ``id_col``, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256``. ``keep`` is "min" or "max", over the
    id; null ids lose to any other; rows tied on the id are told apart by their
    place in the scan, so exactly one row of a group is kept. Null text equals
    empty text. An empty table gives an empty result. Further input columns,
    whatever their names, are not read. ``row_col``: numbers that the written rows of
    ``df`` have already.
    """
    docs = df.select((F.col(f"`{row_col}`") if row_col else row_id()).alias("row_id"), F.col(f"`{id_col}`").alias("id"), normalized(F.col(f"`{text_col}`")).alias("norm"))
    hashed = docs.withColumn("h", key(F.col("norm")))
    rows = materialize(hashed.select("row_id", "id", "h", F.sha2("norm", 256).alias("sha")), "dedup-rows")
    # a hash of one row has no collision: only texts whose hash occurs again are compared
    again = materialize(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "dedup-again", gathered=True)
    # collisions and groups are written out: their size is then known, so they are broadcast only if small,
    # and else the rows they join are dealt by key anew, where large keys can be split
    collided = hashed.join(dealt_anew(again, "h"), "h", "left_semi").groupBy("h", "norm").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h", F.lit(True).alias("split"))
    collided = materialize(collided, "dedup-collided", gathered=True)
    split = F.when(F.col("split"), F.unhex("sha")).otherwise(F.unhex(F.lit("")))
    rows = rows.join(collided, "h", "left").withColumn("part", F.concat("h", split))
    order = F.struct(F.col("id").isNotNull(), "id", "row_id") if keep == "max" else F.struct(F.col("id").isNull(), "id", "row_id")
    groups = rows.groupBy("part").agg((F.max if keep == "max" else F.min)(order).alias("best"), F.count("*").alias("n")).where("n > 1")
    groups = materialize(groups.select("part", F.col("best.id").alias("keep_id"), F.col("best.row_id").alias("keep_row"), "n"), "dedup-groups", gathered=True)
    joined = rows.join(groups, "part", "left")
    alone = F.col("n").isNull()
    return joined.select(
        "row_id",
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_id") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``df``, with all their columns whatever their names, that :func:`exact_dedup` keeps.

    One row of each group of equal texts: null and empty texts are one group, null ids
    lose to others, ties go by the place in the scan. Texts of any length are compared
    whole; an empty table gives an empty result.
    """
    row = fresh(df.columns, "__row")
    df = keyed(df, "dedup-docs", row)
    gone = materialize(exact_dedup(df, id_col, text_col, keep, row_col=row).where(~F.col("kept")).select(F.col("row_id").alias(row)), "dedup-gone", gathered=True)
    return df.join(gone, row, "left_anti").drop(row)
