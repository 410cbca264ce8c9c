"""Sizes, windows and memory estimates as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB, GIB = 1 << 10, 1 << 20, 1 << 30
#: Estimated memory of an encoder by log2 of its window; larger or unknown windows take the last.
WINDOW_RSS = {27: 256 * MIB, 28: 512 * MIB, 29: GIB, 30: 2 * GIB, 31: 4 * GIB}
#: Lower bounds and labels of the size histogram.
BUCKETS = [(0, "<1MiB"), (MIB, "1-10MiB"), (10 * MIB, "10-100MiB"), (100 * MIB, "100MiB-1GiB"), (GIB, ">=1GiB")]
#: Suffixes of a memory budget.
SUFFIXES = {"KIB": KIB, "MIB": MIB, "GIB": GIB, "KB": 1000, "MB": 1000**2, "GB": 1000**3, "": 1}
# Compression levels by bin, and the default window.
LEVEL_BINS = [(2, "fastest"), (7, "default"), (15, "better"), (22, "best")]
DEFAULT_LEVEL, DEFAULT_WINDOW = 3, 27


def window_log(size: Column, asked: int | Column = 0) -> Column:
    """The asked window, or by size: up to 128 MiB 27, up to 1 GiB 30, beyond 31."""
    asked = F.lit(asked) if isinstance(asked, int) else asked
    return F.when(asked != 0, asked).when(size <= 128 * MIB, 27).when(size <= GIB, 30).otherwise(31)


def window_rss(log: Column) -> Column:
    """Estimated bytes of memory for a window."""
    table = F.create_map(*[F.lit(x) for kv in WINDOW_RSS.items() for x in kv])
    return F.coalesce(F.element_at(table, log.cast("int")), F.lit(WINDOW_RSS[31])).cast("long")


def bucket(size: Column) -> Column:
    """Index of the histogram bucket, by half-open intervals."""
    out = F.lit(0)
    for i, (low, _) in enumerate(BUCKETS[1:], 1):
        out = F.when(size >= low, i).otherwise(out)
    return out.cast("int")


def human(size: Column) -> Column:
    """Whole bytes below 1 KiB, else one decimal, rounded half to even, in KiB, MiB or GiB."""

    def unit(one: int, name: str) -> Column:
        return F.format_string(f"%.1f {name}", F.bround(size / F.lit(float(one)), 1))

    return F.when(size < KIB, F.format_string("%d B", size)).when(size < MIB, unit(KIB, "KiB")).when(size < GIB, unit(MIB, "MiB")).otherwise(unit(GIB, "GiB"))


def ratio(part: Column, whole: Column) -> Column:
    """A double; 0 where the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def parse_budget(text: str) -> int:
    """Bytes of a memory budget such as 512MiB, 8 GB or 1048576.

    >>> parse_budget("2 GiB"), parse_budget("10kb"), parse_budget("0")
    (2147483648, 10000, 0)
    """
    m = re.fullmatch(r"\s*\+?(\d+)\s*([KMG]I?B)?\s*", text, re.IGNORECASE)
    if not m:
        raise ValueError(f"not a memory budget: {text!r}")
    return int(m[1]) * SUFFIXES[(m[2] or "").upper()]


def level_bin(level: int) -> str:
    """The bin of a compression level; 0 is the default level."""
    level = level or DEFAULT_LEVEL
    return next((name for top, name in LEVEL_BINS if level <= top), LEVEL_BINS[-1][1])
