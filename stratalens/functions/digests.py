"""Content digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(content: Column) -> Column:
    """``sha256:`` and the hex digest of the bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(content.cast("binary"), 256))


def verified(content: Column, expected: Column) -> Column:
    """Whether content has the digest it should have; missing content has not."""
    return F.coalesce(digest(content) == expected, F.lit(False))
