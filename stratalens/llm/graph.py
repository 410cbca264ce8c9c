"""Connected components of links that may be as many as the rows of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, materialize


def _state(edges: DataFrame) -> tuple:
    """Number and hash of the edges: equal if nothing changed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(u, v): every node that is not the smallest of its component, with the smallest.

    ``links`` has (u, v), any order, repeats allowed; links of a node to itself and
    links with a null end are ignored. Alternates large-star and small-star steps
    (Kiveris et al., 2014): each node tells its larger neighbours, then its smaller
    ones, of the smallest node it knows, until nothing changes. Edges never grow in
    number, minima are combined before the shuffle, and the state of each step is a
    written table; no link is collected.
    """
    ends = F.struct(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = links.where("u <> v").select(ends.alias("e")).select("e.*").distinct()
    edges = materialize(edges, "graph-edges", gathered=True)
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(dealt_anew(least, "u"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "graph-large", gathered=True)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(dealt_anew(least, "u"), "u")
        small = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "graph-small", gathered=True)
        now = _state(edges)
        if now == before:
            return edges
        before = now
