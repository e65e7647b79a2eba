"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u > v).  The minimum of each neighbourhood is a map-side combined
    aggregate, joined back, so that a vertex with very many neighbours is never gathered in one row."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(low, "u")
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(scratch: Scratch, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, label) for every id with an edge to another; label is the smallest id reachable.

    Ends when neither step changes the edges; each step is written to the shared folder.
    No edges: an empty table.  Repeated edges and self-loops are ignored.
    """
    now = scratch.keep(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "edges")
    mark = None
    while True:
        large = scratch.keep(_stars(now, True), "large")
        small = scratch.keep(_stars(large, False), "small")
        seen = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now, large)
        now = small
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("label"))
        mark = tuple(seen)
