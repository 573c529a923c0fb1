"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.store import Scratch


def _toward_minimum(both: DataFrame) -> DataFrame:
    """Each edge (u, v) with the smallest of u and its neighbours; a hot u is pre-aggregated and its join can split."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows (node, component): the smallest node reachable from each node that has an edge.

    edges has columns u and v of one orderable type; self loops and repeated
    edges do no harm.  Rounds grow as the logarithm of the longest path; each
    is written, so that no lineage builds up.
    """
    edges = scratch.save(edges.where("u <> v").select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), f"{name}-0")
    turn = 0
    while not _are_stars(edges):
        # large star: neighbours above u go to u's least neighbour
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        large = _toward_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its lesser neighbours go to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        turn += 1
        edges = scratch.save(small, f"{name}-{turn}")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(roots)
