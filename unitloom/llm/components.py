"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(e: DataFrame, large: bool) -> DataFrame:
    """Each node hands the least of its neighbours and itself to its larger neighbours (large) or to the others (small).

    Only aggregates and equi-joins on the node: a node with very many neighbours is one aggregated row on one side.
    """
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else both.where("u > v").unionByName(e.where("b > a").select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    j = both.join(least, "u")
    out = j.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else j.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, component), component the smallest node that can be reached; nodes without links are left out.

    Steps are repeated until nothing changes, each written to the shared folder; what comes to the driver is a count and a sum.
    """
    e = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    last = None
    while True:
        e = stored(_star(_star(e, True), False), "links")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
