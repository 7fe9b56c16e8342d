"""Connected components of a link table, by alternating large and small stars.

Both steps hang the neighbours of a node on its smallest neighbour, one towards larger ones and one towards smaller
ones; the number of rounds grows with the logarithm of the longest chain.  A hot node is never gathered: its smallest
neighbour is aggregated first, written, and joined back to its links, which Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dielens.functions.shuffles import settled


def compact(df: DataFrame, rows: int, purpose: str, each: int = 100_000) -> DataFrame:
    """``settled`` in as many files as a known number of rows needs; a few rows are not dealt to hundreds of tasks."""
    return settled(df.coalesce(max(1, -(-rows // each))), purpose)


def _star(both: DataFrame, small: bool, rows: int) -> DataFrame:
    """One step over links in both directions (u, v); the result has links (u, v) with u > v."""
    ahead = both.where("v < u") if small else both
    least = compact(ahead.groupBy("u").agg(F.min("v").alias("m")), rows, "components")
    least = least.withColumn("m", F.least("u", "m"))
    hung = both.where("v < u" if small else "v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        hung = hung.unionByName(least.select("u", F.col("m").alias("v")))
    return hung.where("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link: the smallest node it can reach."""
    links = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links = settled(links, "components")
    n = links.count()
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = compact(_star(both, small=False, rows=2 * n), n, "components")
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = compact(_star(both, small=True, rows=2 * n), n, "components")
        # only stars are left: every node hangs on one other, which hangs on none
        ends = links.select("u", F.lit(1).alias("hangs")).unionByName(links.select(F.col("v").alias("u"), F.lit(0).alias("hangs")))
        nodes = ends.groupBy("u").agg(F.sum("hangs").alias("hangs"), F.count("*").alias("ends")).where("hangs > 0")
        n, stars = nodes.agg(F.coalesce(F.sum("hangs"), F.lit(0)), F.coalesce(F.max("ends"), F.lit(1)) == 1).first()
        if stars:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
