"""Connected components by alternating large-star and small-star rounds.

Each round moves every edge towards the smallest node it can see.  A node's minimum is a partial
aggregate, and is joined back by ``spread_join``, so the edges of a node that has very many of them
are never in one task.  Rounds are written to the shared folder, and only a count and a checksum
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored, tidied

#: Edges that a file of a round is meant to hold, and the fewest files; a round of few edges is no work for very many tasks.
FILE_EDGES, LEAST_FILES = 250_000, 8


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (a, b): node, component for every node that has an edge to another; component is its smallest node."""
    return tidied(edges.sparkSession, name, lambda: _rounds(edges, name))


def _rounds(edges: DataFrame, name: str) -> DataFrame:
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), name)
    before = _checksum(e)
    while n := before[0]:
        files = max(LEAST_FILES, n // FILE_EDGES)  # edges never become more
        # Large star: every larger neighbour of u goes to the smallest node that u sees.
        both = e.select(F.col("v").alias("u"), F.col("m").alias("n")).union(e.select(F.col("m").alias("u"), F.col("v").alias("n")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("n")).alias("m"), F.count(F.lit(1)).alias("edges"))
        e = spread_join(both.where("n > u"), least, ["u"], 2 * n, 2 * n, "edges").select(F.col("n").alias("v"), "m").distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        e = stored(e, name, files)
        least = e.groupBy("v").agg(F.min("m").alias("r"), F.count(F.lit(1)).alias("edges"))
        e = spread_join(e, least, ["v"], n, n, "edges").where("m <> r").select(F.col("m").alias("v"), F.col("r").alias("m")).union(least.select("v", F.col("r").alias("m"))).distinct()
        e = stored(e, name, files)
        after = _checksum(e)
        if after == before:
            break
        before = after
    return e.select(F.col("v").alias("node"), F.col("m").alias("component")).union(e.select(F.col("m").alias("node"), F.col("m").alias("component"))).distinct()
