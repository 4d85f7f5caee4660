"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.scratch import cut, discard


#: Edges that one file takes: a table that shrinks round by round leaves few files.
FEW = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def stars(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u but the least of its component, v being the least. ``edges``: (u, v) longs, no nulls.

    Each round replaces edges by edges to smaller neighbours and keeps the components; about log2 of the longest path
    many rounds. A hub's edges are joined to one row, so a skewed join can split them; nothing gathers a component.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    before, now = None, _state(edges)
    while now != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        small = small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct()
        following = cut(small.coalesce(now[0] // FEW + 1), "stars")  # a round makes no more edges than it had
        discard(edges)
        edges, before, now = following, now, _state(following)
    return edges
