"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage


def _starred(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on distinct edges (hi > lo)."""
    lowest = edges.groupBy("lo").agg(F.min("lo").alias("own"))
    below = edges.select(F.col("hi").alias("lo"), F.col("lo").alias("own"))
    least = lowest.unionByName(below).groupBy("lo").agg(F.min("own").alias("least"))
    large = (
        edges.join(least, "lo")
        .select("hi", F.col("least").alias("lo"))
        .where("hi > lo")
        .distinct()
    )
    smallest = large.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = large.join(smallest, "hi").where("lo > least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return moved.unionByName(smallest.withColumnRenamed("least", "lo")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every id in ``edges`` (columns a and b, in any order).

    Every round is written to the shared folder. Minima per id combine map-side
    and no id's neighbours are gathered, so hubs do no harm; the number of rounds
    grows with the logarithm of the longest chain. No edges: no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    edges = stage(edges.distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = stage(_starred(edges), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    return (
        edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
        .unionByName(edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")))
        .distinct()
    )
