"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumtide.llm._kit import materialize


def _large_star(e: DataFrame) -> DataFrame:
    """Every vertex joins its larger neighbours to its least neighbour (or itself)."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every vertex joins its smaller neighbours and itself to the least of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs; returns (u, v): every vertex but the least of its component with that least one. Each round is written to the shared folder; the number
    of rounds grows with the logarithm of the longest chain."""
    e = materialize(edges.where("u <> v").distinct(), "edges")
    seen = None
    while True:
        e = materialize(_small_star(_large_star(e)), "stars")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return e
        seen = now
