"""Connected components of an edge table, by alternating large and small stars.

Minima are taken with partial aggregation, written, and joined back as a table: a join of two plain
tables is one whose large partitions Spark splits, so a vertex with very many edges is never one task's
work.  A round's tables are deleted when the next round's edges have been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, written


def _star(e: DataFrame, scratch: Scratch) -> DataFrame:
    """e: (u, v) in both directions.  Each v above u moves to the least of u and its neighbours."""
    least = scratch.written(e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return e.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: (u, v) longs.  (vertex, component) of every vertex with an edge to another one, as a written
    table; a component is named by its least vertex."""
    now_on = Scratch(edges.sparkSession)
    e = now_on.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        spent, now_on = now_on, Scratch(edges.sparkSession)
        large = _star(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), spent)
        # small star: u and its lower neighbours move to the least of them
        large = spent.written(large)
        least = spent.written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = now_on.written(small.where("u <> v").distinct())
        spent.clear()
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("the components did not settle")
    named = written(e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(e.select("v", "v").distinct()))
    now_on.clear()
    return named
