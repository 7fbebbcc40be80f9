"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.runtime import cut_at, remove


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    side = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return side.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) longs -> (id, component): each linked id with the least id it can reach.

    Loops and repeats are allowed; ids without a link to another do not appear. Every
    round keeps at most as many edges as there were and is written to the shared folder;
    the number of rounds grows with the logarithm of the longest chain. A round's table is
    removed once the next one is written. A vertex with very many edges is reduced by partial
    aggregation, and its join is one that Spark can split.
    """
    held, path = cut_at(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    before = None
    while True:
        state = held.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        old, before = path, state
        held, path = cut_at(_small_star(_large_star(held)), "edges")
        remove(held.sparkSession, old)
    return held.select(F.col("a").alias("id"), F.col("b").alias("component")).union(held.select("b", "b").distinct().toDF("id", "component"))
