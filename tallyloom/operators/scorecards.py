"""Score-card bins: tree splits of numbers, groups of categories, and the weight of evidence of each."""

from __future__ import annotations

import heapq
import itertools
import math

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_points(df: DataFrame, x: str, y: str, groups: int, least: int) -> list[float]:
    """Where a decision tree of about so many leaves cuts x to tell 0 and 1 of y apart; of its cuts the groups - 1 best."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if not rows.limit(1).count():
        return []
    depth = max(1, math.ceil(math.log2(max(2, groups))))
    tree = DecisionTreeClassifier(featuresCol="f", labelCol="y", maxDepth=depth, minInstancesPerNode=least, maxBins=256, seed=1)
    model = tree.fit(VectorAssembler(inputCols=["x"], outputCol="f").transform(rows))
    return best_cuts(model._java_obj.rootNode(), groups - 1)


def best_cuts(root, most: int) -> list[float]:
    """The cuts of a fitted tree that lower impurity most, rows counted; a node's cut is taken after its parent's."""
    order, ripe, taken = itertools.count(), [], []

    def grown(node) -> None:
        if node.numDescendants():
            heapq.heappush(ripe, (-node.gain() * node.impurityStats().count(), next(order), node))

    grown(root)
    while ripe and len(taken) < most:
        _, _, node = heapq.heappop(ripe)
        taken.append(float(node.split().threshold()))
        grown(node.leftChild())
        grown(node.rightChild())
    return sorted(set(taken))


def bin_of(c: Column, points: list[float]) -> Column:
    """The number of points at or below a value; null for null."""
    out = F.lit(0)
    for p in points:
        out = out + (c > p).cast("int")
    return F.when(c.isNotNull(), out)


def category_groups(df: DataFrame, x: str, y: str, rare: int, points: list[float] | None = None, groups: int = 4, least: int = 20) -> tuple[DataFrame, list[float]]:
    """df with rate and grp: a category's event rate (rare ones and rare nulls share one) and the bin of that rate.

    points: the cuts of the rate; where they are not given a tree finds them.
    """
    stats = df.where(F.col(y).isNotNull()).groupBy(x).agg(F.count("*").alias("_n"), F.sum(y).alias("_b"))
    pooled = stats.where(F.col("_n") < rare).agg((F.sum("_b") / F.sum("_n")).alias("_pooled"))
    rates = stats.select(F.col(x).alias("_x"), F.when(F.col("_n") < rare, pooled.scalar()).otherwise(F.col("_b") / F.col("_n")).alias("rate"))
    rated = df.join(rates, F.col(x).eqNullSafe(F.col("_x")), "left").drop("_x")
    points = split_points(rated, "rate", y, groups, least) if points is None else points
    return rated.withColumn("grp", bin_of(F.col("rate"), points)), points
