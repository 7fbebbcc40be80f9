"""Which dates an account's statements leave out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.model import signed


def missing_ranges(df: DataFrame, key: str, statement: str, order: Sequence[str], same: Sequence[str], asked: DataFrame, grace: int = 4, ignore_first: int | None = None, ignore_last: int | None = None, limit: float = 0.1) -> DataFrame:
    """key, gap_from, gap_to: stretches that a key's statements miss, overlapping ones merged.

    Between a statement and the next (by first and last date): the dates from one's last to the
    other's first row, if the balance does not carry over from one to the other, unless they
    overlap in time or share a row (equal in the columns `same`). At the edges: from asked_from to the
    first row and from the last row to asked_to, where more than grace days lie between; an edge
    of at most ignore_first or ignore_last days is let go where given (the last only if the
    asked month is not whole and has begun in the rows). What lies before the key's opening is cut off.
    asked: key, asked_from, asked_to, opening (dates; null where there is none). Keys that
    are not asked for have only the stretches between statements.
    """
    day, rows = F.to_date("date"), df.where(F.col("date").isNotNull())
    first, last = F.min_by(F.struct(signed().alias("step"), "balance"), F.struct(*order)), F.max_by("balance", F.struct(*order))
    spans = rows.groupBy(key, statement).agg(F.min(day).alias("low"), F.max(day).alias("high"), first.alias("first"), last.alias("last"))
    w = Window.partitionBy(key).orderBy("low", "high", statement)  # a row a statement
    spans = spans.withColumns({"before": F.lag(statement).over(w), "end": F.lag("high").over(w), "carried": F.lag("last").over(w)})
    held = rows.select(F.col(key), F.col(statement), F.xxhash64(*same).alias("_row")).distinct()
    pairs = spans.where(F.col("before").isNotNull()).select(key, F.col(statement).alias("_s"), F.col("before").alias("_b"))
    own, old = held.toDF("_k1", "_s1", "_r1"), held.toDF("_k2", "_s2", "_r2")
    met = pairs.join(own, F.col(key).eqNullSafe(F.col("_k1")) & (F.col("_s") == F.col("_s1"))).join(old, F.col("_k1").eqNullSafe(F.col("_k2")) & (F.col("_b") == F.col("_s2")) & (F.col("_r1") == F.col("_r2")))
    shared = met.select(F.col(key).alias("_mk"), F.col("_s").alias("_ms")).distinct()
    carries = F.abs(F.round(F.col("carried") + F.col("first.step"), 2) - F.col("first.balance")) <= limit
    open_ = spans.where((F.col("low") >= F.col("end")) & ~F.coalesce(carries, F.lit(False)))
    between = open_.join(shared, F.col(key).eqNullSafe(F.col("_mk")) & (F.col(statement) == F.col("_ms")), "left_anti").select(key, F.col("end").alias("a"), F.col("low").alias("b"))

    whole = spans.groupBy(key).agg(F.min("low").alias("low"), F.max_by("high", F.struct("low", "high", statement)).alias("high"))
    about = asked.select(F.col(key).alias("_ak"), "asked_from", "asked_to", "opening")
    edges = whole.join(about, F.col(key).eqNullSafe(F.col("_ak"))).drop("_ak")
    starts = spans.select(F.col(key).alias("_sk"), F.col("low").alias("_l"), F.col("high").alias("_h"))
    head = F.trunc("asked_to", "month")
    covers = edges.join(starts, F.col(key).eqNullSafe(F.col("_sk")) & (F.col("_l") <= head) & (head <= F.col("_h")), "left_semi").select(F.col(key).alias("_ck"))
    edges = edges.join(covers.withColumn("_begun", F.lit(True)), F.col(key).eqNullSafe(F.col("_ck")), "left")
    early, late = F.datediff("low", "asked_from"), F.datediff("asked_to", "high")
    let_first = early <= ignore_first if ignore_first is not None else F.lit(False)
    partial_month = F.coalesce("_begun", F.lit(False)) & (F.col("asked_to") != F.last_day("asked_to"))
    let_last = partial_month & (late <= ignore_last) if ignore_last is not None else F.lit(False)
    front = edges.where((early > grace) & ~let_first).select(key, F.col("asked_from").alias("a"), F.col("low").alias("b"))
    back = edges.where((late > grace) & ~let_last).select(key, F.col("high").alias("a"), F.col("asked_to").alias("b"))

    gaps = between.union(front).union(back).join(about, F.col(key).eqNullSafe(F.col("_ak")), "left")
    gaps = gaps.where(F.col("opening").isNull() | (F.col("b") >= F.col("opening")))
    cut = F.when(F.col("a") <= F.col("opening"), F.col("opening")).otherwise(F.col("a"))
    gaps = gaps.withColumn("_cut", F.col("opening").isNotNull() & (F.col("a") <= F.col("opening"))).withColumn("a", cut).where(~(F.col("_cut") & (F.col("a") == F.col("b"))))
    o = Window.partitionBy(key).orderBy("a", "b")
    reach = F.max("b").over(o.rowsBetween(Window.unboundedPreceding, -1))
    runs = gaps.withColumn("_new", F.coalesce(F.col("a") > reach, F.lit(True)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(F.min("a").alias("gap_from"), F.max("b").alias("gap_to")).drop("_run")
