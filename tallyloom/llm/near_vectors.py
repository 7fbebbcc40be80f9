"""Near-duplicate vectors by an epsilon grid order join.

Two unit vectors whose cosine is at least c lie within eps = sqrt(2 - 2c). Vectors are
turned onto their leading principal directions, laid on a grid of cells of width eps and
sorted by label and cell (the epsilon grid order). The sorted sequence is cut into
intervals of bounded size, each with its bounding box. Two intervals are joined only if
their boxes come within eps; a task splits both in halves, again and again, skips halves
that are provably distant, and compares what is left by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.runtime import cut

#: Leading directions of the grid; vectors in an interval; in a leaf of the recursion; sample that directions are fitted on.
AXES, INTERVAL, LEAF, SAMPLE = 8, 1024, 64, 8192
#: Vector lengths, the commonest ones, that get fitted directions; others use their first axes, which is as right.
FITTED = 8
#: What rounding may add to a distance; pairs near the limit are decided by the exact cosine.
_SLACK = 1e-6


def directions(sample: np.ndarray, axes: int = AXES) -> np.ndarray:
    """Orthonormal leading principal directions, one a column; any choice is safe, a good one skips more."""
    if not len(sample):
        return np.zeros((0, 0))
    x = sample - sample.mean(0)
    _, vectors = np.linalg.eigh(x.T @ x)
    return vectors[:, ::-1][:, :axes]


def _pairs(a: np.ndarray, b: np.ndarray, pa: np.ndarray, pb: np.ndarray, eps: float, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into a, into b) with cosine >= least; if same, a is b and i < j."""
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, j, k, m = stack.pop()
        if i >= j or k >= m or same and m <= i:
            continue
        gap = np.maximum(0, np.maximum(pa[i:j].min(0) - pb[k:m].max(0), pb[k:m].min(0) - pa[i:j].max(0)))
        if float(gap @ gap) > (eps + _SLACK) ** 2:
            continue
        if max(j - i, m - k) > LEAF:
            x, y = (i + j) // 2, (k + m) // 2
            firsts = [(i, x), (x, j)] if j - i > LEAF else [(i, j)]
            stack += [(*f, *s) for f in firsts for s in ([(k, y), (y, m)] if m - k > LEAF else [(k, m)])]
            continue
        rows, cols = np.nonzero(a[i:j] @ b[k:m].T >= least)
        rows, cols = rows + i, cols + k
        if same:
            rows, cols = rows[rows < cols], cols[rows < cols]
        if len(rows):
            yield rows, cols


def _spanning(rows: np.ndarray, cols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each linked vertex of 0..n-1 but the least of its component: it and that least one."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[rows], root[cols])
        new = root.copy()
        np.minimum.at(new, root[rows], low)
        np.minimum.at(new, root[cols], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    tied = np.flatnonzero(root != np.arange(n))
    return tied, root[tied]


def _distinct(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """One row for each (label, vector) that can link: its own number, least id, how many rows, length, the vector in double precision."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v")).where(sound)
    same = rows.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("times"))
    return same.select(F.monotonically_increasing_id().alias("node"), "label", "v", "id", "times", F.size("v").alias("size"))


def _turns(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Fitted directions by vector length, for the commonest lengths."""
    counts = distinct.groupBy("size").count().orderBy(F.desc("count"), "size").limit(FITTED).collect()
    out = {}
    for size, n in counts:
        share = int((1 << 20) * min(1.0, SAMPLE / n))
        drawn = distinct.where((F.col("size") == size) & (F.pmod(F.xxhash64("label", "v"), F.lit(1 << 20)) < share)).select("v").limit(2 * SAMPLE).toPandas()
        if len(drawn):
            out[size] = directions(_unit(np.stack(drawn["v"])), min(AXES, size))
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow in the squares
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def link_counts(vectors: DataFrame, least: float, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id.

    Rows link if their labels are equal and not null, their vectors equally long and the
    cosine, in double precision, is at least `least` (above 0). Null, empty and zero vectors
    and vectors with null or non-finite parts link with nothing and stand alone. Equal
    vectors of a label are compared once and counted as often as they occur. Ids may be of
    any type that has an order; a null id links as any other and names a component only
    where no row of it has an id. Other columns of vectors are not read.
    """
    eps = float(np.sqrt(2 - 2 * least))
    spark = vectors.sparkSession
    distinct = cut(_distinct(vectors, id_col, vector_col, label_col), "vectors")
    turns = _turns(distinct)

    def turned(x: np.ndarray) -> np.ndarray:
        """Unit vectors of one length on AXES directions; lengths without fitted ones use the first axes."""
        size = x.shape[1]
        at = x @ turns[size] if size in turns else x[:, :AXES]
        return np.pad(at, ((0, 0), (0, AXES - at.shape[1])))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, same in batch.groupby("size"):
                at = turned(_unit(np.stack(same["v"])))
                yield pd.DataFrame({"label": same["label"], "size": same["size"], "node": same["node"], "times": same["times"], "cells": list(np.floor(at / eps).astype(np.int32)), "v": same["v"]})

    label_type, id_type = dict(distinct.dtypes)["label"], dict(distinct.dtypes)["id"]
    placed = cut(distinct.select("label", "size", "node", "times", "v").mapInPandas(place, f"label {label_type}, size int, node long, times long, cells array<int>, v array<double>"), "cells")

    def intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Intervals of the sorted sequence, none across two labels or lengths; vectors and their numbers as bytes."""
        kind, nodes, times, held, number = None, [], [], [], TaskContext.get().partitionId() << 32

        def made() -> pd.DataFrame:
            x = _unit(np.array(held))
            p = turned(x)
            return pd.DataFrame({"label": [kind[0]], "size": [kind[1]], "first": [number], "low": [p.min(0)], "high": [p.max(0)], "nodes": [np.array(nodes, np.int64).tobytes()], "times": [np.array(times, np.int64).tobytes()], "data": [x.tobytes()]})

        for batch in batches:
            for lab, size, i, n, v in zip(batch["label"].tolist(), batch["size"].tolist(), batch["node"].tolist(), batch["times"].tolist(), batch["v"]):
                if held and ((lab, size) != kind or len(held) == INTERVAL):
                    yield made()
                    nodes, times, held, number = [], [], [], number + 1
                kind = lab, size
                nodes.append(i)
                times.append(n)
                held.append(v)
        if held:
            yield made()

    order = ["label", "size", *(F.col("cells")[k] for k in range(AXES)), "node"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = f"label {label_type}, size int, first long, low array<double>, high array<double>, nodes binary, times binary, data binary"
    cuts = cut(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("label", "size", "node", "times", "v").mapInPandas(intervals, kind), "intervals")

    # boxes within eps of each other, found by the cells that they touch along the first two directions
    def cells(frame: DataFrame, margin: float) -> DataFrame:
        for k in range(2):
            low, high = F.floor((F.col("low")[k] - margin) / eps).cast("long"), F.floor((F.col("high")[k] + margin) / eps).cast("long")
            frame = frame.withColumn(f"cell{k}", F.explode(F.sequence(low, high)))
        return frame

    boxes = cuts.select("label", "size", "first", "low", "high")
    touch, reach = cells(boxes, 0.0), cells(boxes, eps + _SLACK).withColumnsRenamed({"first": "other", "low": "low2", "high": "high2"})
    gap = F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("low2", "high2"), lambda x, y: F.greatest(F.lit(0.0), x["low"] - y["high2"], y["low2"] - x["high"]))
    near = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x) <= (eps + _SLACK) ** 2
    meet = touch.join(reach, ["label", "size", "cell0", "cell1"]).where((F.col("first") <= F.col("other")) & near).select("first", "other", "low", "high", "low2", "high2").distinct()

    def trimmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of an interval's vectors those within eps of the partner's box; only these travel to it."""
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                x, nodes, times = np.frombuffer(r.data).reshape(-1, r.size), np.frombuffer(r.nodes, np.int64), np.frombuffer(r.times, np.int64)
                if r.first != r.other:
                    p = turned(x)
                    away = np.maximum(0, np.maximum(np.asarray(r.low) - p, p - np.asarray(r.high)))
                    keep = (away * away).sum(1) <= (eps + _SLACK) ** 2
                    x, nodes, times = x[keep], nodes[keep], times[keep]
                if len(x):
                    out.append((r.first, r.other, r.size, nodes.tobytes(), times.tobytes(), x.tobytes()))
            yield pd.DataFrame(out, columns=["first", "other", "size", "nodes", "times", "data"])

    side = "first long, other long, size int, nodes binary, times binary, data binary"
    vectors_of = cuts.select("first", "size", "nodes", "times", "data")
    left = meet.select("first", "other", F.col("low2").alias("low"), F.col("high2").alias("high")).join(vectors_of, "first")
    right = meet.where(F.col("first") < F.col("other")).select("first", "other", "low", "high").join(vectors_of.withColumnRenamed("first", "other"), "other")
    a = left.select("first", "other", "low", "high", "size", "nodes", "times", "data").mapInPandas(trimmed, side)
    b = right.select("first", "other", "low", "high", "size", "nodes", "times", "data").mapInPandas(trimmed, side).drop("size").withColumnsRenamed({"nodes": "nodes2", "times": "times2", "data": "data2"})
    tasks = a.join(b, ["first", "other"], "left").where((F.col("first") == F.col("other")) | F.col("data2").isNotNull())

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                same = r.first == r.other
                a, nodes, times = np.frombuffer(r.data).reshape(-1, r.size), np.frombuffer(r.nodes, np.int64), np.frombuffer(r.times, np.int64)
                b, nodes2, times2 = (a, nodes, times) if same else (np.frombuffer(r.data2).reshape(-1, r.size), np.frombuffer(r.nodes2, np.int64), np.frombuffer(r.times2, np.int64))
                found = list(_pairs(a, b, turned(a), turned(b), eps, least, same))
                if not found:
                    continue
                rows, cols = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                n, n2 = np.bincount(rows, times2[cols], len(nodes)).astype(np.int64), np.bincount(cols, times[rows], len(nodes2)).astype(np.int64)
                x, y = _spanning(rows, cols, len(nodes)) if same else _spanning(rows, cols + len(nodes), len(nodes) + len(nodes2))
                both = nodes if same else np.concatenate([nodes, nodes2])
                yield pd.DataFrame({"a": np.concatenate([nodes[n > 0], nodes2[n2 > 0]]), "b": -1, "n": np.concatenate([n[n > 0], n2[n2 > 0]])})
                yield pd.DataFrame({"a": both[x], "b": both[y], "n": 0})

    results = cut(tasks.mapInPandas(compare, "a long, b long, n long"), "links")  # b is -1 in rows that count links
    counts = results.where(F.col("b") < 0).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(results.where(F.col("b") >= 0).select("a", "b")).select(F.col("id").alias("node"), F.col("component").alias("root"))
    found = distinct.join(counts, "node", "left").join(roots, "node", "left")
    found = cut(found.select("label", "v", "id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "found")
    named = found.join(found.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("label", "v", "n_links", "component_id")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    joined = rows.join(named, ["label", "v"], "left")
    alone = F.col("n_links").isNull()
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
