"""The graph of enrichment stages: what is stale, and nothing else, runs again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.stages import Enrichments, Stage, order_of


def graph(calls):
    def monthly(given):
        calls.append("monthly")
        return given["rows"].groupBy("k", "m").agg(F.sum("v").alias("total"))

    return [
        Stage("report", ("scores", "counts"), lambda g: g["scores"].join(g["counts"], "k")),
        Stage("scores", ("monthly", "weights"), lambda g: g["monthly"].join(g["weights"], "k").groupBy("k").agg(F.sum(F.col("total") * F.col("w")).alias("score"))),
        Stage("counts", ("rows",), lambda g: g["rows"].groupBy("k").agg(F.count("*").alias("n"))),
        Stage("monthly", ("rows",), monthly),
    ]


def test_only_what_is_stale_runs(spark, tmp_path):
    calls: list = []
    rows = [(1, 1, 10), (1, 2, 5), (2, 1, 7), (3, 1, 1), (None, 1, 4)]
    weights = [(1, 2), (2, 3), (3, 4), (None, 1)]

    def frames(rows, weights):
        return {"rows": spark.createDataFrame(rows, "k int, m int, v int").repartition(3), "weights": spark.createDataFrame(weights, "k int, w int")}

    store = Enrichments(spark, f"file://{tmp_path}/e", "k", graph(calls), ["rows", "weights"], buckets=4)

    def run(number, rows, weights):
        results, ran = store.refresh(frames(rows, weights), number)
        made = {}
        for r in ran.collect():
            made.setdefault(r["stage"], set()).add(r["key"])
        return {n: sorted(map(tuple, df.collect()), key=str) for n, df in results.items()}, made

    every = {"1", "2", "3", "\u0000"}
    got, ran = run(0, rows, weights)
    assert ran == {s: every for s in ("monthly", "counts", "scores", "report")}
    assert got["scores"] == [(1, 30), (2, 21), (3, 4)] and got["report"] == [(1, 30, 2), (2, 21, 1), (3, 4, 1)]
    again, ran = run(1, rows[::-1], weights)  # another order is no change
    assert ran == {} and again == got
    # key 2 gets another value, key 1 the same total from other rows, key 3 goes, key 4 comes
    changed = [(1, 1, 9), (1, 1, 1), (1, 2, 5), (2, 1, 8), (None, 1, 4), (4, 1, 1)]
    got, ran = run(2, changed, [*weights, (4, 5)])
    assert ran["monthly"] == {"1", "2", "4"} and ran["counts"] == {"1", "2", "4"} and ran["scores"] == {"2", "3", "4"} and ran["report"] == {"1", "2", "4"}
    assert got["monthly"] == sorted([(1, 1, 10), (1, 2, 5), (2, 1, 8), (None, 1, 4), (4, 1, 1)], key=str)
    assert got["scores"] == [(1, 30), (2, 24), (4, 5)] and got["report"] == [(1, 30, 3), (2, 24, 1), (4, 5, 1)]
    repeated, _ = run(2, changed, [*weights, (4, 5)])  # a run that ended half-way starts over under its number
    assert repeated == got
    got, ran = run(3, changed, [(1, 3), *weights[1:], (4, 5)])
    assert ran == {"scores": {"1"}, "report": {"1"}} and got["scores"][0] == (1, 45)


def test_graphs_that_cannot_be_ordered():
    stage = lambda name, *inputs: Stage(name, inputs, lambda g: g)
    assert [s.name for s in order_of([stage("b", "a"), stage("a", "s")], ["s"])] == ["a", "b"]
    for bad in ([stage("a", "b"), stage("b", "a")], [stage("a", "x")], [stage("a", "s"), stage("a", "s")], [stage("s", "s")]):
        with pytest.raises(ValueError):
            order_of(bad, ["s"])


def test_the_first_run_joins_nothing_with_what_is_stale(spark, tmp_path):
    """While nothing was made before, all rows are stale and all results the last ones; later both are sought again."""
    seen: list = []

    def counts(given):
        seen.append(given["rows"]._jdf.queryExecution().analyzed().toString())
        return given["rows"].groupBy("k").agg(F.count("*").alias("n"))

    store = Enrichments(spark, f"file://{tmp_path}/e", "k", [Stage("counts", ("rows",), counts)], ["rows"], buckets=2)
    frame = lambda *keys: {"rows": spark.createDataFrame([(k,) for k in keys], "k int")}
    got, _ = store.refresh(frame(1, 1, 2, None), 0)
    assert sorted(map(tuple, got["counts"].collect()), key=str) == [(1, 2), (2, 1), (None, 1)]
    assert "Join" not in seen[0] + got["counts"]._jdf.queryExecution().analyzed().toString()
    got, _ = store.refresh(frame(1, 2, 2), 1)
    assert sorted(map(tuple, got["counts"].collect())) == [(1, 1), (2, 2)] and "Join" in seen[1]
