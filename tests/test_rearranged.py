"""Steps over a key's rows without a frame for each key."""

from __future__ import annotations

import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tallyloom.operators import features, windows


def test_keys_are_whole_whatever_the_batches(spark):
    rows = [(k if k else None, i, f"{k}-{i}") for k in range(5) for i in range([1, 7, 3, 4, 12][k])]
    df = spark.createDataFrame(rows, "k long, i long, t string")
    step = lambda cells: [(p, len(cells), cells[p][0].upper() + "x") for p in reversed(range(len(cells))) if p != 2]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        for parts in (df, df.limit(0), df.where("k = 4")):
            got = sorted(map(str, windows.rearranged(parts, "k", ["i"], ["t"], step, "n int, t string").collect()))
            want = [r for r in rows if r[1] != 2 and (parts is df or parts.where(F.col("k") == r[0]).count())]
            size = {r[0]: sum(x[0] == r[0] for x in rows) for r in rows}
            assert got == sorted(f"Row(k={k}, i={i}, n={size[k]}, t={t + 'x'!r})" for k, i, t in want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_steps_over_many_small_accounts():
    rows = [(p, i, 5.0 * i) for p, span in ((0, range(6)), (1, range(3, 9))) for i in span]
    chain = [("credit", 5.0, 5.0, 1), ("credit", 5.0, 10.0, 1), ("credit", 2.0, 8.0, 1), ("credit", 3.0, 11.0, 2)]
    began = time.monotonic()
    for _ in range(5000):
        folded, fixed, moved = features.joined_lists(rows, 1), features.repaired_statement(chain), features.swapped_neighbours(chain)
    assert time.monotonic() - began < 10  # a frame for each account took milliseconds
    assert [rows[i][1] for (i,) in folded] == list(range(9))
    assert fixed == [(0, "credit"), (1, "credit"), (2, "debit"), (3, "credit")] and moved == [(i, i + 1) for i in range(4)]


def test_fuzzy_groups_by_bounds():
    texts = [f"{a}{b} paid to {c}" for a in ("upi", "neft", "") for b in ("/1", "/22", "-7") for c in ("ann", "anna", "bob rd")] + [None, "", "upi/1 paid to ann"]
    seeds, want = [], []
    for t in (t or "" for t in texts):
        k = next((k for k, s in enumerate(seeds) if 100 * SequenceMatcher(None, t, s, autojunk=False).ratio() >= 85), len(seeds))
        if k == len(seeds):
            seeds.append(t)
        want.append(k)
    assert features.fuzzy_groups([(t,) for t in texts], 85.0) == list(enumerate(want))
