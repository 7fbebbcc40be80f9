"""Feed repairs against the same steps tried on whole lists, and each step on its own."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tallyloom.operators import feeds

DAY = datetime(2024, 1, 1)


def chain(rng, n, day=None):
    balance, out, d = 500.0, [], 0
    for i in range(n):
        d += rng.choice([0, 1]) if day is None else 0
        amount = round(rng.uniform(1, 90), 2) * rng.choice([1, -1])
        balance = round(balance + amount, 2)
        out.append([i, DAY + timedelta(days=d), amount, balance])
    return out


def whole(rows, limit=0.1):
    """All rows at once: at the first break the first step is kept that puts the first break behind what it touched."""
    rows = [(*r, ()) for r in rows]
    first = lambda x: next((i for i in range(1, len(x)) if not abs(round(x[i - 1][3] + x[i][2], 2) - round(x[i][3], 2)) <= limit), len(x))
    while (i := first(rows)) < len(rows):
        for step in feeds.STEPS:
            kept = next((trial for trial, last in step(rows[: i + feeds.LOOK + feeds.TOGETHER + 1], i) if first(trial) > last), None)
            if kept is not None:
                rows = kept + rows[i + feeds.LOOK + feeds.TOGETHER + 1 :]
                break
        else:
            break
    return rows


def damaged(rng, kind):
    s = chain(rng, rng.choice([6, 20, 90]), day=0 if kind == "swap" else None)
    i = rng.randrange(1, len(s) - 3)
    if kind == "swap":
        s[i], s[i + 1] = s[i + 1], s[i]
    elif kind == "split":
        s[i][3] = s[i + 1][3] = s[i + 2][3]
    elif kind == "early":
        j = min(len(s) - 1, i + rng.randrange(3, 30))
        s.insert(i, s.pop(j))
    elif kind == "late":
        j = min(len(s) - 1, i + rng.randrange(3, 30))
        s.insert(j, s.pop(i))
    elif kind == "two":
        return damaged(rng, "early") + [[1000 + k, d, a, b] for k, d, a, b in damaged(rng, "late")]
    elif kind == "gap":
        del s[i]
    elif kind == "null":
        s[i][3] = None
    return s


def test_repairs_equal_those_of_whole_lists(spark, monkeypatch):
    rng, rows, cases = random.Random(2), [], {}
    for n in range(60):
        s = damaged(rng, ["none", "swap", "split", "early", "late", "two", "gap", "null"][n % 8])
        cases[str(n)] = s
        rows += [(str(n), i, r[1], "debit" if r[2] < 0 else "credit", abs(r[2]), r[3], r[0]) for i, r in enumerate(s)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, i int, date timestamp, transaction_type string, amount double, balance double, id int, key string").repartition(4)
    got = {}
    for r in sorted(feeds.repaired_feed(df, "k", ["i"]).collect(), key=lambda r: r["place"]):
        got.setdefault(r["k"], []).append((r["id"], r["new_balance"], tuple(r["tags"])))
    nan = float("nan")
    tags = set()
    for k, s in cases.items():
        want = [(r[0], None if r[3] != r[3] else r[3], r[4]) for r in whole([[i, d, a, nan if b is None else b] for i, d, a, b in s])]
        assert got[k] == want, k
        tags |= {t for _, _, ts in want for t in ts}
    assert tags >= {"SWAPPED_CONSECUTIVE_TRANSACTIONS", "N_SPLIT_IMPROVEMENT"} and tags & {"EARLY_JUMP", "LATE_JUMP"}
    assert feeds.repaired_feed(df.limit(0), "k", ["i"]).collect() == []


@pytest.mark.parametrize(("step", "order"), [(feeds.swapped, [0, 2, 1, 3]), (feeds.early, [0, 3, 1, 2, 4]), (feeds.late, [0, 2, 3, 1, 4])])
def test_each_step_mends_its_fault(step, order):
    rows = [(*r, ()) for r in chain(random.Random(1), 5, day=0)][: len(order)]
    given = [rows[i] for i in order]
    i = feeds.breaks_at(given, 1, len(given) - 1, 0.1)
    out = feeds.mended(given, i, (step,), 0.1)
    assert [r[0] for r in out] == list(range(len(order))) and given[i][4] == ()
    wrong = [(*r[:3], r[3] + 7 * (n % 2), ()) for n, r in enumerate(rows)]
    assert feeds.mended(wrong, feeds.breaks_at(wrong, 1, len(wrong) - 1, 0.1), (step,), 0.1) is None
