"""Salaries against a pass over each account's months."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import salary

DAY = datetime(2023, 1, 1)


def pays(date):
    return (date.replace(day=1) - timedelta(days=1) if date.day < 20 else date).strftime("%Y-%m")


def month_by_month(rows, months, limit, ignore):
    """rows: (date, seq, amount) of one account -> {salary month: seq}."""
    rows = sorted(rows)
    if not rows:
        return {}
    mid = median(r[2] for r in rows[-6:])
    held = [{"seq": s, "amount": a, "month": pays(d), "delta": abs(mid - a) / mid if mid > 0 else 1} for d, s, a in rows]
    held = held if ignore else [h for h in held if h["delta"] < limit]
    before = None
    for month in sorted(months):
        own = [h for h in held if h["month"] == month]
        if len(own) > 1:
            if before and not any(h["month"] == before for h in held):
                own[0]["month"] = before
            else:
                near = [h for h in own if h["delta"] < 0.3]
                best = min(near, key=lambda h: (h["delta"], -h["amount"])) if near else max(own, key=lambda h: h["amount"])
                for h in own:
                    h["month"] = month if h is best else None
        before = month
    out = {h["month"]: h["seq"] for h in held if h["month"]}
    return out if ignore or len(out) > 1 else {}


@pytest.mark.parametrize("ignore", [True, False])
def test_one_row_a_month(spark, ignore):
    rng, rows = random.Random(5), []
    for account in [*range(25), None]:
        for i in range(rng.choice([0, 1, 2, 8, 14])):
            amount = float(rng.choice([100, 100, 104, 120, 60, 180, 135, 131]))
            rows.append((account, i, DAY + timedelta(days=rng.randrange(240)), amount, rng.random() < 0.7))
    rows += [(1, 100, None, 5.0, True), (2, 100, DAY, None, True)]
    df = spark.createDataFrame(rows, "k int, seq int, date timestamp, amount double, paid boolean")
    months = salary.account_months(df, "k")
    got: dict = {}
    for r in salary.one_per_month(df.where("paid"), "k", ["date", "seq"], months, 0.4, ignore).collect():
        assert r["salary_month"] not in got.setdefault(r["k"], {})
        got[r["k"]][r["salary_month"]] = r["seq"]
    want = {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k and r[2] is not None]
        made = month_by_month([(r[2], r[1], r[3]) for r in own if r[4] and r[3] is not None], {r[2].strftime("%Y-%m") for r in own}, 0.4, ignore)
        want |= {k: made} if made else {}
    assert {k: v for k, v in got.items() if k is not None} == {k: v for k, v in want.items() if k is not None}


def test_what_is_known_of_salaries(spark):
    rows = []

    def add(key, note, channel="neft", days=(), amount=30_000.0, kind="credit"):
        for i, d in enumerate(days):
            rows.append((key, len(rows), DAY + timedelta(days=d), kind, amount + i, channel, note))

    months = [30 * i + 25 for i in range(8)]
    for key in range(1, 9):
        add(key, "groceries of the town", "pos", months[4:] if key in (4, 5) else [*months, 3], 200.0, "debit")
    add(1, "NEFT ACME PVT LTD wages", days=months)  # the employer
    add(2, "monthly pay", "salary", months[:5])  # a keyword
    add(3, "NEFT orange lane industries", days=[30 * i + 26 for i in range(8)])  # recurring
    add(4, "NEFT orange lane industries", days=[30 * i + 26 for i in (6, 7)])  # two credits a month apart
    add(5, "orange lane gifts", days=[30 * i + 26 for i in (6, 7)])  # two of no company
    add(6, "UPI orange lane industries", days=months)  # by upi
    add(7, "NEFT orange lane industries", days=months, amount=900.0)  # too small
    add(8, "NEFT orange lane industries", days=months)
    add(8, "NEFT orange lane industries", days=[1, 40, 80], amount=50.0, kind="debit")  # three debits to the same
    df = spark.createDataFrame(rows, "k int, seq int, date timestamp, transaction_type string, amount double, transaction_channel string, transaction_note string")
    out, summary = salary.salaries(df, "k", ["date", "seq"], F.col("transaction_note").contains("ACME"))
    known = {r["k"]: r for r in summary.collect()}
    assert {k: r["method"] for k, r in known.items()} == {1: "employer_name", 2: "keyword", 3: "recurring", 4: "recurring"}
    assert known[1]["confidence"] == known[2]["confidence"] == 100 and known[1]["months"] == 8 and known[2]["months"] == 5
    assert known[3]["months"] == 8 and known[3]["latest_amount"] == 30_007.0 and abs(known[3]["mean_month"] - 30_003.5) < 1e-6
    assert known[3]["confidence"] > known[4]["confidence"] >= 70
    assert {r["k"] for r in out.collect()} == {1, 2, 3, 4} and out.columns == [*df.columns, "salary_month", "method"]
    nothing, none = salary.salaries(df.limit(0), "k", ["date", "seq"], F.lit(False))
    assert nothing.collect() == [] and none.collect() == []
