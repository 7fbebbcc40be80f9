"""Repeated blocks, folded lists and merged statements against plain passes over lists."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import statements, windows
from tallyloom.operators.similarity import partial

DAY = datetime(2024, 1, 1)


def test_repeats_equal_the_quadratic_form():
    rng = random.Random(3)
    for trial in range(400):
        cells = [rng.randrange(1, 2 + trial % 5) for _ in range(rng.randrange(0, 14))]
        for _ in range(rng.randrange(3)):
            a = rng.randrange(len(cells) + 1)
            cells[a:a] = cells[max(0, a - rng.randrange(1, 6)) : a]
        want = windows.without_repeated_block(pd.DataFrame({"a": cells}), ["a"]).index.tolist()
        gone = {i + j for i, n in statements.repeats(cells) for j in range(n)}
        assert [i for i in range(len(cells)) if i not in gone] == want, cells


def test_blocks_that_repeat_go(spark):
    rows = [(k, i, c, "note" if c != 9 else None) for k, cells in ((1, [1, 2, 3, 2, 3, 4, 4, 5]), (None, [7, 7, 9, 9]), (2, [1]), (3, list(range(3000)) * 2)) for i, c in enumerate(cells)]
    df = spark.createDataFrame(rows, "k int, i int, c int, n string")
    got = statements.without_repeats(df, ["k"], ["i"], ["c", "n"]).collect()
    assert sorted((str(r["k"]), r["i"]) for r in got) == sorted([("1", i) for i in (0, 1, 2, 5, 7)] + [("None", 0), ("None", 2), ("2", 0)] + [("3", i) for i in range(3000)])
    lone = statements.without_repeats(df.where("k = 1"), ["k"], ["i"], ["c"], F.col("c") == 4).collect()
    assert sorted(r["i"] for r in lone) == [0, 1, 2, 5, 6, 7]
    assert statements.without_repeats(df.limit(0), ["k"], ["i"], ["c"]).collect() == []


def fold(rows):
    """rows: (account, list, place, date, amount, balance, type, note) -> ids (list, place) kept by account."""
    bare = lambda n: "".join(c for c in (n or "").lower() if c.isascii() and c.isalnum())

    def same(a, b):
        if (a[3].date(), *a[4:7]) != (b[3].date(), *b[4:7]):
            return False
        x, y = bare(a[7]), bare(b[7])
        return x == y or len(a[7] or "") >= 4 and len(b[7] or "") >= 4 and partial(x, y) >= 50

    out = {}
    for account in {r[0] for r in rows}:
        lists = {}
        for r in sorted((r for r in rows if r[0] == account), key=lambda r: (r[3], r[2])):
            lists.setdefault(r[1], []).append(r)
        kept = []
        for _, new in sorted(lists.items(), key=lambda x: (x[1][0][3], x[0])):
            drop = 0
            if kept and new[0][3] <= kept[-1][3]:
                if new[-1][3] <= kept[-1][3]:
                    continue
                for k, r in enumerate(kept):
                    m = min(3, len(new), len(kept) - k)
                    if r[3].date() == new[0][3].date() and all(same(kept[k + i], new[i]) for i in range(m)):
                        drop = len(kept) - k
                        break
            kept += new[drop:]
        out[account] = sorted((r[1], r[2]) for r in kept)
    return out


def test_lists_fold_into_accounts(spark):
    rng, rows = random.Random(8), []
    for account in (1, 2, 3, None):
        whole, day = [], 0
        for i in range(60):
            day += rng.choice([0, 0, 1, 3, 25 if i % 20 == 0 else 1])
            whole.append((DAY + timedelta(days=day, hours=rng.randrange(3)), rng.randrange(3), rng.randrange(4), rng.choice(["debit", "credit"]), rng.choice(["UPI/abc", "neft-12345", "x", None])))
        whole.sort(key=lambda r: r[0])
        spans = [(0, 20), (12, 30), (14, 16), (14, 18), (28, 45), (29, 31), (44, 47), (46, 60), (0, 20), (59, 60)]
        for number, (a, b) in enumerate(rng.sample(spans, 9)):
            for place, r in enumerate(whole[a:b]):
                note = r[4] if rng.random() < 0.8 else (r[4] or "") + "!"
                rows.append((account, number, a + place, *r[:4], note))
    df = spark.createDataFrame([(*r, "x") for r in rows], "account int, part int, place int, date timestamp, amount int, balance int, transaction_type string, transaction_note string, extra string")
    got = {}
    for r in statements.folded_lists(df, ["account"], "part", ["date", "place"]).collect():
        got.setdefault(r["account"], []).append((r["part"], r["place"]))
    want = fold(rows)
    assert {k: sorted(v) for k, v in got.items()} == want and sum(map(len, want.values())) < len(rows)
    assert statements.folded_lists(df.limit(0), ["account"], "part", ["date", "place"]).collect() == []


def distance(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
    return d[len(a), len(b)]


def test_edits():
    for a, b in (("", ""), ("kitten", "sitting"), ("abc", ""), ("flaw", "lawn")):
        assert statements.edits(a, b) == distance(a, b)


#: Rows are dicts: id, date, type, amount, balance, note, chq, page.
def alike(a, b):
    if any(a[c] != b[c] for c in ("date", "amount", "balance", "chq")):
        return False
    x, y = a["note"] or "", b["note"] or ""
    return x == y or round(100 * (1 - distance(x, y) / max(len(x), len(y))), 2) > 75


def repaired(rows):
    out, bad, turned = [], [], 0
    near = lambda x, y: abs(round(x, 2) - round(y, 2)) <= 0.1
    for i, r in enumerate(rows):
        r = dict(r, amount=abs(r["amount"]), changed=r["changed"] or r["amount"] < 0)
        if i:
            before = out[-1]["balance"]
            for kind, sign, value in (("credit", 1, r["balance"]), ("debit", -1, r["balance"]), ("debit", -1, -r["balance"]), ("credit", 1, -r["balance"])):
                if near(before + sign * r["amount"], value):
                    turned += value != r["balance"]
                    r = dict(r, type=kind, balance=value, changed=r["changed"] or kind != r["type"] or value != r["balance"])
                    break
            else:
                bad.append(i)
        out.append(r)
    undo = turned / len(rows) > 0.2 if len(rows) > 10 else turned > 2
    return ([dict(r) for r in rows] if undo else out), bad


def chunks_of(rows, bad):
    cuts = [0, *bad, len(rows)]
    return [rows[a:b] for a, b in zip(cuts, cuts[1:])]


def chained(rows, bad):
    order = sorted(enumerate(chunks_of(rows, bad)), key=lambda c: (c[1][0]["date"], c[1][-1]["date"], c[0]))
    out, held = [], None
    for _, rows in order:
        low, high = rows[0]["date"], rows[-1]["date"]
        if held:
            old, a, b = held
            if low > a and high < b and len(rows) < len(old) or low == a and high == b and len(rows) == len(old) and all(map(alike, old, rows)):
                continue
            if b >= low:
                k = next((k for k, r in enumerate(rows) if alike(old[-1], r)), None)
                if k is not None and k + 1 <= len(old) and all(map(alike, old[len(old) - k - 1 :], rows[: k + 1])):
                    rows = rows[k + 1 :]
            if not rows:
                continue
        held = rows, low, high
        out += rows
    return out


def thinned(rows):
    cells = [(i,) if len(r["note"] or "") < 3 else (r["date"], r["amount"], r["balance"], r["type"], r["note"]) for i, r in enumerate(rows)]
    number = {c: k for k, c in enumerate(dict.fromkeys(cells))}
    kept = windows.without_repeated_block(pd.DataFrame({"a": [number[c] for c in cells]}), ["a"]).index.tolist()
    return [rows[i] for i in kept]


def tallies(rows):
    def holds(r):
        return all(abs(round(round(a["balance"] + (b["amount"] if b["type"] != "debit" else -b["amount"]), 2) - round(b["balance"], 2), 9)) <= 0.1 for a, b in zip(r, r[1:]))

    first, last = rows[0]["date"], rows[-1]["date"]
    if first == last:
        return holds(rows) or holds(rows[::-1])
    return holds(rows if first < last else rows[::-1])


def solved(rows):
    if len(rows) <= 2:
        return rows, [], [rows]
    rows, bad = repaired(rows)
    if len(bad) > 0.15 * len(rows) and len(rows) > 20:
        return rows, bad, chunks_of(rows, bad)
    for _ in range(2):
        rows, bad = repaired(chained(rows, bad))
    parts = chunks_of(rows, bad)
    if not bad and tallies(thinned(rows)):
        rows = thinned(rows)
    return rows, bad, parts


def put_right(rows):
    """rows in the given order -> (ids and values in order, verdict)."""
    rows = [dict(r, changed=False) for r in rows]
    ways = [solved(rows), solved(rows[::-1])]
    back = len(ways[1][1]) < len(ways[0][1])
    out, bad, parts = ways[back]
    out = out[::-1] if back else out
    gaps = any((b[0]["date"].date() - a[-1]["date"].date()).days >= 1 for a, b in zip(parts, parts[1:]))
    ids = {r["id"] for r in out}
    pages = set() if bad else {r["page"] for r in rows if r["id"] not in ids} | {r["page"] for r in out if r["changed"]}
    show = lambda r: (r["id"], r["type"], round(r["amount"], 2), round(r["balance"], 2))
    verdict = (bool(bad), len(bad), [(p[0]["date"], p[-1]["date"]) for p in parts], bool(bad) and gaps, sorted(pages))
    return [show(r) for r in (rows if bad or len(rows) <= 2 else out)], verdict


def statement(rng, n):
    balance, day, out = 1000.0, 0, []
    for i in range(n):
        day += rng.choice([0, 1, 2])
        amount = round(rng.uniform(1, 300), 2)
        kind = rng.choice(["debit", "credit"])
        balance = round(balance + (amount if kind == "credit" else -amount), 2)
        out.append({"id": i, "date": DAY + timedelta(days=day), "type": kind, "amount": amount, "balance": balance, "note": f"upi/{rng.choice(['ann', 'bob'])} lane {i % 3}", "chq": rng.choice([None, "7"]), "page": i // 6})
    return out


def scenarios():
    rng, out = random.Random(4), []
    for kind in ("as it is", "types", "signs", "halves", "reversed", "missing", "hopeless", "hopeless day", "repeated", "copied", "contained", "one", "two", "same day", "sign storm", "short notes"):
        for n in (1,) if kind == "one" else (2,) if kind == "two" else (8, 26, 45):
            s = statement(rng, n)
            if kind == "types":
                s = [dict(r, type="debit" if r["type"] == "credit" else "credit") if i % 4 == 2 else r for i, r in enumerate(s)]
            elif kind == "signs":
                s = [dict(r, amount=-r["amount"] if i % 5 == 1 else r["amount"], balance=-r["balance"] if i == 3 else r["balance"]) for i, r in enumerate(s)]
            elif kind == "halves":
                s = s[n // 2 :] + s[: n // 2]
            elif kind == "reversed":
                s = s[::-1]
            elif kind == "missing":
                s = s[: n // 3] + s[n // 2 :]
            elif kind == "hopeless":
                s = [dict(r, balance=r["balance"] + 17 * (i % 3)) for i, r in enumerate(s)]
            elif kind == "hopeless day":
                s = [dict(r, date=DAY, balance=r["balance"] + 17 * (i % 3)) for i, r in enumerate(s)]
            elif kind == "repeated":
                s = s[: n // 2] + s[n // 2 - 3 : n // 2] + s[n // 2 :]
            elif kind == "copied":
                s = s[: n // 2] + s[n // 2 - 2 :]
            elif kind == "contained":
                s = s + s[n // 4 : n // 4 + 3]
            elif kind == "same day":
                s = [dict(r, date=DAY) for r in s[::-1]]
            elif kind == "sign storm":
                s = [dict(r, balance=-r["balance"] if i % 2 else r["balance"]) for i, r in enumerate(s)]
            elif kind == "short notes":
                s = [dict(r, note="ab") for r in s[:3] + s[2:]]
            out.append((f"{kind} {n}", [dict(r, id=i) for i, r in enumerate(s)]))
    return out


def given(spark, cases):
    rows = [(k, i, r["id"], r["date"], r["type"], r["amount"], r["balance"], r["note"], r["chq"], r["page"]) for k, s in cases for i, r in enumerate(s)]
    return spark.createDataFrame(rows, "k string, place int, id int, date timestamp, transaction_type string, amount double, balance double, transaction_note string, chq_num string, page_number int")


def test_merged_statements_are_put_right(spark):
    cases = scenarios()
    rows, verdicts = statements.merged_statements(given(spark, cases), "k", "place")
    got, said = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["_order"]):
        got.setdefault(r["k"], []).append((r["id"], r["transaction_type"], round(r["amount"], 2), round(r["balance"], 2)))
    for r in verdicts.collect():
        said[r["k"]] = (r["is_inconsistent"], r["breaks"], [tuple(x) for x in r["ranges"]], r["is_missing_data"], r["pages"])
    want = {k: put_right(s) for k, s in cases}
    for k, (out, verdict) in want.items():
        assert got[k] == out, k
        assert said[k] == verdict, k
    fixed = {k for k, (out, v) in want.items() if not v[0] and out != [(r["id"], r["type"], round(r["amount"], 2), round(r["balance"], 2)) for r in dict(cases)[k]]}
    assert {k.rsplit(" ", 1)[0] for k in fixed} >= {"types", "signs", "halves", "repeated", "copied"}
    assert any(v[0] and v[3] for _, v in want.values()) and any(v[0] and not v[3] for _, v in want.values())


def test_small_statements_go_in_one_pass_as_by_rounds(spark):
    cases = [(k, [dict(r, balance=None, note=None) if i == 5 else dict(r, date=None) if i == 9 and " 26" in k else r for i, r in enumerate(s)]) for k, s in scenarios()]
    df = given(spark, cases).withColumn("big", F.lit(2**53 + 1)).repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = []
        for small in (0, 30, 2000):
            rows, verdicts = statements.merged_statements(df, "k", "place", small=small)
            w = Window.partitionBy("k").orderBy("_order")
            found.append((sorted(map(str, rows.withColumn("_order", F.row_number().over(w)).collect())), sorted(map(str, verdicts.collect()))))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] == found[2] and len(found[0][1]) == len(cases)


def test_runs_over_many_batches(spark):
    rows = [(p, r, i) for p in ("a", "b") for r in range(5) for i in range(r + 1)]
    df = spark.createDataFrame(rows, "p string, r int, i int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        step = lambda state, held: ((state or 0) + 1, 1 if (state or 0) % 2 else 0)
        got = sorted(tuple(r) for r in statements.folded(df, "p", "r", ["i"], ["i"], step, number="n").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for p in ("a", "b"):
        kept = [(r, i) for q, r, i in rows if q == p and not (r % 2 and i == 0)]
        want += [(p, r, i, n) for n, (r, i) in enumerate(kept)]
    assert got == sorted(want)


def test_no_statements(spark):
    rows, verdicts = statements.merged_statements(given(spark, []), "k", "place")
    assert rows.collect() == [] and verdicts.collect() == []


@pytest.mark.parametrize(("before", "own", "cut"), [("abc", "cd", 1), ("abc", "bcd", 2), ("abc", "xc", 0), ("c", "abc", 0), ("abc", "d", 0)])
def test_overlap_of_two_chunks(before, own, cut):
    cell = lambda c: (f"note of {c}", DAY, ord(c), 0, None)
    assert statements.without_overlap([cell(c) for c in before], [cell(c) for c in own]) == cut
