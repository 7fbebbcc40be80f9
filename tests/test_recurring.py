"""Recurring groups against the greedy pass over all rows."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta
from functools import cache

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import recurring, similarity
from tallyloom.plans import QUERIES
from tallyloom.plans.features import NOTED
from tallyloom.plans.registry import worn

STOP, HANDLES = set(recurring.STOP), set(recurring.HANDLES)


def cleaned(note, channel):
    out = []
    for w in re.split(r"[ /:\-,;.]", (note or "").lower()):
        if w in STOP:
            continue
        if channel != "upi":
            w = w.replace("x", "") if re.search(r"[x*]+[0-9]", w) else re.sub("[0-9]", "", w)
        elif "@" in w and w.split("@")[1] in HANDLES:
            w = w.split("@")[0]
        else:
            number = re.search("[0-9]+", w)
            if not (number and len(number[0]) == 10):
                w = w.replace(number[0], "") if number else w
                w = "" if len(re.sub("[^0-9]", "", w)) >= 2 else w
        if len(w) >= 3 and w not in STOP:
            out.append(w)
    return " ".join(out)


def joins(a, b):
    """The tiers, written out; a and b are (channel, note, merchant)."""
    if not (a[0] == b[0] or "salary" in (a[0], b[0])):
        return False
    m, n = len(a[1]), len(b[1])
    names = len(a[2]) > 10 and len(b[2]) > 10
    if m <= 2 or n <= 2 or not (abs(m - n) < 10 or names):
        return False
    s = max(similarity.partial_token_sort(a[1], b[1]), similarity.indel(a[1], b[1]), similarity.token_set(a[1], b[1]))
    tiers = [s > 93 and abs(m - n) < 10, s > 73 and min(m, n) > 35, s > 60 and min(m, n) > 50, s > 87 and min(m, n) > 10, s >= 78 and min(m, n) >= 20]
    return any(tiers) or len(a[2]) >= 8 and len(b[2]) >= 8 and similarity.weighted(a[2], b[2]) >= 90


def shared(a, b):
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a[1], b[1]))
    return bool(x and y) and len(x & y) >= 0.6 * len(x | y) - 1e-9


def greedy(rows, limit, rule=joins):
    """rows: (key, order, note, channel, merchant) -> {(key, order): (group_no, size)}."""
    out, by_key = {}, {}
    for r in rows:
        by_key.setdefault(r[0], []).append((r[1], (r[3] or "", cleaned(r[2], r[3] or ""), r[4] or "")))
    for key, held in by_key.items():
        large = len(held) > limit
        held.sort(key=lambda h: h[0])
        order = sorted(held, key=lambda h: (h[1][0], h[1][1]), reverse=True) if large else held
        match, groups = shared if large else rule, []
        for place, sig in order:
            if len(sig[1]) <= 2:
                continue
            for g in groups:
                if match(g[0], sig):
                    g[1].append(place)
                    break
            else:
                groups.append((sig, [place]))
        named = sorted((g for g in groups if len(g[1]) > 1), key=lambda g: (-len(g[1]), min(g[1])))
        for k, g in enumerate(named):
            out |= {(key, p): (k + 1, len(g[1])) for p in g[1]}
    return out


def notes(rng, n):
    words = "orange market lane policy premium tower garden holder supplies western river school clinic".split()
    bases = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 6, 9]))) for _ in range(14)]
    for _ in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            t[rng.randrange(len(t))] = rng.choice("abxyz ")
        yield rng.choice(["NEFT/{}/12", "{}", "{} {}77", "upi/{}@ybl"]).format("".join(t), "ref")


@pytest.mark.parametrize("probes", [1, 4])
def test_groups_equal_the_greedy_pass(spark, monkeypatch, probes):
    monkeypatch.setattr(recurring.first_matches, "__defaults__", (0.6, probes))
    rng = random.Random(probes)
    rows = []
    for key, n in (("small", 70), ("other", 40), (None, 30), ("hot", 400)):
        for i, note in enumerate(notes(rng, n)):
            rows.append((key, i, note, rng.choice(["upi", "neft", "neft", "salary", None]), rng.choice([None, "", "western stores", "western stores ltd", "river clinic of the town"])))
        rows += [(key, n, None, "neft", None), (key, n + 1, "a b", "neft", "western stores"), (key, n + 2, "pay 12", "neft", None), (key, n + 3, "pay 12", "neft", None)]
    rows += [("hot", 1000 + i, "orange market lane", "neft", None) for i in range(200)]
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(k, start + timedelta(days=i // 3), i, n, c, m, 1) for k, i, n, c, m in rows], "k string, date timestamp, seq long, note string, channel string, merchant string, key int")
    found = recurring.recurring_groups(df, ["k"], ["date", "seq"], "note", "channel", F.col("merchant"), limit=80)
    assert found.columns == [*df.columns, "group_no", "group_size"]
    got = {(r["k"], r["seq"]): (r["group_no"], r["group_size"]) for r in found.collect()}
    want = greedy(rows, 80)
    assert len(got) == len(rows) and {k: v for k, v in got.items() if v != (None, None)} == want
    assert {k for k, _ in want} == {"small", "other", None, "hot"}
    top = recurring.top_group(found).collect()
    assert sorted(str((r["k"], r["seq"])) for r in top) == sorted(str(k) for k, v in want.items() if v[0] == 1)


def test_every_tier_decides_some_pair():
    long = "instalment of the yearly household premium of class one for"
    cases = [
        (("n", "abcdefgh", ""), ("n", "abcdefgh", "")),
        (("n", long, ""), ("n", long.replace("household", "business xy").replace("yearly", "w"), "")),
        (("n", long[:40], ""), ("n", long[:32] + "zzqqxxyy", "")),
        (("n", "orange market", ""), ("n", "orange markez", "")),
        (("n", "orange market of lane", ""), ("n", "orange market mx lxyz", "")),
        (("n", "abc", "western stores ltd"), ("n", "xyzw", "western stores lt")),
        (("salary", "orange lane", ""), ("n", "orange lane", "")),
    ]
    assert all(joins(a, b) and recurring.tiered(a, b) for a, b in cases)
    other = [(("n", "orange", ""), ("m", "orange", "")), (("n", "ab", ""), ("n", "ab", "")), (("n", "orange", ""), ("n", "orange market of lane x", "")), (("n", "orange", ""), ("n", "yellow", ""))]
    assert not any(joins(a, b) or recurring.tiered(a, b) for a, b in other)
    assert recurring.alike(80)(("n", "orange lane", ""), ("n", "orange lann", "")) and not recurring.alike(99)(("n", "orange lane", ""), ("n", "orange lann", ""))


def test_clean_notes(spark):
    cases = [("NEFT/ACME xxxx123*4 Ltd-ab,99", "neft"), ("UPI/joe77@okaxis/9876543210/a1b2c3d/x12y", "upi"), ("upi-joe@bank-12ab", "upi"), (None, "upi"), ("pay", "neft"), ("joe@", "upi"), ("*9 **12ab", "neft")]
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n string, c string").select("i", recurring.clean_note(F.col("n"), F.col("c")).alias("t")).collect()
    assert [r["t"] for r in sorted(got)] == [cleaned(*c) for c in cases]


def test_empty_frames(spark):
    none = spark.createDataFrame([], "k string, seq long, note string, channel string")
    assert recurring.recurring_groups(none, ["k"], ["seq"], "note", "channel").collect() == []


@cache
def by_threshold(a, b):
    return (a[0] == b[0] or "salary" in (a[0], b[0])) and similarity.fuzzy(a[1], b[1]) >= 90


def test_top_groups_of_an_account_of_many_rows(spark, tmp_path):
    """One rule at any size: an account with more than 1,000 rows of a type is grouped as a small one."""
    sf = "/root/testdata/sf0.01"
    spark.read.parquet(f"{sf}/customer.parquet").where("c_custkey = 7").write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_custkey", F.lit(7).cast("long")).orderBy("o_orderkey").limit(3600).write.parquet(f"{tmp_path}/orders.parquet")
    rows = worn(spark, str(tmp_path), NOTED).collect()
    given = [((r["account_id"], r["transaction_type"]), (r["date"], r["seq"]), r["transaction_note"], r["transaction_channel"], None) for r in rows]
    assert min(sum(1 for g in given if g[0][1] == t) for t in ("debit", "credit")) > recurring.LIMIT
    want = greedy(given, len(given), by_threshold)
    got = QUERIES["clu_3_top_groups"](spark, str(tmp_path)).collect()
    assert got and {(r["seq"], r["group_size"]) for r in got} == {(p[1][1], v[1]) for p, v in want.items() if v[0] == 1}


@pytest.mark.parametrize("block, dealt", [(1, 3), (7, 10), (1000, 4096)])
def test_a_rule_without_a_limit_equals_the_greedy_pass(spark, monkeypatch, block, dealt):
    monkeypatch.setattr(recurring, "BLOCK", block)
    monkeypatch.setattr(recurring, "DEALT", dealt)
    rng, rows = random.Random(block), []
    for key, n in (("small", 5), (None, 12), ("hot", 30 if block == 1 else 300)):
        rows += [(key, i, note, rng.choice(["upi", "neft", "salary", None])) for i, note in enumerate(notes(rng, n))]
        rows += [(key, n, None, "neft"), (key, n + 1, "a b", "neft")]
    df = spark.createDataFrame(rows, "k string, seq long, note string, channel string")
    found = recurring.recurring_groups(df, ["k"], ["seq"], "note", "channel", rule=recurring.alike(90.0), limit=None).collect()
    want = greedy([(*r, None) for r in rows], len(rows), by_threshold)
    assert len(found) == len(rows) and {(r["k"], r["seq"]): (r["group_no"], r["group_size"]) for r in found if r["group_no"]} == want
