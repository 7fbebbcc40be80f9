"""Keyed stores: merge on read, replays, buckets that a batch touches; rules found by their literals."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators import channels, rules
from tallyloom.streaming import consumers
from tallyloom.streaming.stores import KeyedStore

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType()), T.StructField("note", T.StringType())])


def test_store_equals_a_dictionary(spark, tmp_path):
    rng, store, held = random.Random(1), KeyedStore(spark, f"file://{tmp_path}/s", "k", SCHEMA, buckets=4, merge_from=3), {}
    states = {}
    for epoch in range(9):
        rows = {rng.randrange(12): (epoch, rng.choice(["a", None])) for _ in range(rng.randrange(0, 5))}
        for again in range(2 if epoch in (4, 7) else 1):  # a batch that starts over
            given = rows if again == 0 else {**rows, 3: (epoch, "later")}
            store.write(spark.createDataFrame([(k, *v) for k, v in given.items()], SCHEMA), epoch)
            held = {**states.get(epoch - 1, {}), **given}
            store.merge(epoch, range(4))
        states[epoch] = held
        assert {r["k"]: (r["v"], r["note"]) for r in store.read().collect()} == held
        assert {r["k"]: (r["v"], r["note"]) for r in store.read(before=epoch).collect()} == states.get(epoch - 1, {})
        assert store.finished(epoch) and not store.finished(epoch + 1)
    assert any("upto=" in str(p) for p in tmp_path.rglob("*"))
    mine = store.buckets_of(spark.createDataFrame([(5,)], "k long"))
    assert len(mine) == 1 and {r["k"] for r in store.read(mine).collect()} == {k for k in held if store.buckets_of(spark.createDataFrame([(k,)], "k long")) == mine}


def test_a_batch_reads_its_own_buckets_whatever_the_table(spark, tmp_path):
    sizes = []
    for rows in (200, 2000):
        store = KeyedStore(spark, f"file://{tmp_path}/{rows}", "k", SCHEMA, buckets=20)
        store.write(spark.range(rows).select(F.col("id").alias("k"), F.col("id").alias("v"), F.lit("x").alias("note")), 0)
        batch = spark.createDataFrame([(7, 1, "new"), (rows + 1, 1, "new")], SCHEMA)
        mine = store.buckets_of(batch)
        assert len(mine) <= 2 and len(store.read(mine, before=1).inputFiles()) == len(mine)
        consumers.latest_each(store, "v")(batch.withColumn("v", F.lit(10**6).cast("long")), 1)
        written = [p for p in Path(f"{tmp_path}/{rows}/deltas/epoch=1").rglob("*.parquet")]
        sizes.append((len(written), sum(p.stat().st_size for p in written)))
        assert store.read().count() == rows + 1 and store.read().where("k = 7").first()["note"] == "new"
        consumers.once_each(store)(batch, 2)
        assert store.read().where("v = 1000000").count() == 2 and store.read().count() == rows + 1
    assert sizes[0] == sizes[1]  # the work of a batch does not grow with the table


def test_rules_by_literal(spark):
    table = [(3, "acme", r"ACME\s+(PVT|LTD)", "ACME"), (1, "acme pvt", r"(?i)acme pvt", "ACME"), (2, "digits", r"[0-9]{4}", None), (9, "bob", "^BOB", "BOB")]
    texts = ["ACME LTD 7", "acme pvt", "ACMELTD", "x 1234 ACME LTD", "BOB", "no bob", None, "", "BOB"]
    given = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rules.first_by_literal(given, "t", spark.createDataFrame(table, "place int, label string, pattern string, literal string"))
    want = ["acme", "acme pvt", None, "digits", "bob", None, None, None, "bob"]
    assert found.columns == ["t", "label"] and sorted(map(str, found.collect())) == sorted(str(r) for r in spark.createDataFrame(list(zip(texts, want)), "t string, label string").collect())


@pytest.mark.parametrize("share", [1, 7, 50])
def test_rules_of_words_that_most_texts_share(spark, share):
    """Frequent words without a rule, with one and with several, and rules that every text meets, are the same however they are dealt out."""
    texts = [f"{'UPI' if i % 3 else 'neft'}/CUSTOMER/{i:03d}" for i in range(120)] + ["UPI", "", "alone 7"]
    table = [(i, f"own {i}", f"/{i:03d}$", f"{i:03d}") for i in range(0, 120, 5)] + [(500, "even", "UPI.*[02468]$", "UPI"), (400, "four", "UPI.*4$", "UPI"), (600, "nine", "9$", None), (-1, "alone", "^alone", None)]
    given = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    found = rules.first_by_literal(given, "t", spark.createDataFrame(table, "place int, label string, pattern string, literal string"), share=share)
    want = {t: next((label for _, label, pattern, _ in sorted(table, key=lambda r: r[0]) if re.search(pattern, t)), None) for t in texts}
    assert {r["t"]: r["label"] for r in found.collect()} == want and {"four", "even", "nine", "alone", None} < set(want.values())


@pytest.mark.parametrize(("note", "amount", "category", "country", "want"), [("MIN BAL", 60_000.0, None, "IN", "Other"), ("MIN BAL", 60_000.0, None, "ID", "bank_charge"), ("CC INTEREST", 9.0, "overdraft", "IN", "cc_interest"), ("CC INTEREST", 9.0, "individual", "IN", "Other"), ("WAGES", 9_000.0, "individual", "IN", "Other"), ("WAGES", 9_000.0, None, None, "salary_paid"), ("AN ACH-7", 9.0, None, None, "auto_debit"), ("TEACHER", 9.0, None, None, "Other")])
def test_every_guard_of_an_account_decides(spark, note, amount, category, country, want):
    row = spark.createDataFrame([("debit", amount, note, category, country)], "transaction_type string, amount double, transaction_note string, category string, country string")
    debit = [("salary_paid", ["WAGES"]), ("auto_debit", ["ACH"]), ("bank_charge", ["MIN BAL"]), ("cc_interest", ["CC INTEREST"])]
    assert channels.channel(row, debit, [], [], [], [], F.col("category"), F.col("country")).first()["transaction_channel"] == want
