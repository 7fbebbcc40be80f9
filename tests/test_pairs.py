"""Pairs of rows over tables with many copies: texts are compared once, and every pair of rows comes out."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from tallyloom.operators import similarity
from tallyloom.plans import QUERIES


def parts(spark, folder, copies, names=("green ring", "green rings", "old plate")):
    """copies rows of each name, in one block, as the part table."""
    rows = spark.range(copies * len(names)).select(F.col("id").alias("p_partkey"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") % len(names) + 1).cast("int")).alias("p_name"))
    rows.withColumns({"p_brand": F.lit("Brand#1"), "p_type": F.lit("SMALL")}).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def counted(df, within=60):
    began = time.monotonic()
    n, wrong = df.agg(F.count("*"), F.count_if(F.col("a") >= F.col("b"))).first()
    assert wrong == 0 and time.monotonic() - began < within
    return n


def pairs(n, near=1):
    """Pairs of rows among three names of n rows each, of which so many pairs of names are near."""
    return 3 * n * (n - 1) // 2 + near * n * n


def test_minhash_pairs_of_copies(spark, tmp_path):
    assert counted(QUERIES["clu_1_minhash_pairs"](spark, parts(spark, tmp_path, 4000))) == pairs(4000)


def test_fuzzy_scores_of_copies(spark, tmp_path):
    assert counted(QUERIES["sca_23_fuzzy_scores"](spark, parts(spark, tmp_path, 4000))) == pairs(4000)


def test_similar_pairs_of_copies(spark, tmp_path):
    assert counted(QUERIES["clu_1_similar_pairs"](spark, parts(spark, tmp_path, 9000))) == pairs(9000)


def test_pairs_of_rows_in_small_chunks(spark):
    df = spark.createDataFrame([(k, "uv"[k % 2], ["ab", "abc", None][k % 3]) for k in range(40)], "k long, g string, t string")
    met = similarity.different_texts(df, "t", ["g"])
    got = similarity.pairs_of_rows(met.union(similarity.equal_texts(df, "t", ["g"])), df, "k", "t", ["g"], chunk=2).select("a", "b").collect()
    rows = [tuple(r) for r in df.collect() if r["t"] is not None]
    assert sorted(map(tuple, got)) == sorted((a, b) for a, g, _ in rows for b, h, _ in rows if g == h and a < b)


def test_alike_compares_texts_once(spark, tmp_path):
    folder = parts(spark, tmp_path, 30_000)
    assert similarity.different_texts(spark.read.parquet(f"{folder}/part.parquet"), "p_name", ["p_brand", "p_type"]).count() == 3
    assert counted(QUERIES["sca_23_24_alike"](spark, folder)) == pairs(30_000)
