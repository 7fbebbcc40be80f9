"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, hard_negatives, language_id, license_index, near_vectors, ngram_join, packing, resample, runtime, shards, token_counts, token_store, toxicity, url_filter

#: Score from which a document counts as toxic.
TOXIC = 0.7


#: The URL rules: verdict, rule.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Rows in an arriving shard, and the size that compaction aims at.
SHARD_ROWS, TARGET_BYTES = 2048, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors.link_counts(table(spark, sf_dir, "embeddings"), least=0.98)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), url_filter.rule_table(spark, URL_RULES))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runtime.new_path(spark, "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    token_store.write_token_store(table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=2, parts=parts)
    return token_store.read_token_store(spark, out)


def op4_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = shards.ShardedTable(spark, runtime.new_path(spark, "shards"), target_bytes=TARGET_BYTES)
    shared.append(table(spark, sf_dir, "documents"), rows_per_shard=SHARD_ROWS)
    shared.compact()
    return shared.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.fold("doc_id", 4, 2)
    found = language_id.identify(docs, language_id.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(table(spark, sf_dir, "documents"), ngram_join.Rule(k=3, share=90, over=100))
    return found.select("doc_id", "n_shingles", "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = toxicity.fold("doc_id", 3, 1)
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=2048)


def op11_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_index.scan(table(spark, sf_dir, "documents"), license_index.BASE + license_index.STATEMENTS)
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        license_index.labels(base).alias("base_labels"),
        license_index.labels(F.col("places")).alias("labels"),
        license_index.coverage(F.col("places")).alias("score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mining = hard_negatives.Mining(positives=5, negatives=5, low=80, high=100, over=100, scale=256)
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, mining)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = resample.Draw(least_n=1, most_n=1, buckets=10_000, seed=2024, least_words=20, percent=10)
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), draw)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_grid_order_join,
        op2_url_filter,
        op3_token_store,
        op4_tiered_shards,
        op5_winnowing,
        op6_language_id,
        op7_token_counts,
        op8_jaccard_join,
        op9_toxicity,
        op10_best_fit_packing,
        op11_license_index,
        op12_hard_negatives,
        op13_importance_resampling,
    )
}
