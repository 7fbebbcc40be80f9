"""Rule tables: priority classifiers, level-by-level lookups, account rules, patches and page merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import similarity


def classify(df: DataFrame, rules: Sequence[tuple[str, str]], text: str, out: str, otherwise: str = "Other") -> DataFrame:
    """The label of the first (label, pattern) rule, in their order, that matches text.

    The rules are code, so they become one expression and the rows do not move.
    """
    found = [F.when(F.col(text).rlike(f"(?i){pattern}"), F.lit(label)) for label, pattern in rules]
    return df.withColumn(out, F.coalesce(*found, F.lit(otherwise)))


def lookup_levels(df: DataFrame, mapping: DataFrame, levels: Sequence[Sequence[str]], value: str, out: str, otherwise: str) -> DataFrame:
    """The value of the first level of keys that the mapping knows.

    mapping: columns level (place in levels), the key columns (null where unused) and value.
    Each level is one join on its keys; repeated keys take the least value.
    """
    found = []
    for k, keys in enumerate(levels):
        name = f"_level{k}"
        side = mapping.where(F.col("level") == k).groupBy(*keys).agg(F.min(value).alias(name))
        df = df.join(side, list(keys), "left")
        found.append(F.col(name))
    return df.withColumn(out, F.coalesce(*found, F.lit(otherwise))).drop(*[f"_level{k}" for k in range(len(levels))])


def join_continuations(df: DataFrame, is_row: Column, text: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Texts of rows that continue another are appended to it; rows before the first real one go."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumn("_row", F.sum(is_row.cast("int")).over(w)).where(F.col("_row") > 0)
    parts = F.array_sort(F.collect_list(F.struct(*order, text)))
    return numbered.groupBy(*keys, "_row").agg(F.min(F.struct(*order)).alias("_first"), F.array_join(F.transform(parts, lambda p: p[text]), " ").alias(text)).select(*keys, "_first.*", text)


def findings(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """One row for each rule that holds on a row: finding and key."""
    labels = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return df.select(F.explode(labels).alias("finding"), key)


def daily_over(df: DataFrame, keys: Sequence[str], date: str, value: Column, limit: float, finding: str) -> DataFrame:
    """Days of a key on which value adds up to more than limit."""
    return df.groupBy(*keys, F.to_date(date).alias("day")).agg(F.sum(value).alias("_s")).where(F.col("_s") > limit).select(*keys, "day", F.lit(finding).alias("finding"))


def apply_patches(df: DataFrame, patches: DataFrame, key: str, columns: Sequence[str], order: str) -> DataFrame:
    """Columns overwritten by patches (key, order, column, value): of several the last counts."""
    last = patches.groupBy(key, "column").agg(F.max_by("value", order).alias("value"))
    wide = last.groupBy(key).pivot("column", list(columns)).agg(F.first("value")).withColumnsRenamed({c: f"_p_{c}" for c in columns})
    joined = df.join(wide, key, "left")
    types = dict(df.dtypes)
    return joined.withColumns({c: F.coalesce(F.col(f"_p_{c}").cast(types[c]), F.col(c)) for c in columns}).drop(*[f"_p_{c}" for c in columns])


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows replaced by incoming ones of the same key, and the new ones added."""
    return stored.join(incoming, key, "left_anti").unionByName(incoming)


def merge_pages(df: DataFrame, key: str) -> DataFrame:
    """Flags, counts and ranges of a document's pages as one row."""
    return df.groupBy(key).agg(F.bool_or("flag").alias("flag"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.flatten(F.collect_list("tags"))).alias("tags"))


def keyword_categories(df: DataFrame, regexes: Sequence[tuple[str, str]], keywords: Sequence[tuple[str, Sequence[str]]], note: str, out: str, only: Mapping[str, str], skip: Sequence[str], unless: Mapping[str, Sequence[str]], default: Mapping[str, str], least: float = 90.0) -> DataFrame:
    """The category of the first regex that matches, else of the first keyword that scores above least, else ''.

    only: the one transaction type of a category; skip: channels without a category;
    unless: words that stand in a longer note and rule a category out; default: categories
    of channels whose notes match nothing.
    """
    kind, channel = F.col("transaction_type"), F.col("transaction_channel")
    fits = lambda name: (kind == only[name]) if name in only else F.lit(True)
    by_regex = F.coalesce(*[F.when(F.col(note).rlike(f"(?i){pattern}") & fits(name), F.lit(name)) for name, pattern in regexes], F.lit(""))

    @F.pandas_udf("string")
    def by_keyword(texts: pd.Series, types: pd.Series) -> pd.Series:
        def one(text: str | None, type_: str | None) -> str:
            if text is None:
                return ""
            for name, words in keywords:
                if only.get(name, type_) == type_ and not any(len(text) > len(w) and w in text for w in unless.get(name, ())):
                    if any(similarity.contained(w, text, least) for w in words):
                        return name
            return ""

        return pd.Series([one(x, y) for x, y in zip(texts, types)], dtype=object)

    bare = F.lower(F.regexp_replace(F.regexp_replace(note, r"[^\x00-\x7F]", ""), " ", ""))
    skipped = F.coalesce(channel.isin(*skip), F.lit(False))
    marked = df.withColumn("_regex", F.when(~skipped, by_regex)).withColumn("_word", by_keyword(F.when(F.col("_regex") == "", bare), kind))
    usual = F.coalesce(*[F.when(channel == c, F.lit(name)) for c, name in default.items()], F.lit(""))
    return marked.withColumn(out, F.when(skipped, "").when(F.col("_regex") != "", F.col("_regex")).when(F.col("_word") != "", F.col("_word")).otherwise(usual)).drop("_regex", "_word")


def first_by_literal(df: DataFrame, text: str, rules: DataFrame, out: str = "label", share: int = 100_000) -> DataFrame:
    """df with out: the label of the first rule whose pattern fits the text, null where none does; for rule tables of any size.

    rules: place (the order of trial), label, pattern and literal, an upper-case word that
    stands as a whole word in every text that the pattern fits (null where there is none).
    A text's words fetch the rules of their literals, so only these patterns run on it; rules
    without a literal meet every text. Each different text is judged once. Null texts fit nothing.
    A word of more than share texts goes no further if no rule has it; else its texts are dealt
    out in shares, and its rules are copied to each, so no task holds all texts of one word.
    """
    ruled = rules.withColumn("_word", F.coalesce(F.col("literal"), F.lit("")))
    texts = df.select(F.col(text).alias("_text")).where(F.col(text).isNotNull()).distinct()
    words = F.array_distinct(F.concat(F.split(F.upper("_text"), "[^0-9A-Z]+"), F.array(F.lit(""))))
    said = texts.select("_text", F.explode(words).alias("_word"))
    # only words of more than share texts: few enough to be sent to every task
    often = said.groupBy("_word").agg(F.count("*").alias("_n")).where(F.col("_n") > share).select("_word", F.ceil(F.col("_n") / share).cast("int").alias("_parts"))
    asked = ruled.join(F.broadcast(often), "_word", "left_semi").select("_word").distinct().withColumn("_asked", F.lit(True))
    often = often.join(asked, "_word", "left")
    parts = F.coalesce("_parts", F.lit(1))
    dealt = said.join(F.broadcast(often), "_word", "left").where("_parts IS NULL OR _asked").select("_text", "_word", F.pmod(F.xxhash64("_text"), parts).cast("int").alias("_part"))
    copied = ruled.join(F.broadcast(often), "_word", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = dealt.join(copied, ["_word", "_part"]).where(F.expr("rlike(_text, pattern)"))
    first = met.groupBy("_text").agg(F.min(F.struct("place", "label")).alias("_first"))
    return df.join(first, F.col(text) == F.col("_text"), "left").withColumn(out, F.col("_first.label")).drop("_text", "_first")
