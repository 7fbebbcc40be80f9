"""Benchmark decontamination by winnowing.

Both sides keep, of every run of WINDOW consecutive K-word grams, the one with the least
hash. A passage of K + WINDOW - 1 = 13 shared words holds such a run, so both sides keep a
gram of it: every shared window is found. Kept grams are joined by the hash of the gram
with half of the words that a match needs beside it, and each meeting is extended word by word; words of runs of 13 or more are hit. Items of fewer words are
one window of their own length m: for each such m there is a second fingerprint with
K = m and a run of one, which keeps every gram.

Only grams that may be in the benchmark leave the scan of the documents: a bitmap of
fixed size (BITS) holds the benchmark's hashes, whatever its number of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm import textbytes
from tallyloom.llm.runtime import cut

SPAN = 13
K = 5
WINDOW = SPAN - K + 1
#: Bits of the broadcast bitmap: 8 MB.
BITS = 1 << 26
_BUCKET = 8 * 4096

_FINGERPRINTS = "array<struct<hash:bigint,need:int,pos:int,left:int,words:string>>"


def _kept(words: np.ndarray, text: np.ndarray, k: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that winnowing keeps."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(n, k * 1000 + run, np.uint64)
    for j in range(k):
        h = textbytes.mix(h + words[j : n + j] + np.uint64(j))
    inside = text[:n] == text[k - 1 :]
    keep = inside
    if run > 1:
        top = np.uint64(2**64 - 1)
        edge = np.full(run - 1, top)
        g = np.concatenate([edge, np.where(inside, h, top), edge])
        least = g[: n + run - 1].copy()
        for j in range(1, run):
            np.minimum(least, g[j : j + n + run - 1], out=least)
        most = least[:n].copy()  # the greatest minimum of the runs that hold a gram
        for j in range(1, run):
            np.maximum(most, least[j : j + n], out=most)
        keep = inside & (most == h)
    at = np.flatnonzero(keep)
    return at, h[at]


def _fingerprints(texts: list[str | None], shapes: list[tuple[int, int, int]], bits: np.ndarray | None) -> Iterator[tuple[int, list[tuple], int]]:
    """Words of each text and its kept grams, those in the bitmap if there is one.

    shapes: (least words of a match, gram length, run). A gram comes with the words a
    match through it can need: SPAN - K before it and after it.
    """
    for first, last, data, starts in textbytes.blocks(texts, 1):
        at, to, h, text = textbytes.words(data, starts)
        counts = np.bincount(text, minlength=last - first)
        begin = np.concatenate([[0], np.cumsum(counts)])
        rows: list[list[tuple]] = [[] for _ in range(last - first)]
        for need, k, run in shapes:
            pos, gram = _kept(h, text, k, run)
            if bits is not None:
                place = gram % np.uint64(BITS)
                found = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
                pos, gram = pos[found == 1], gram[found == 1]
            reach = need - k
            for p, g in zip(pos.tolist(), gram.view(np.int64).tolist()):
                t = int(text[p])
                low, high = max(p - reach, int(begin[t])), min(p + need, int(begin[t + 1]))
                near = b" ".join([data[a:b].tobytes() for a, b in zip(at[low:high], to[low:high])])
                rows[t].append((g, need, p - int(begin[t]), p - low, near.decode("utf-8", "replace")))
        for i in range(last - first):
            yield first + i, rows[i], int(counts[i])


def _scan(df: DataFrame, shapes: list[tuple[int, int, int]], id_col: str, text_col: str, bits=None) -> DataFrame:
    """id, key (of the text), n_words and fingerprints of each row."""
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            out = list(_fingerprints(batch["text"].tolist(), shapes, table))
            yield pd.DataFrame({"id": batch["id"], "key": batch["key"], "n_words": [o[2] for o in out], "fingerprints": [o[1] for o in out]})

    given = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return given.mapInPandas(run, f"id {id_type}, key long, n_words long, fingerprints {_FINGERPRINTS}")


def _bitmap(prints: DataFrame):
    """The hashes' places as a broadcast bitmap of BITS bits."""
    place = F.pmod(F.col("hash"), F.lit(BITS))  # the same as unsigned: BITS is a power of two
    rows = (
        prints.select(place.alias("place"))
        .groupBy(F.expr(f"cast(place div {_BUCKET} as int)").alias("bucket"))
        .agg(F.bitmap_construct_agg((F.col("place") % _BUCKET).cast("long")).alias("bits"))
        .collect()  # BITS / _BUCKET rows of 4 KB at most
    )
    table = np.zeros(BITS // 8, np.uint8)
    for bucket, bits in rows:
        table[bucket * 4096 : bucket * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    return prints.sparkSession.sparkContext.broadcast(table.tobytes())


def _run(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    miss = F.array_position(same, False)
    return F.when(miss > 0, miss - 1).otherwise(F.size(same).cast("long"))


def _longer(prints: DataFrame, words: str, left: str) -> DataFrame:
    """prints with longer: hashes of each gram with the words that half of a match needs, before it and after it.

    A gram that the benchmark holds in very many contexts meets only those that agree in so
    many words. Grams that are whole items have their own hash.
    """
    held, half = F.split(words, " "), (SPAN - K) // 2

    def name(side: str, start: Column, size: int) -> Column:
        return F.xxhash64(F.lit(side), F.array_join(F.slice(held, start, F.lit(size)), " "))

    whole = F.when(F.col("need") < SPAN, F.col("hash"))
    before = F.when((F.col("need") == SPAN) & (F.col(left) >= half), name("before", F.col(left) - half + 1, K + half))
    after = F.when((F.col("need") == SPAN) & (F.size(held) - F.col(left) >= K + half), name("after", F.col(left) + 1, K + half))
    return prints.withColumn("longer", F.explode(F.array_compact(F.array(whole, before, after)))).drop("hash")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row: how many of its words stand in benchmark windows.

    Words are runs of letters, digits and characters past ASCII, A-Z lower-cased. Columns:
    id, key (hash of the text, so that rows which share an id stay apart), n_words, n_hit,
    items (ids as strings, sorted). Null and empty texts have no words and no hits; items
    without words match nothing; an empty benchmark hits nothing; the words of an item with a
    null id are hit, but there is no id to list. Repeated items are each
    listed; rows of one id and one text give equal rows. Other columns are not read.
    """
    plain = _scan(benchmark, [], item_col, item_text_col).select("n_words").distinct()
    lengths = sorted(r[0] for r in plain.where(F.col("n_words").between(1, SPAN - 1)).collect())  # 12 values at most
    shapes = [(SPAN, K, WINDOW), *((m, m, 1) for m in lengths)]
    items = _scan(benchmark, shapes, item_col, item_text_col).select(F.col("id").cast("string").alias("item"), "n_words", F.explode("fingerprints").alias("f"))
    # an item of m < 13 words is matched by its own window alone
    items = cut(items.where(F.col("f.need") == F.least(F.col("n_words"), F.lit(SPAN))).select("item", "f.*"), "benchmark")
    scanned = cut(_scan(docs, shapes, id_col, text_col, _bitmap(items)), "fingerprints")

    found = scanned.where(F.size("fingerprints") > 0).select("id", "key", F.explode("fingerprints").alias("f")).select("id", "key", "f.*")
    # items that share a gram with the words about it are one list; a document meets the list, not its items
    listed = items.groupBy("hash", "need", F.col("left").alias("item_left"), F.col("words").alias("item_words")).agg(F.array_sort(F.collect_set("item")).alias("held"))
    listed = cut(listed.withColumn("list", F.sha2(F.to_json("held"), 256)), "lists")
    # a match through a gram holds SPAN - K = 8 words beside it, so half of these on one side: the sides agree on 9 words
    met = _longer(found, "words", "left").join(_longer(listed.drop("held"), "item_words", "item_left"), ["longer", "need"])
    a, b = F.split("words", " "), F.split("item_words", " ")
    before = _run(F.reverse(F.slice(a, F.lit(1), F.col("left"))), F.reverse(F.slice(b, F.lit(1), F.col("item_left"))))
    after = _run(F.slice(a, F.col("left") + 1, F.size(a)), F.slice(b, F.col("item_left") + 1, F.size(b)))
    runs = met.select("id", "key", "list", "need", (F.col("pos") - before).alias("a"), (F.col("pos") + after).alias("b")).where(F.col("b") - F.col("a") >= F.col("need"))
    spans, lists = F.array_sort(F.collect_set(F.struct("a", "b"))), F.array_sort(F.collect_set("list"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(
        "spans",
        start,
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("n"), F.greatest(s["end"], x["b"]).alias("end")),
        lambda s: s["n"],
    )
    by_text = runs.groupBy("id", "key").agg(spans.alias("spans"), lists.alias("lists"))
    by_text = cut(by_text.select("id", "key", covered.alias("n_hit"), "lists", F.sha2(F.array_join("lists", ","), 256).alias("sets")), "hits")
    # items are gathered once for each combination of lists
    named = by_text.groupBy("sets").agg(F.first("lists").alias("lists")).select("sets", F.explode("lists").alias("list"))
    whole = named.join(listed.select("list", "held").dropDuplicates(["list"]), "list").groupBy("sets").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("held")))).alias("items"))
    hits = by_text.join(whole, "sets").select("id", "key", "n_hit", "items")

    base, hit = scanned.select("id", "key", "n_words").alias("d"), hits.alias("h")
    on = F.col("d.id").eqNullSafe(F.col("h.id")) & (F.col("d.key") == F.col("h.key"))
    return base.join(hit, on, "left").select(
        F.col("d.id").alias(id_col), F.col("d.key").alias("key"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def contaminated() -> Column:
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
