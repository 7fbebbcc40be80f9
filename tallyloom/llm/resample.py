"""Importance resampling towards a target distribution, in Spark SQL functions alone.

The n-grams of every document and of every target text are hashed into BUCKETS buckets
(crc32 modulo). One grouped count over both sides gives each bucket's gain, the logarithm
of how much commoner it is in the target; a document's weight is the sum of its n-grams'
gains. Seeded Gumbel noise added to the weight makes the greatest scores a draw without
replacement, in proportion to the weights' exponentials. Ranks come from one distributed
sort: each task numbers its own rows and a table of one row a task says how many are before.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.runtime import cut, free

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of ASCII letters and digits and of all characters past ASCII.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Range of the noise's hash.
_HASHES = 1 << 32


@dataclass(frozen=True)
class Draw:
    """Parameters of a draw: n-gram sizes, buckets, seed of the noise, least words of a document that may be drawn, per cent drawn.

    The gain table has one row a bucket and is broadcast, so buckets bound it.
    """

    least_n: int = 1
    most_n: int = 1
    buckets: int = 10_000
    seed: int = 2024
    least_words: int = 20
    percent: int = 10

    def __post_init__(self) -> None:
        if not (1 <= self.least_n <= self.most_n and 1 <= self.buckets <= 1_000_000 and self.least_words >= 0 and 0 <= self.percent <= 100):
            raise ValueError("sizes ascend from 1, buckets are 1 to 1,000,000, per cent 0 to 100")


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none of a null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _features(held: Column, draw: Draw) -> Column:
    """All runs of least_n to most_n words, joined by one space, repeats kept."""
    if draw.most_n == 1:
        return held

    def of_size(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat_ws(" ", *[w[i + j] for j in range(n)]))  # slice would copy the whole array

    def runs(w: Column) -> Column:
        return F.concat(*[of_size(w, n) for n in range(draw.least_n, draw.most_n + 1)])

    return F.transform(F.array(held), runs)[0]  # a bound variable: the words are found once and not for each run


def _bucket(feature: Column, draw: Draw) -> Column:
    return (F.crc32(feature.cast("binary")) % draw.buckets).cast("int")


def _buckets(text: str, draw: Draw) -> Column:
    """The bucket of every feature of a text, repeats kept."""
    return F.transform(_features(words(F.col(f"`{text}`")), draw), lambda f: _bucket(f, draw))


def gains(docs: DataFrame, target: DataFrame, draw: Draw, text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """bucket, gain: one row for each bucket that holds an n-gram of either side.

    gain = floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of the counts
    s, t in the bucket and S, T in all. Counts cover all rows and are added up before they are
    shuffled, so a task sends at most one row a bucket and a very common n-gram is one of them.
    """
    return _gains(docs.select(_buckets(text_col, draw).alias("buckets")), target.select(_buckets(target_text_col, draw).alias("buckets")), draw)


def _gains(docs: DataFrame, target: DataFrame, draw: Draw) -> DataFrame:
    """As gains, of both sides' arrays of buckets."""

    def counted(frame: DataFrame, side: int) -> DataFrame:
        n = F.lit(1).cast("long")
        return frame.select(F.explode("buckets").alias("bucket")).select("bucket", (n * (1 - side)).alias("s"), (n * side).alias("t"))

    held = cut(counted(docs, 0).union(counted(target, 1)).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "counts")
    s, t = held.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(s + draw.buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(t + draw.buckets))
    return held.select("bucket", F.floor(1000.0 * F.log(up / down)).alias("gain"))


def noise(doc_id: Column, draw: Draw) -> Column:
    """floor of 1000 times Gumbel noise, from the first 32 bits of sha256(seed:id); a null id counts as empty."""
    text = F.concat(F.lit(f"{draw.seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / float(_HASHES))))


def resample(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:  # noqa: B008
    """One row per document: id, key, n_words, n_features, weight, score, rank.

    Of the N documents with at least least_words words the floor(percent * N / 100) with the
    greatest scores are drawn, ties to the smaller id; they are ranked from 1 in that order,
    the others have a null rank. key is a hash of the text, so that rows which share an id
    stay apart; rows equal in both are ranked each. Null and empty texts have no n-grams and
    weight 0. Null ids share one noise and come after all others of their score. An empty
    target gives every bucket its gain against no counts; no documents give no rows. Other
    columns are not read, whatever their names.
    """
    text = F.col(f"`{text_col}`")
    # texts are read once: their buckets are small numbers, and both passes are over these
    split = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("key"), F.spark_partition_id().alias("part"), words(text).alias("held"))
    hashed = F.transform(_features(F.col("held"), draw), lambda f: _bucket(f, draw))
    held = cut(split.select("id", "key", "part", F.size("held").cast("long").alias("n_words"), hashed.alias("buckets")), "buckets")
    table = _gains(held.select("buckets"), target.select(_buckets(target_text_col, draw).alias("buckets")), draw)
    # rows of one id and text that stand in one part of the input are one group, which knows their number
    each = held.select("id", "key", "part", "n_words", F.posexplode_outer("buckets").alias("pos", "bucket"))
    summed = (
        each.join(F.broadcast(table), "bucket", "left")  # a row a bucket
        .groupBy("id", "key", "part", "n_words")
        .agg(F.sum(F.coalesce("gain", F.lit(0))).alias("gain"), F.count("bucket").alias("n"), F.sum((F.coalesce("pos", F.lit(0)) == 0).cast("long")).alias("times"))
    )
    one = summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    weight = F.expr("gain div times")
    scored = one.select("id", "key", "part", "copy", "n_words", F.expr("n div times").alias("n_features"), weight.alias("weight"), (weight + noise(F.col("id"), draw)).alias("score"))

    # the order is total, so that ties of any number are dealt out
    order = [F.col("n_words") < draw.least_words, F.desc("score"), F.asc_nulls_last("id"), F.asc("key"), F.asc("part"), F.asc("copy")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()  # task number and place within the task
    dealt = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = cut(dealt.select("id", "key", "n_words", "n_features", "weight", "score", F.shiftright(at, 33).alias("task"), at.bitwiseAND((1 << 33) - 1).alias("place")), "scores")
    fits = F.sum((F.col("n_words") >= draw.least_words).cast("long"))
    sizes = sorted((r[0], r[1], r[2]) for r in placed.groupBy("task").agg(F.count("*"), fits).collect())  # a row for each task
    before, offsets, n = 0, [], 0
    for task, rows, fit in sizes:
        offsets.append((task, before))
        before, n = before + rows, n + fit
    ahead = F.broadcast(docs.sparkSession.createDataFrame(offsets, "task long, before long"))
    rank = F.col("before") + F.col("place") + 1
    drawn = F.when((F.col("n_words") >= draw.least_words) & (rank <= n * draw.percent // 100), rank)
    return placed.join(ahead, "task").select(F.col("id").alias(id_col), "key", "n_words", "n_features", "weight", "score", drawn.cast("long").alias("rank"))


def drawn(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn rows of docs, with all their columns and their rank (its column's name gets a _ while docs has that name).

    found comes from resample over the same docs. Rows equal in id and text take the ranks of
    that group in some order, each rank once.
    """
    key, other, rank = (free(n, docs.columns) for n in ("_key", "_other", "rank"))
    gone_id, gone_key = free("_id", docs.columns), free("_gone", docs.columns)
    taken = found.where(F.col("rank").isNotNull()).groupBy(F.col(id_col).alias(gone_id), F.col("key").alias(gone_key)).agg(F.array_sort(F.collect_list("rank")).alias(other))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_key))
    met = docs.withColumn(key, F.xxhash64(F.col(f"`{text_col}`"))).join(taken, same)
    single = met.where(F.size(other) == 1).withColumn(rank, F.col(other)[0])
    number = free("_number", docs.columns, [key, other, rank])
    within = Window.partitionBy(gone_id, gone_key).orderBy(F.lit(0))
    several = met.where(F.size(other) > 1).withColumn(number, F.row_number().over(within)).where(F.col(number) <= F.size(other))
    several = several.withColumn(rank, F.element_at(other, F.col(number))).drop(number)
    columns = [F.col(f"`{c}`") for c in docs.columns] + [F.col(rank)]
    return single.select(*columns).union(several.select(*columns))
