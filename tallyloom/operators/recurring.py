"""Recurring groups: rows whose notes are alike join the first row that they match.

Rows of a key are taken in order; one that matches no earlier seed becomes a seed, any other
joins the first seed that it matches. A row matters only by its signature (channel, note,
merchant), so seeds are sought among signatures in the order of their first rows. Keys up
to LIMIT rows match by tiers of score and length; their seeds stream by with the rows. Larger
keys match by shared runs of three characters, in rounds over an inverted index of the
rarest runs: no key is held in a task and no pair of a dense group is made, as its first
member takes the others before pairs are looked for. Without a limit one rule holds at any
size: a block of a key's signatures gives its next seeds, which take what they match in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import shingles
from tallyloom.model import written
from tallyloom.operators import similarity
from tallyloom.operators.windows import carried

#: Rows of a key up to which seeds are found by tiers, and the least share of runs beyond it.
LIMIT, SHARE = 1000, 0.6
#: Rounds in which only first members look for partners, before all links of what is left are made.
PROBES = 4
_BUCKETS = 4096
#: Signatures of a key that give seeds in one round of a rule without a limit, and those compared with these seeds in one task.
BLOCK, DEALT = 1000, 4096

# Words that say nothing of the other party, and the handles of payment ids.
STOP = (
    "imps trf inet cms fund upi rtgs neft mmt pos ecom pur atm cash p2a by clg p2m refund balance date value transfer withdrawl debit month "
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep oct nov dec "
    "mpay trtr inward cts bank hdfc citi icici axis payment phone ph paytm phonepe bharatpe from paym payme bkid pay ubin punb phonep yesb pytm "
    "sbin axmb utib dbssin deutbgl ibkl ioba icicsf inf inft federal fdrl central proc inetimps branch money received transaction vpausing "
    "reference number sent id to"
).split()
HANDLES = "ybl paytm payt ok upi barb pu okax okaxis ind abfs axl idfcbank axisb oksbi okbizaxis icici okhdfc okicici axisbank y".split()


def clean_note(note: Column, channel: Column, stop: Sequence[str] = STOP, handles: Sequence[str] = HANDLES) -> Column:
    """The words of a note that tell its other party; empty for a null note.

    Lower-cased, without stop words and words under three characters. Outside upi, digits go
    unless the word looks like an account number (masked digits), which loses its x. In upi,
    an id with a known handle keeps its name; else the first number goes unless it has ten
    digits (a phone), and words that still have two digits go.
    """
    words = F.split(F.lower(note), r"[ /:\-,;.]")
    barred = lambda w: w.isin(*stop) if stop else F.lit(False)

    def plain(w: Column) -> Column:
        return F.when(w.rlike(r"[x*]+[0-9]"), F.replace(w, F.lit("x"), F.lit(""))).otherwise(F.regexp_replace(w, "[0-9]", ""))

    def paid(w: Column) -> Column:
        parts, number = F.split(w, "@"), F.regexp_extract(w, "[0-9]+", 0)
        known = (F.size(parts) > 1) & F.coalesce(F.get(parts, F.lit(1)).isin(*handles), F.lit(False))
        bare = F.when(number == "", w).otherwise(F.replace(w, number, F.lit("")))
        few = F.when(F.length(F.regexp_replace(bare, "[^0-9]", "")) < 2, bare).otherwise("")
        return F.when(known, parts[0]).when(F.length(number) == 10, w).otherwise(few)

    def kept(change) -> Column:
        made = F.transform(F.filter(words, lambda w: ~barred(w)), change)
        return F.array_join(F.filter(made, lambda w: (F.length(w) >= 3) & ~barred(w)), " ")

    return F.coalesce(F.when(channel == "upi", kept(paid)).otherwise(kept(plain)), F.lit(""))


def _least_score(a: int, b: int) -> tuple[float, bool] | None:
    """The least score that texts of these lengths need, and whether it must be exceeded; None where no score is enough."""
    found = []
    for score, exceed, fits in ((60.0, True, min(a, b) > 50), (73.0, True, min(a, b) > 35), (78.0, False, min(a, b) >= 20), (87.0, True, min(a, b) > 10), (93.0, True, abs(a - b) < 10)):
        if fits:
            found.append((score, exceed))
    return min(found) if found else None


def _enough(score: float, needed: tuple[float, bool]) -> bool:
    return score > needed[0] if needed[1] else score >= needed[0]


def tiered(seed: tuple, row: tuple) -> bool:
    """Whether a row joins a seed, each (channel, note, merchant): one channel (or salary), alike by the tier of their lengths."""
    (channel, note, merchant), (other, text, name) = seed, row
    if channel != other and "salary" not in (channel, other) or min(len(note), len(text)) <= 2:
        return False
    merchants = min(len(merchant), len(name))
    if abs(len(note) - len(text)) >= 10 and merchants <= 10:
        return False
    needed = _least_score(len(note), len(text))
    if needed is not None:
        if note == text or _enough(similarity.indel(note, text), needed) or _enough(similarity.token_set(note, text), needed):
            return True
        x, y = (" ".join(sorted(t.split())) for t in (note, text))
        n, common = min(len(x), len(y)), similarity._common(x, y)
        if 200.0 * common >= needed[0] * (n + common) and _enough(similarity.partial(x, y), needed):  # no run can share more
            return True
    return merchants >= 8 and similarity.weighted(merchant, name) >= 90


def alike(threshold: float):
    """A rule as tiered with one least score for all lengths: the best of the three scores, any merchant."""

    def rule(seed: tuple, row: tuple) -> bool:
        (channel, note, _), (other, text, _) = seed, row
        return (channel == other or "salary" in (channel, other)) and similarity.fuzzy_at_least(note, text, threshold)

    return rule


def _small(signatures: DataFrame, rule, bound: int) -> DataFrame:
    """key, channel, note, merchant, seed (the number of the seed among the key's, None where the signature matches not even itself)."""

    def step(seeds: list | None, row: tuple) -> tuple[list, tuple]:
        seeds = [] if seeds is None else seeds
        for k, seed in enumerate(seeds):
            if rule(seed, row):
                return seeds, (k,)
        seeds.append(row)
        if len(seeds) > bound:
            raise ValueError(f"a key has more than {bound} seeds")
        return seeds, (len(seeds) - 1,)

    return carried(signatures, "key", ["first", "channel", "note", "merchant"], ["channel", "note", "merchant"], step, "seed long")


def _by_rule(signatures: DataFrame, rule) -> DataFrame:
    """signatures with seed: the number of the first seed of its key that each matches, whatever the number of signatures.

    In a round the first BLOCK signatures left of a key stream by and give its next seeds; the
    others are dealt out in shares, each beside these seeds, and those that match one join the first. No
    earlier seed matches what is left, so that is the first of all. A key of up to BLOCK signatures takes one round.
    """
    order, cells = ["first", "channel", "note", "merchant"], ["channel", "note", "merchant"]

    def heads(seeds: list | None, row: tuple) -> tuple[list, tuple]:
        seeds = [] if seeds is None else seeds
        k = next((k for k, seed in enumerate(seeds) if rule(seed, row)), len(seeds))
        if k == len(seeds):
            seeds.append(row)
            return seeds, (k, True)
        return seeds, (k, False)

    def others(seeds: list | None, row: tuple) -> tuple[list, tuple]:
        seeds, (number, *cell) = [] if seeds is None else seeds, row
        if number == number and number is not None:  # the seeds come first
            seeds.append((number, tuple(cell)))
            return seeds, (None,)
        return seeds, (next((float(k) for k, seed in seeds if rule(seed, tuple(cell))), None),)

    left, found, before = signatures, None, 0
    place = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    while True:
        head = left.withColumn("_at", place).where(F.col("_at") <= BLOCK).drop("_at")
        head = written(carried(head, "key", order, cells, heads, "seed long, _new boolean").withColumn("seed", F.col("seed") + before), "heads")
        done = head.drop("_new")
        found = done if found is None else found.union(done)
        last = head.groupBy("key").agg(F.max(F.struct(*order)).alias("_last"), F.count("*").alias("_n")).where(F.col("_n") >= BLOCK).drop("_n")
        rest = written(left.join(last, "key").where(F.struct(*order) > F.col("_last")).drop("_last"), "rest")
        if rest.isEmpty():
            return found
        shares = rest.groupBy("key").agg(F.ceil(F.count("*") / DEALT).alias("_shares"))
        share = F.pmod(F.xxhash64(*cells), F.col("_shares"))
        seeds = head.where("_new").drop("_new").withColumn("number", F.col("seed").cast("double")).drop("seed")
        copies = seeds.join(shares, "key").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)))
        dealt = rest.withColumn("number", F.lit(None).cast("double")).join(shares, "key").withColumn("_share", share)
        both = copies.unionByName(dealt).drop("_shares").withColumn("_part", F.concat_ws("|", F.col("_share").cast("string"), "key")).drop("_share")
        met = carried(both, "_part", [F.col("number").isNull(), "number", *order], ["number", *cells], others, "seed double").where("number IS NULL").drop("number", "_part")
        met = written(met, "met")
        found = found.union(met.where("seed IS NOT NULL").withColumn("seed", F.col("seed").cast("long")))
        left, before = met.where("seed IS NULL").drop("seed"), before + BLOCK


def first_matches(df: DataFrame, key: str, place: str, tokens: str, share: float = SHARE, probes: int = PROBES) -> DataFrame:
    """key, place, seed: for each row the place of the seed that it joins (its own if it is one).

    df has one row for each (key, place); the greatest place of a key goes first; tokens is a
    set, never empty. Rows are alike if shared tokens are at least this share of all. Rows whose
    sets are alike share one of their rarest tokens, so those index them. In a round the rows
    that come first under all their index tokens become seeds and take what is alike; after
    some rounds the links among the rest are made, and rounds go on over them. Every round's
    result is written, and a token that very many rows share meets few seeds.
    """
    rows = df.select(F.col(key).alias("key"), F.col(place).alias("place"), F.col(tokens).alias("tokens"))
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(_BUCKETS)).cast("int")
    counted = rows.select(F.explode("tokens").alias("t")).groupBy(slot(F.col("t")).alias("slot")).count().collect()  # _BUCKETS rows at most
    counts = dict(counted_row for counted_row in map(tuple, counted))
    table = F.array(*[F.lit(int(counts.get(i, 0))) for i in range(_BUCKETS)])
    size = F.size("tokens")
    ranked = F.transform(F.array_sort(F.transform("tokens", lambda t: F.struct(F.get(table, slot(t)).alias("n"), t.alias("t")))), lambda s: s["t"])
    prefix = (size - F.ceil(F.lit(share) * size - 1e-9) + 1).cast("int")
    whole = written(rows.select("key", "place", "tokens", F.slice(ranked, F.lit(1), prefix).alias("index")), "tokens")

    def postings(frame: DataFrame, other: bool = False) -> DataFrame:
        out = frame.select("key", "place", "tokens", F.explode("index").alias("token"))
        return out.withColumnsRenamed({"place": "seed", "tokens": "held"}) if other else out

    def met(frame: DataFrame, seeds: DataFrame) -> DataFrame:
        """key, place, seed of the pairs that are alike, seeds first."""
        small, large = F.least(F.size("tokens"), F.size("held")), F.greatest(F.size("tokens"), F.size("held"))
        pairs = postings(frame).join(postings(seeds, other=True), ["key", "token"]).where((F.col("place") < F.col("seed")) & (small >= share * large - 1e-9))
        both = F.size(F.array_intersect("tokens", "held"))
        return pairs.where(both >= share * (F.size("tokens") + F.size("held") - both) - 1e-9).select("key", "place", "seed").distinct()

    left, seeds = whole, None
    for _ in range(probes):
        first = postings(left).groupBy("key", "token").agg(F.max("place").alias("place"))
        won = first.groupBy("key", "place").agg(F.count("*").alias("won"))
        new = written(left.join(won, ["key", "place"]).where(F.col("won") == F.size("index")).drop("won"), "seeds")
        seeds = new if seeds is None else seeds.union(new)
        gone = met(left, new).select("key", "place").distinct().union(new.select("key", "place"))
        left = written(left.join(gone, ["key", "place"], "left_anti"), "left")
        if not left.limit(1).count():
            break
    else:
        links = written(met(left, left), "links")
        while True:
            blocked = links.select("key", "place").distinct()
            new = written(left.join(blocked, ["key", "place"], "left_anti"), "seeds")
            if not new.limit(1).count():
                break
            seeds = seeds.union(new)
            taken = links.join(new.select("key", F.col("place").alias("seed")), ["key", "seed"], "left_semi").select("key", "place").distinct()
            gone = written(taken.union(new.select("key", "place")), "gone")
            left = written(left.join(gone, ["key", "place"], "left_anti"), "left")
            if not left.limit(1).count():
                break
            links = links.join(gone, ["key", "place"], "left_anti")
            links = written(links.join(gone.withColumnRenamed("place", "seed"), ["key", "seed"], "left_anti"), "links")
    seeds = written(seeds, "seeds")
    members = whole.join(seeds.select("key", "place"), ["key", "place"], "left_anti")
    joined = met(members, seeds).groupBy("key", "place").agg(F.max("seed").alias("seed"))
    return joined.union(seeds.select("key", "place", F.col("place").alias("seed")))


def _by_size(signatures: DataFrame, sizes: DataFrame, rule, limit: int, share: float) -> DataFrame:
    """signatures with seed, by the rule in keys that are not _large, by runs of three characters in the others."""
    signatures = written(signatures.join(sizes, "key"), "signatures")
    small = _small(signatures.where("NOT _large AND length(note) > 2"), rule, limit)
    small = small.select("key", "channel", "note", "merchant", "first", "n", F.col("seed").cast("string").alias("seed"))
    notes = signatures.where("_large AND length(note) > 2")
    vertices = notes.groupBy("key", "note").agg(F.max("channel").alias("channel")).select("key", F.struct("channel", "note").alias("place"), shingles(F.col("note")).alias("runs"))
    seeds = first_matches(vertices, "key", "place", "runs", share).select("key", F.col("place.note").alias("note"), F.to_json("seed").alias("seed"))
    large = notes.join(seeds, ["key", "note"]).select("key", "channel", "note", "merchant", "first", "n", "seed")
    return written(small.union(large), "groups")


def recurring_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], note: str, channel: str, merchant: Column | None = None, rule=tiered, limit: int | None = LIMIT, share: float = SHARE
) -> DataFrame:
    """df with group_no and group_size: the recurring group of a row within its keys, null for rows that stand alone.

    Groups are numbered from 1 by size, the largest first, of equals that whose first row
    comes first. Keys with up to limit rows use rule in the given order of rows, and keys of any size where there is
    no limit; larger keys compare cleaned notes by runs of three characters, in descending order of (channel, note),
    channels apart or not, and rows whose clean note has fewer than three characters stand
    alone. Null keys are keys as any other; null notes, channels and merchants count as empty.
    """
    key = F.to_json(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]))
    raw_channel = F.coalesce(F.col(channel), F.lit(""))
    name = F.coalesce(merchant, F.lit("")) if merchant is not None else F.lit("")
    rows = df.withColumn("_key", key).withColumn("_channel", raw_channel).withColumn("_note", clean_note(F.col(note), raw_channel)).withColumn("_merchant", name)
    first = F.min(F.struct(*order)).alias("first")
    signatures = rows.groupBy(F.col("_key").alias("key"), F.col("_channel").alias("channel"), F.col("_note").alias("note"), F.col("_merchant").alias("merchant")).agg(first, F.count("*").alias("n"))
    if limit is None:
        found = _by_rule(written(signatures.where(F.length("note") > 2), "signatures"), rule)
    else:
        found = _by_size(signatures, rows.groupBy(F.col("_key").alias("key")).agg((F.count("*") > limit).alias("_large")), rule, limit, share)

    groups = found.groupBy("key", "seed").agg(F.sum("n").alias("group_size"), F.min("first").alias("first")).where("group_size > 1")
    numbered = groups.withColumn("group_no", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("group_size"), "first")))  # a row a group
    named = found.drop("first", "n").join(numbered.drop("first"), ["key", "seed"]).drop("seed")
    renamed = named.toDF("_key_of", *[f"_{c}_of" for c in ("channel", "note", "merchant")], "_size_of", "_no_of")
    same = (F.col("_key") == F.col("_key_of")) & (F.col("_channel") == F.col("_channel_of")) & (F.col("_note") == F.col("_note_of")) & (F.col("_merchant") == F.col("_merchant_of"))
    return rows.join(renamed, same, "left").select(*[F.col(f"`{c}`") for c in df.columns], F.col("_no_of").alias("group_no"), F.col("_size_of").alias("group_size"))


def top_group(df: DataFrame) -> DataFrame:
    """The rows of each key's largest group, in a frame that recurring_groups gave."""
    return df.where(F.col("group_no") == 1).drop("group_no")
