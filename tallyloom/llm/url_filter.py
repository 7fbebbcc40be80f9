"""URL filters: rules found by their rarest literal token, then checked by regular expression.

A rule names a host (it and all its subdomains) and the start of a path. Every literal
piece of a rule that must appear in a fitting URL as a whole token can index it; the one
that fewest URLs hold is taken. The tokens of a URL fetch the rules indexed under them,
and only those rules' regular expressions run. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.runtime import free

#: Tokens are runs of ASCII letters and digits and of all characters past ASCII.
_DELIMITERS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stands for the token of rules that hold no whole one; every URL has it.
_ANY = ""
#: Letters that are lowered in hosts.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_after(url), "/", 1))
    return F.coalesce(F.translate(F.substring_index(F.substring_index(rest, "?", 1), "#", 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    whole = F.substring_index(F.substring_index(F.when(F.instr(url, "://") > 0, _after(url)), "?", 1), "#", 1)
    slash = F.instr(whole, "/")
    return F.coalesce(F.when(slash > 0, F.substring(whole, slash, F.length(whole))).otherwise(F.when(whole.isNotNull(), "")), F.lit(""))


def _after(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs as a table; a rule is a host, and a slash and the start of a path if it has one.

    A rule without a host or a verdict is an error.
    """
    if any(not verdict or not rule or rule.startswith("/") for verdict, rule in rules):
        raise ValueError("a rule needs a verdict and a host")
    return spark.createDataFrame(rules, "verdict string, rule string")


def _quote(text: Column) -> Column:
    return F.regexp_replace(text, r"([^0-9A-Za-z/\u0080-\uffff])", r"\\$1")


def normal(rules: DataFrame) -> DataFrame:
    """verdict, rule, host, start (of the path): rules with their hosts' A-Z lower-cased, each once.

    Rules that differ only in the case of the host are one, written as the least of them;
    of several verdicts on one rule the greatest decides (block over allow). Rules without
    a host or verdict are left out: they fit nothing.
    """
    slash = F.instr("rule", "/")
    host = F.translate(F.substring_index("rule", "/", 1), _UPPER, _LOWER)
    start = F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("")
    split = rules.select("verdict", "rule", host.alias("host"), start.alias("start")).where((F.col("host") != "") & F.col("verdict").isNotNull())
    return split.groupBy("host", "start").agg(F.min("rule").alias("rule"), F.max("verdict").alias("verdict"))


def indexed(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """verdict, rule, token, pattern: one row per rule of normal(). tokens: token, urls (that hold it).

    A rule's last piece is no whole token unless a slash or dot follows, since the path may
    go on; after a rule that is only a host a slash or the end must follow, so all its pieces
    are. A rule without any whole token has the token that every URL has. Ties go to the lesser token.
    """
    whole = F.concat("host", F.when(F.col("start") == "", "/").otherwise(F.regexp_replace("start", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$", "")))
    pieces = F.filter(F.split(whole, _DELIMITERS), lambda x: x != "")
    literal = rules.withColumn("token", F.explode(F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit(_ANY)))))
    counted = literal.join(tokens, "token", "left").withColumn("urls", F.coalesce("urls", F.lit(0)))
    rarest = counted.groupBy("verdict", "rule", "host", "start").agg(F.min(F.struct("urls", "token")).alias("best"))
    end = F.when(F.col("start") == "", r"(?:/|\z)").otherwise(_quote(F.col("start")))
    pattern = F.concat(F.lit(r"(?s)\A(?:[^/]*\.)?"), _quote(F.col("host")), end)
    return rarest.select("verdict", "rule", F.col("best.token").alias("token"), pattern.alias("pattern"))


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict.

    The longest fitting rule decides (of equals the greater string; normal() says what holds
    for repeated rules); where none fits, rule is null and the verdict is allow. Null URLs and
    those without :// have an empty host and path, which no rule fits; they are dealt out by a
    salt and not by their one place. Every row stays, repeated or not; columns of pages that
    bear the new names, in any case, are replaced, others may have any names. Rules fetched
    for a URL are those of its tokens, so a very common host costs a look-up for each of its
    URLs and nothing more.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    url, salt, of_place, of_host, of_path = F.col(f"`{url_col}`"), *(free(n, pages.columns) for n in ("_salt", "_salt_of", "_host_of", "_path_of"))
    split = pages.select(*kept, url_host(url).alias("host"), url_path(url).alias("path"))
    # a verdict depends on host and path alone
    places = split.select("host", "path").where(F.col("host") != "").distinct()
    rules = normal(rules)
    words = F.split(F.concat("host", "path"), _DELIMITERS)
    tokens = places.select("host", "path", F.explode(F.array_distinct(F.filter(words, lambda x: x != ""))).alias("token"))
    used = rules.select(F.explode(F.split(F.concat("host", "start"), _DELIMITERS)).alias("token")).where(F.col("token") != _ANY).distinct()
    index = indexed(rules, tokens.join(used, "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls")))
    if index.where(F.col("token") == _ANY).limit(1).count():  # some rule must meet every URL
        tokens = tokens.union(places.select("host", "path", F.lit(_ANY)))
    met = tokens.join(index, "token").where(F.expr("rlike(concat(host, path), pattern)"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("long"), F.col("rule"), F.col("verdict"))).alias("best"))
    verdicts = best.select(F.col("host").alias(of_host), F.col("path").alias(of_path), F.lit(-1).cast("long").alias(of_place), "best.rule", "best.verdict")
    dealt = split.withColumn(salt, F.when(F.col("host") == "", F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    same = (F.col("host") == F.col(of_host)) & (F.col("path") == F.col(of_path)) & (F.col(salt) == F.col(of_place))
    return dealt.join(verdicts, same, "left").select(*kept, "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict"))
