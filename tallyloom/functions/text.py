"""Text expressions: cleaning, hashes, tokens and similarity; all of them are column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_only(c: Column) -> Column:
    """Every character past ASCII becomes one space."""
    return F.regexp_replace(c, r"[^\x00-\x7F]", " ")


def bare(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(c, "[^0-9A-Za-z]", "")


def capture(c: Column, pattern: str, group: int) -> Column:
    """A group of a match at the start; null where there is no match."""
    anchored = f"^(?:{pattern})"
    return F.when(c.rlike(anchored), F.regexp_extract(c, anchored, group))


def has_any(c: Column, words: Sequence[str]) -> Column:
    """Whether any of the words is part of the text, in any case."""
    low = F.lower(c)
    return F.coalesce(F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w)), F.lit(False))


def has_word(c: Column, word: str) -> Column:
    """The word, not as part of a longer one."""
    safe = "".join(ch if ch.isalnum() else "\\" + ch for ch in word)
    return c.rlike(rf"\b{safe}\b")


def note_tokens(c: Column, stop: Sequence[str], least: int = 3) -> Column:
    """Lower-cased tokens of a note without stop words, short ones and those with more digits than letters."""
    tokens = F.split(F.lower(c), r"[ /:\-,;.#]")
    stops = F.array(*[F.lit(s) for s in stop]) if stop else F.array().cast("array<string>")
    worth = lambda w: (F.length(w) >= least) & ~F.array_contains(stops, w) & (2 * F.length(F.regexp_replace(w, "[^0-9]", "")) <= F.length(w))
    return F.filter(tokens, worth)


def phones(c: Column, digits: int = 10) -> Column:
    """Tokens with exactly so many digits."""
    return F.filter(F.split(c, r"[ /:\-,;.#]"), lambda w: F.length(F.regexp_replace(w, "[^0-9]", "")) == digits)


def shingles(c: Column, n: int = 3) -> Column:
    """Distinct runs of n characters, sorted; a shorter text is its own one run."""
    runs = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return F.array_sort(F.array_distinct(F.when(F.length(c) >= n, runs).when(c.isNotNull(), F.array(c))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two arrays; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def alike(a: Column, b: Column, least: float = 0.75) -> Column:
    """Edit similarity above a limit; two empty texts are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, True).otherwise(1 - F.levenshtein(a, b) / longest > least)


def masked_equal(a: Column, b: Column, n: int) -> Column:
    """Equality of the last n characters, spaces and dashes aside."""
    tail = lambda c: F.right(F.regexp_replace(c, "[- ]", ""), F.lit(n))
    return tail(a) == tail(b)


def first_capture(c: Column, patterns: Sequence[str]) -> Column:
    """The first group of the first pattern that gives text."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns])


def decide(rules: Sequence[tuple[str, str]], c: Column, otherwise: str | None) -> Column:
    """The label of the first (pattern, label) rule that matches."""
    out = F.when(F.lit(False), F.lit(""))
    for pattern, label in rules:
        out = out.when(c.rlike(f"(?i){pattern}"), F.lit(label))
    return out.otherwise(F.lit(otherwise))
