"""Expressions on notes, dates and cells: tokens, date formats, boxes, image hashes, JSON, row shapes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates the words of a note.
SEPARATORS = r"[/:\-,;.# ]"


def _words(c: Column) -> Column:
    return F.split(F.lower(c), SEPARATORS)


def _digits(w: Column) -> Column:
    return F.length(F.regexp_replace(w, "[^0-9]", ""))


def clean_note(note: Column, channel: Column, stop: Sequence[str], upi_hosts: Sequence[str]) -> Column:
    """Words of a note that name a payee, single-spaced; empty for null.

    Not upi: a masked account number keeps its digits, other words lose theirs. upi: of an
    id at a known host the name stays; a number of ten digits stays, other numbers go, and
    with them a word that has two digits or more left. Stop words and words under three letters go.
    """
    stops = F.array(*[F.lit(s) for s in stop])
    kept = lambda w: F.when((F.length(w) < 3) | F.array_contains(stops, w), "").otherwise(w)
    plain = lambda w: kept(F.when(F.array_contains(stops, w), "").when(w.rlike("^x+[0-9]+$"), F.replace(w, F.lit("x"), F.lit(""))).otherwise(F.regexp_replace(w, "[0-9]", "")))

    def paid(w: Column) -> Column:
        number = F.regexp_extract(w, "([0-9]+)", 1)
        cut = F.replace(w, number, F.lit(""))
        by_host = F.split(w, "@")
        known = (F.size(by_host) > 1) & F.array_contains(F.array(*[F.lit(h) for h in upi_hosts]), F.get(by_host, 1))
        other = F.when(number == "", w).when(F.length(number) == 10, w).otherwise(F.when(_digits(cut) >= 2, "").otherwise(cut))
        return kept(F.when(F.array_contains(stops, w), "").when(known, F.get(by_host, 0)).otherwise(other))

    words = F.when(channel == "upi", F.transform(_words(note), paid)).otherwise(F.transform(_words(note), plain))
    return F.coalesce(F.array_join(F.filter(words, lambda w: w != ""), " "), F.lit(""))


def clean_merchant(merchant: Column, note: Column, stop: Sequence[str]) -> Column:
    """The words of a merchant that hold exactly ten digits; where there is no merchant, the note."""
    stops = F.array(*[F.lit(s) for s in stop])
    numbers = F.filter(F.split(merchant, SEPARATORS), lambda w: (_digits(w) == 10) & ~F.array_contains(stops, w))
    return F.when(F.coalesce(merchant, F.lit("")) == "", note).otherwise(F.array_join(numbers, " "))


def patterns(given: Sequence[str]) -> tuple[list[str], list[str]]:
    """Patterns that Spark's regular expressions take, bare, and those that it does not.

    A text written as re.compile('...') stands for what is inside. Patterns are tried on the
    driver, one look at each.
    """
    import re

    good, bad = [], []
    for p in given:
        inner = re.fullmatch(r"re\.compile\((['\"])(.*)\1(?:, *re\.[A-Z|. ]+)?\)", p)
        text = inner[2] if inner else p
        try:
            re.compile(text)
            good.append(text)
        except re.error:
            bad.append(p)
    return good, bad


#: Date formats from parts: each order of day, month and year with each separator and each way to write them.
FORMATS = [
    f.replace("~", sep)
    for sep, f in product(["-", "/", " ", "."], ["d~M~yyyy", "d~MMM~yyyy", "yyyy~M~d", "d~M~yy", "d~MMM~yy", "MMM~d~yyyy"])
] + ["ddMMMyyyy", "ddMMMyy", "MMM d, yyyy", "d MMMM yyyy", "yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyyMMdd"]
#: Months as other languages write them.
MONTHS = {"ene": "Jan", "mei": "May", "agt": "Aug", "agu": "Aug", "okt": "Oct", "des": "Dec", "dez": "Dec", "mai": "May"}


def any_date(c: Column) -> Column:
    """A date by the first of FORMATS that fits, months of MONTHS translated; null where none does."""
    text = F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,? ", "")
    word = F.regexp_extract(text, "([A-Za-z]{3,})", 1)
    known = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    named = F.when(F.map_contains_key(known, F.lower(word)), F.replace(text, word, F.element_at(known, F.lower(word)))).otherwise(text)
    shaped = F.when(word == "", named).otherwise(F.replace(named, F.regexp_extract(named, "([A-Za-z]{3,})", 1), F.initcap(F.regexp_extract(named, "([A-Za-z]{3,})", 1))))
    at = lambda f: F.try_to_timestamp(shaped, F.lit(f))
    near = lambda t: F.when(F.year(t) > 2068, F.add_months(t, -1200)).otherwise(t)
    # two digits are years from 1969 to 2068
    return F.coalesce(*[at(f).cast("date") if "yyyy" in f else near(at(f)).cast("date") for f in FORMATS])


def semi_date(c: Column) -> Column:
    """Whether a text is a day and a month alone, 29 February included."""
    return F.coalesce(F.try_to_timestamp(F.concat(F.trim(c), F.lit(" 2020")), F.lit("d MMM yyyy")), F.try_to_timestamp(F.concat(F.trim(c), F.lit("/2020")), F.lit("d/M/yyyy"))).isNotNull()


def text_in_box(words: Column, box: Sequence[float]) -> Column:
    """Words (struct of x0, y0, x1, y1, text) at least half inside a box, in reading order, as one text."""
    x0, y0, x1, y1 = (F.lit(float(v)) for v in box)
    shared = lambda a, b, c, d: F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))
    area = lambda w: (w["x1"] - w["x0"]) * (w["y1"] - w["y0"])
    inside = F.filter(words, lambda w: 2 * shared(w["x0"], w["x1"], x0, x1) * shared(w["y0"], w["y1"], y0, y1) >= area(w))
    placed = F.array_sort(F.transform(inside, lambda w: F.struct(F.round(w["y0"]).alias("line"), w["x0"].alias("x"), w["text"].alias("text"))))
    return F.array_join(F.transform(placed, lambda w: w["text"]), " ")


def difference_hash(pixels: Column, width: int) -> Column:
    """A bit for each pixel, row by row, that is darker than the next of its row, as hexadecimal text.

    pixels: grey values of an image already scaled to rows of width values.
    """
    rows = F.floor(F.size(pixels) / width).cast("int")
    at = F.sequence(F.lit(0), rows * (width - 1) - 1)
    place = lambda i: F.floor(i / (width - 1)).cast("int") * width + i % (width - 1)
    bits = F.transform(at, lambda i: F.when(F.get(pixels, place(i)) < F.get(pixels, place(i) + 1), "1").otherwise("0"))
    return F.lower(F.conv(F.array_join(bits, ""), 2, 16))


def row_shape(note: Column, date: Column, balance: Column, begin: Sequence[str], end: Sequence[str]) -> dict[str, Column]:
    """What a table row is: continuation, has_date, has_balance, begins, ends."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    marks = lambda words: F.coalesce(F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(note), w)), F.lit(False))
    amount = F.coalesce(F.regexp_replace(balance, "[, ]", "").rlike(r"^\(?-?[0-9]+(\.[0-9]+)?\)?$"), F.lit(False))
    return {"continuation": blank(date) & ~amount & ~blank(note), "has_date": any_date(date).isNotNull(), "has_balance": amount, "begins": marks(begin), "ends": marks(end)}


def signed_balance(c: Column) -> Column:
    """A balance cell as a number: in brackets, after a D, or before a trailing minus it is negative."""
    text = F.trim(c)
    number = F.regexp_replace(text, "[^0-9.]", "").try_cast("double")
    return F.when(text.rlike(r"^\([0-9., ]+\)*$") | text.rlike(r"(?i)^D\s*[0-9,. ]+") | text.rlike(r"^[0-9,.]+\s*-") | text.rlike("^-"), -number).otherwise(number)


def without_empty(c: Column, schema: str, columns: Sequence[str]) -> Column:
    """A JSON object with only these keys, trimmed texts, and without null or blank values; null for what is no JSON."""
    parsed = F.from_json(c, schema)
    fields = [F.nullif(F.trim(parsed[k].cast("string")), F.lit("")).alias(k) for k in columns]
    return F.when(F.coalesce(*[parsed[k].cast("string") for k in columns]).isNotNull(), F.to_json(F.struct(*fields)))


def configured(c: Column, defaults: Mapping[str, float]) -> dict[str, Column]:
    """The numbers of a JSON configuration, each with its default; all defaults where the text is no object."""
    parsed = F.from_json(c, ", ".join(f"{k} double" for k in defaults))
    return {k: F.coalesce(parsed[k], F.lit(float(v))) for k, v in defaults.items()}
