"""Amounts and dates from text, and numeric expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_amount(c: Column) -> Column:
    """Digits with optional separators, sign and currency mark."""
    return F.coalesce(F.regexp_replace(F.lower(c), r"(rs\.?|inr|cr|dr|[, ])", "").rlike(r"^-?[0-9]+(\.[0-9]+)?$"), F.lit(False))


def amount(c: Column) -> Column:
    """A number out of currency text; null where there is none."""
    return F.regexp_replace(c, "[^0-9.]", "").try_cast("double")


def with_decimals(c: Column) -> Column:
    """A point before the last two digits of a text without one."""
    return F.when(c.rlike(r"^[0-9]{3,}$"), F.concat(F.substring(c, F.lit(1), F.length(c) - 2), F.lit("."), F.right(c, F.lit(2)))).otherwise(c)


def sign(c: Column) -> Column:
    """1 for a credit mark, -1 for a debit mark or a leading minus, null for neither."""
    low = F.lower(c)
    return F.when(low.rlike(r"cr\b"), 1).when(low.rlike(r"^\s*-.*dr\b"), 1).when(low.rlike(r"dr\b|^\s*-"), -1)


def parsed(c: Column, formats: Sequence[str]) -> Column:
    """A timestamp by the first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def salary_month(date: Column, first_day: int = 20) -> Column:
    """The month a salary is for: the one before until first_day."""
    return F.date_format(F.when(F.dayofmonth(date) < first_day, F.add_months(date, -1)).otherwise(date), "MMM-yyyy")


def piecewise(c: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Linear between (x, y) points, flat beyond the ends."""
    out = F.when(c <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        out = out.when(c <= x1, y0 + (c - x0) * (y1 - y0) / (x1 - x0))
    return out.otherwise(F.lit(float(points[-1][1])))


def overlap(low1: Column, high1: Column, low2: Column, high2: Column) -> Column:
    """Length of what two ranges share."""
    return F.greatest(F.lit(0), F.least(high1, high2) - F.greatest(low1, low2))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def nth_from_last(m: Column, n: int) -> Column:
    """The n-th value from the end of a map's values; null where there are fewer."""
    return F.try_element_at(F.map_values(m), F.lit(-n))


def locale_number(c: Column) -> Column:
    """12.000,10 as 12000.10."""
    return F.translate(F.translate(c, ".", ""), ",", ".").try_cast("double")
