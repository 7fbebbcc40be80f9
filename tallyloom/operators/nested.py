"""Nested records reshaped by a walk over their schema: one expression, whatever the depth."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class DateRule:
    """Texts in a field of this name (under a parent of that name, if one is given) are dates of this pattern."""

    field: str
    pattern: str
    parent: str | None = None


# The date fields of a report; the first rule that fits a field decides.
REPORT_DATES = (
    DateRule("date", "yyyy-MM-dd", "EODBalances"),
    DateRule("xnsEndDate", "yyyy-MM-dd HH:mm:ss"),
    DateRule("xnsStartDate", "yyyy-MM-dd HH:mm:ss"),
    DateRule("date", "yyyy-MM-dd HH:mm:ss"),
    DateRule("dates", "dd-MMM-yy"),
    DateRule("startDate", "dd-MMM-yyyy", "MonthlyDetail"),
    DateRule("startDate", "yyyy-MM-dd"),
)


def _text(c: Column, pattern: str | None, out: str) -> Column:
    """Empty for null and 'None'; a date of the pattern as out; any other text as it is."""
    if pattern is None:
        return F.when(c.isNull() | (c == "None"), "").otherwise(c)
    made = F.date_format(F.try_to_timestamp(c, F.lit(pattern)), out)
    return F.when(c.isNull() | (c == "None"), "").otherwise(F.coalesce(made, c))


def walked(c: Column, kind: T.DataType, field: str, parent: str | None, rules: Sequence[DateRule], out: str) -> Column:
    """The expression for a value of this type: structs field by field, arrays and maps element by element.

    An element of an array has its array's name as parent. Fields of a map are named by its
    keys. Texts directly in an array stay as they are; other types stay, and so do null structs, arrays and maps.
    """
    if isinstance(kind, T.StructType):
        made = F.struct(*[walked(c.getField(f.name), f.dataType, f.name, field, rules, out).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), made)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StructType | T.MapType | T.ArrayType):
            return F.transform(c, lambda x: walked(x, kind.elementType, field, parent, rules, out))
        return c
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        if isinstance(kind.valueType, T.StringType):

            def value(k: Column, v: Column) -> Column:
                done = _text(v, None, out)
                for rule in reversed([r for r in rules if r.parent in (None, field)]):
                    done = F.when(k == rule.field, _text(v, rule.pattern, out)).otherwise(done)
                return done

            return F.transform_values(c, value)
        return F.transform_values(c, lambda k, v: walked(v, kind.valueType, "", field, rules, out))
    if isinstance(kind, T.StringType):
        rule = next((r for r in rules if r.field == field and r.parent in (None, parent)), None)
        return _text(c, rule.pattern if rule else None, out)
    return c


def reshaped(df: DataFrame, rules: Sequence[DateRule] = REPORT_DATES, out: str = "yyyy-MM-dd") -> DataFrame:
    """df with dates of the rules' fields in the format out and empty texts for null ones, at any depth."""
    return df.select(*[walked(F.col(f"`{f.name}`"), f.dataType, f.name, None, rules, out).alias(f.name) for f in df.schema.fields])
