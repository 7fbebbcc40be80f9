"""Ordered analytics: balance checks, islands, fills, pairs and the sequential repairs that need state."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.model import signed


def tolerance(bank: Column, loose: Sequence[str], wide: float = 1.0, narrow: float = 0.1) -> Column:
    return F.when(F.lower(bank).isin(*[b.lower() for b in loose]), wide).otherwise(narrow)


def breaks(order: WindowSpec, limit: Column | float) -> Column:
    """Whether the balance before plus this amount misses this balance; false on the first row."""
    expected = F.round(F.lag("balance").over(order) + signed(), 2)
    return F.coalesce(F.abs(expected - F.round("balance", 2)) > limit, F.lit(False))


def islands(df: DataFrame, starts: Column, keys: Sequence[str], order: Sequence[str], name: str = "island") -> DataFrame:
    """Numbers the stretches that begin where starts holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("long")).over(w))


def carry(c: Column | str, order: WindowSpec) -> Column:
    """The last value up to here that is not null."""
    return F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))


def fill_balances(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Null balances from the last known one and the amounts since, else from the next known one.

    A key without any known balance keeps its nulls.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    total = F.sum(signed()).over(w.rowsBetween(Window.unboundedPreceding, 0))
    known = F.when(F.col("balance").isNotNull(), F.col("balance") - F.col("_total"))
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("_total", total).withColumn("balance", F.coalesce("balance", F.round(F.coalesce(before, after) + F.col("_total"), 2))).drop("_total")


def row_hash(columns: Sequence[str], order: WindowSpec, back: int = 2) -> Column:
    """md5 over a row's columns and those of the rows before it; only letters and digits count."""
    parts = [F.coalesce((F.lag(c, k).over(order) if k else F.col(c)).cast("string"), F.lit("None")) for k in range(back + 1) for c in columns]
    return F.md5(F.regexp_replace(F.concat(*parts), "[^0-9A-Za-z]", ""))


def pairs_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """pair: rows (0,1), (2,3), ... of a group share a number; place: 0 or 1 in it."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("pair", F.floor(n / 2)).withColumn("place", (n % 2).cast("int"))


def rolls_over(date: Column, order: WindowSpec) -> Column:
    """Years to add to dates without a year: one more each time the month and day fall back."""
    place = F.month(date) * 100 + F.dayofmonth(date)
    return F.sum(F.coalesce((place < F.lag(place).over(order)).cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))


def per_group(df: DataFrame, key: str, order: Sequence[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A sequential algorithm over each key's ordered rows, where state depends on earlier results.

    The key must bound its rows (a statement or an account does); a task holds one key and
    a batch. Rows with a null key are one group.
    """
    names = T.StructType.fromDDL(schema).fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if rows.empty:
                continue
            keys, before = rows[key], rows[key].shift()
            starts = np.flatnonzero(~((keys == before) | keys.isna() & before.isna()).to_numpy(bool) | (np.arange(len(rows)) == 0))
            held = rows.iloc[starts[-1] :]
            if len(starts) > 1:
                yield pd.concat([step(rows.iloc[i:j].reset_index(drop=True)) for i, j in zip(starts, starts[1:])])[names]
        if held is not None:
            yield step(held.reset_index(drop=True))[names]

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def carried(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], step: Callable[[object, tuple], tuple[object, tuple]], out: str) -> DataFrame:
    """df with new columns from a step that sees a key's rows in order: step(state, row) -> (state, values).

    state is None before a key's first row; row has the columns, in their order. Only the
    state of one key is held, whatever the number of its rows. Rows with a null key are one
    group. out: the new columns as a DDL list.
    """
    kept = [c for c in df.columns]
    names = [c.split()[0] for c in out.split(", ")]
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", " + out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state, seen = None, None, False
        for batch in batches:
            values = []
            for k, *row in zip(batch[key].tolist(), *[batch[c].tolist() for c in columns]):
                k = None if pd.isna(k) else k
                if not seen or k != held:
                    held, state, seen = k, None, True
                state, made = step(state, tuple(row))
                values.append(made)
            new = pd.DataFrame(values, columns=names, index=batch.index)
            yield pd.concat([batch[kept], new], axis=1)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def rearranged(df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str], step: Callable[[list[tuple]], list[tuple]], added: str = "") -> DataFrame:
    """As per_group for steps that keep, drop, reorder or mark rows: step(rows) -> (place, *new values) of each row that stays.

    rows have the columns, in their order; no frame is made for a key. added: the new columns
    as a DDL list; one of df's names replaces that column.
    """
    new = T.StructType.fromDDL(added).fields if added else []
    names = [f.name for f in new]
    schema = T.StructType([*[f for f in df.schema.fields if f.name not in names], *new])

    def made(rows: pd.DataFrame, starts: Sequence[int]) -> pd.DataFrame:
        cells, take = list(zip(*[rows[c].tolist() for c in columns])), []
        values: list[list] = [[] for _ in names]
        for i, j in zip(starts, starts[1:]):
            for place, *own in step(cells[i:j]):
                take.append(i + place)
                for held, v in zip(values, own):
                    held.append(v)
        out = rows.iloc[take].reset_index(drop=True)
        for f, v in zip(new, values):
            out[f.name] = pd.Series(v, dtype={"int": "int32", "bigint": "int64"}.get(f.dataType.simpleString(), "object"))
        return out[schema.fieldNames()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if batch.empty:
                continue
            rows = pd.concat([held[-1].iloc[-1:], batch], ignore_index=True) if held else batch
            keys, before = rows[key], rows[key].shift()
            starts = np.flatnonzero(~((keys == before) | keys.isna() & before.isna()).to_numpy(bool) & (np.arange(len(rows)) > 0))
            if held:
                starts = starts - 1  # places in the batch
            if not len(starts):
                held.append(batch)
                continue
            whole = pd.concat([*held, batch.iloc[: starts[-1]]], ignore_index=True)
            first = len(whole) - starts[-1]
            yield made(whole, [0, *[int(first + i) for i in starts if first + i > 0]])
            held = [batch.iloc[starts[-1] :]]
        if held:
            rows = pd.concat(held, ignore_index=True)
            yield made(rows, [0, len(rows)])

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def flipped_types(rows: Sequence[tuple], limit: float = 0.1, most: float = 0.2) -> list:
    """The types of rows (type, amount, balance) as repaired_types makes them."""
    kinds, flips, held = [], 0, None
    for kind, amount, balance in rows:
        sign = -1 if kind == "debit" else 1
        if held is not None and abs(held + sign * amount - balance) > limit and abs(held - sign * amount - balance) <= limit:
            kind, flips = ("credit" if kind == "debit" else "debit"), flips + 1
        kinds.append(kind)
        held = balance
    return [r[0] for r in rows] if flips > max(2, most * len(rows)) else kinds


def repaired_types(rows: pd.DataFrame, limit: float = 0.1, most: float = 0.2) -> pd.DataFrame:
    """Flips a row's type where only the other sign carries the balance; undone if too many flip.

    More than a fifth of the rows, and more than two, is too many.
    """
    return rows.assign(transaction_type=flipped_types(list(zip(rows["transaction_type"], rows["amount"], rows["balance"])), limit, most))


def unrepeated(cells: Sequence[tuple]) -> list[int]:
    """Places of what stays without blocks that repeat the block of the same length just before them."""
    kept, i = [], 0
    while i < len(cells):
        for n in range(min(len(kept), len(cells) - i), 0, -1):
            if cells[kept[-n]] == cells[i] and [cells[k] for k in kept[-n:]] == list(cells[i : i + n]):
                i += n
                break
        else:
            kept.append(i)
            i += 1
    return kept


def without_repeated_block(rows: pd.DataFrame, columns: Sequence[str]) -> pd.DataFrame:
    """Drops a block of rows that repeats the block of the same length just before it."""
    return rows.iloc[unrepeated(list(map(tuple, rows[list(columns)].itertuples(index=False))))]


def clamped_dates(df: DataFrame, key: str, order: Sequence[str], days: int = 5) -> DataFrame:
    """df whose date, where it is before its predecessor's by at most so many days, is the predecessor's.

    A longer drop stays; a null date stays and clamps nothing.
    """

    def step(held: pd.Timestamp | None, row: tuple) -> tuple[pd.Timestamp, tuple]:
        (date,) = row
        if held is not None and date < held and (held - date).days <= days:
            date = held
        return date, (date,)

    out = carried(df, key, order, ["date"], step, "clamped timestamp")
    return out.withColumn("date", F.col("clamped")).drop("clamped")


def recurring(df: DataFrame, key: str, order: Sequence[str], band: float = 0.4, gap: int = 15, day: int = 6) -> DataFrame:
    """df with group_no: an amount within the band of its group's last one, later by gap days, at about the same day of month.

    The first group that fits takes the row, else it starts one. Of each group the last date
    and amount are held; a null date or amount is a group of its own.
    """

    def step(groups: list[tuple] | None, row: tuple) -> tuple[list[tuple], tuple]:
        date, amount = row
        groups = [] if groups is None else groups
        for k, (last, value) in enumerate(groups):
            apart = abs(date.day - last.day)
            if abs(amount - value) <= band * value and (date - last).days >= gap and min(apart, 30 - apart) <= day:
                groups[k] = row
                return groups, (k,)
        groups.append(row)
        return groups, (len(groups) - 1,)

    return carried(df, key, order, ["date", "amount"], step, "group_no int")
