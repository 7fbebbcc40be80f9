"""Repairs of a feed's rows that stand in the wrong order or repeat a balance, each kept only if it helps.

At the first break of a key's balances steps are tried in turn, on the rows that follow within
a bounded look-ahead. A step is kept if the first break then lies behind all rows that it
touched; else it is undone and the next is tried. Rows stream by; a task holds the look-ahead of one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a step may look ahead, and the most rows that jump together.
LOOK, TOGETHER = 40, 4

#: A row in work: its number among the key's rows, date, signed amount, balance, tags.
Row = tuple[int, object, float, float, tuple[str, ...]]
#: A step: the rows from the one before the break on, the place of the break -> (rows, last place touched), or None.
Step = Callable[[list[Row], int], Iterator[tuple[list[Row], int]]]


def _tagged(r: Row, tag: str, balance: float | None = None) -> Row:
    return (r[0], r[1], r[2], r[3] if balance is None else balance, (*r[4], tag))


def swapped(rows: list[Row], i: int) -> Iterator[tuple[list[Row], int]]:
    """The row and the next, of one date, change places."""
    if i + 1 < len(rows) and rows[i][1] == rows[i + 1][1]:
        a, b = (_tagged(r, "SWAPPED_CONSECUTIVE_TRANSACTIONS") for r in rows[i : i + 2])
        yield [*rows[:i], b, a, *rows[i + 2 :]], i + 1


def split(rows: list[Row], i: int) -> Iterator[tuple[list[Row], int]]:
    """Rows of one balance, which together carry the balance before to it, get the balances between."""
    j = i
    while j + 1 < len(rows) and rows[j + 1][3] == rows[i][3]:
        j += 1
    if i and j > i and round(rows[i - 1][3] + sum(r[2] for r in rows[i : j + 1]), 2) == round(rows[i][3], 2):
        new, held = [], rows[i - 1][3]
        for r in rows[i : j + 1]:
            held = round(held + r[2], 2)
            new.append(_tagged(r, "N_SPLIT_IMPROVEMENT", held))
        yield [*rows[:i], *new, *rows[j + 1 :]], j


def early(rows: list[Row], i: int) -> Iterator[tuple[list[Row], int]]:
    """Up to TOGETHER rows that came too early move behind later ones."""
    for n in range(1, TOGETHER + 1):
        moved = [_tagged(r, "EARLY_JUMP") for r in rows[i : i + n]]
        for p in range(i + n + 1, min(len(rows), i + LOOK) + 1):
            if len(moved) == n and p <= len(rows):
                yield [*rows[:i], *rows[i + n : p], *moved, *rows[p:]], p - 1


def late(rows: list[Row], i: int) -> Iterator[tuple[list[Row], int]]:
    """Up to TOGETHER rows that came too late move before the break."""
    for n in range(1, TOGETHER + 1):
        for p in range(i + 1, min(len(rows), i + LOOK) - n + 1):
            moved = [_tagged(r, "LATE_JUMP") for r in rows[p : p + n]]
            yield [*rows[:i], *moved, *rows[i:p], *rows[p + n :]], p + n - 1


def one_jump(rows: list[Row], i: int) -> Iterator[tuple[list[Row], int]]:
    """The row and the one before it change places, and the one that is now later takes the balance that its amount gives."""
    if i:
        now = _tagged(rows[i], "ONE_JUMP_AND_IMPROVED_BALANCE", round(rows[i - 1][3] - rows[i - 1][2] + rows[i][2], 2))
        then = _tagged(rows[i - 1], "ONE_JUMP_AND_IMPROVED_BALANCE", round(now[3] + rows[i - 1][2], 2))
        yield [*rows[: i - 1], now, then, *rows[i + 1 :]], i


STEPS: tuple[Step, ...] = (swapped, split, early, late, one_jump)


def breaks_at(rows: list[Row], start: int, end: int, limit: float) -> int:
    """The first place from start (1 at least) to end whose balance the row before does not carry over to; end + 1 if none."""
    for i in range(max(1, start), min(end, len(rows) - 1) + 1):
        if not abs(round(rows[i - 1][3] + rows[i][2], 2) - round(rows[i][3], 2)) <= limit:  # nulls break as well
            return i
    return end + 1


def mended(rows: list[Row], i: int, steps: Sequence[Step], limit: float) -> list[Row] | None:
    """The rows after the first step at the break i that is kept; None if none is."""
    for step in steps:
        for trial, last in step(rows, i):
            if breaks_at(trial, i - 1, last, limit) > last:
                return trial
    return None


def repaired_feed(df: DataFrame, key: str, order: Sequence[str], steps: Sequence[Step] = STEPS, limit: float = 0.1) -> DataFrame:
    """df with place (from 1, the order after the repairs), new_balance and tags (what was done to a row).

    Of date, transaction_type, amount and balance. At a break that no step mends the repair of the key ends, and
    its other rows stay as they are. Null amounts and balances break; null keys are one key.
    """
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(*order)).cast("long")
    said = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("\u0000"))
    step_amount = F.when(F.col("transaction_type") == "debit", -F.abs("amount")).otherwise(F.abs("amount"))
    rows = df.withColumn("_key", said).withColumn("_rank", rank).withColumn("_step", step_amount)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, i, placed, ended = None, [], 1, 0, False
        out: list[tuple] = []

        def go(last: bool) -> None:
            """Pass over the breaks that have their look-ahead, and let go of what no step can touch any more."""
            nonlocal held, i, placed, ended
            while not ended and i < len(held) and (last or len(held) > i + LOOK + TOGETHER):
                if breaks_at(held, i, i, limit) == i:
                    new = mended(held, i, steps, limit)
                    if new is None:
                        ended = True
                        break
                    held = new
                else:
                    i += 1
            done = len(held) if ended or last else max(0, i - 2)
            for r in held[:done]:
                placed += 1
                out.append((at, r[0], placed, r[3], list(r[4])))
            held, i = held[done:], max(1, i - done)

        for batch in batches:
            for k, n, date, step, balance in zip(*[batch[c].tolist() for c in ("_key", "_rank", "date", "_step", "balance")]):
                if k != at:
                    if at is not None:
                        go(last=True)
                    at, held, i, placed, ended = k, [], 1, 0, False
                nan = float("nan")
                held.append((n, date, nan if step is None else step, nan if balance is None else balance, ()))
                go(last=False)
            yield pd.DataFrame(out, columns=["key", "rank", "place", "new_balance", "tags"])
            out.clear()
        if at is not None:
            go(last=True)
        yield pd.DataFrame(out, columns=["key", "rank", "place", "new_balance", "tags"])

    slim = rows.select("_key", "_rank", "date", "_step", "balance").repartition("_key").sortWithinPartitions("_key", "_rank")
    made = slim.mapInPandas(run, "key string, rank long, place long, new_balance double, tags array<string>")
    joined = rows.join(made.withColumnsRenamed({"key": "_k", "rank": "_r"}), (F.col("_key") == F.col("_k")) & (F.col("_rank") == F.col("_r")))
    fresh = F.when(F.isnan("new_balance"), None).otherwise(F.col("new_balance"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], "place", fresh.alias("new_balance"), "tags")
