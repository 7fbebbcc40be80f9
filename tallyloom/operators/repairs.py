"""Repairs of statements: types and signs, orientation, refunds, missing balances and dates, broken cells.

Steps whose state is small stream over a key's sorted rows (carried), whatever their number;
the rest are window expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.model import signed
from tallyloom.operators.windows import breaks, carried, carry


def repaired_type(before: float | None, row: tuple, limit: float) -> tuple[float, tuple]:
    """The step of repair_types: (balance that the next row starts from, (type, amount, balance, optimizations, inconsistent))."""
    kind, amount, balance = row
    done = ["AMOUNT_MADE_POSITIVE"] if amount < 0 else []
    amount = abs(amount)
    if before is None:
        return balance, (kind, amount, balance, done, False)
    near = lambda x, y: abs(round(x, 2) - round(y, 2)) <= limit
    tried = (("credit", before + amount, balance), ("debit", before - amount, balance), ("debit", before - amount, -balance), ("credit", before + amount, -balance))
    for new, expected, turned in tried:
        if near(expected, turned):
            done = done + ["TRANSACTION_TYPE_CHANGED"] * (new != kind) + ["BALANCE_SIGN_CHANGED"] * (turned != balance)
            return turned, (new, amount, turned, done, False)
    return balance, (kind, amount, balance, done, True)


def repair_types(df: DataFrame, key: str, order: Sequence[str], limit: float = 0.1) -> DataFrame:
    """df with type, value and sum (the repaired type, amount and balance), optimizations and inconsistent.

    Amounts become positive. The balance before, plus or minus the amount, must be this
    balance, or its negative: the first of credit, debit, debit with the balance's sign
    turned, credit with it turned that holds sets the type; a turned balance is what the next
    row starts from. None holds: the row is inconsistent. A key in which more than two signs
    turn (or a fifth, of more than ten rows) gets its rows back as they were.
    """

    out = carried(df, key, order, ["transaction_type", "amount", "balance"], lambda before, row: repaired_type(before, row, limit), "type string, value double, sum double, optimizations array<string>, inconsistent boolean")
    whole = Window.partitionBy(key)
    turned, n = F.count_if(F.array_contains("optimizations", "BALANCE_SIGN_CHANGED")).over(whole), F.count("*").over(whole)
    out = out.withColumn("_undo", ((turned / n > 0.2) & (n > 10)) | ((turned > 2) & (n <= 10)))
    back = lambda new, old: F.when(F.col("_undo"), F.col(old)).otherwise(F.col(new)).alias(new)
    none = F.when(F.col("_undo"), F.array().cast("array<string>")).otherwise(F.col("optimizations")).alias("optimizations")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], back("type", "transaction_type"), back("value", "amount"), back("sum", "balance"), none, "inconsistent")


def optimised(df: DataFrame, key: str, order: Sequence[str], limit: float = 0.1) -> DataFrame:
    """df with type: repaired where a key's rows do not tally and then do, else as it was.

    If every row but the first changed, the first changes too.
    """
    w, whole = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key)
    r = repair_types(df.withColumn("_bad", breaks(w, limit)), key, order, limit)
    changed = F.count_if(F.array_contains("optimizations", "TRANSACTION_TYPE_CHANGED")).over(whole)
    r = r.withColumns({"_changed": changed, "_n": F.count("*").over(whole), "_k": F.row_number().over(w)})
    other = F.when(F.col("type") == "credit", "debit").otherwise("credit")
    r = r.withColumn("type", F.when((F.col("_k") == 1) & (F.col("_n") > 1) & (F.col("_changed") == F.col("_n") - 1), other).otherwise(F.col("type")))
    plus = F.when(F.col("type") == "debit", -F.col("value")).otherwise(F.col("value"))
    still = F.coalesce(F.abs(F.round(F.lag("sum").over(w) + plus, 2) - F.round("sum", 2)) > limit, F.lit(False))
    r = r.withColumn("_still", still)
    good = F.bool_or("_bad").over(whole) & ~F.bool_or("_still").over(whole)
    return r.withColumn("_good", good).select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col("_good"), F.col("type")).otherwise(F.col("transaction_type")).alias("type"))


def refunds_as_credits(order) -> Column:
    """The type, credit for a debited refund whose amount carries the balance before to this one."""
    fits = F.round(F.lag("balance").over(order) + F.abs("amount"), 2) == F.round("balance", 2)
    refund = (F.col("transaction_channel") == "refund") & (F.col("transaction_type") == "debit")
    return F.when(refund & F.coalesce(fits, F.lit(False)), "credit").otherwise(F.col("transaction_type"))


def orientation(df: DataFrame, key: str, place: str, limit: float = 0.1) -> DataFrame:
    """key, date_order: correct or reverse by the first and last date in the given order.

    Where these are equal it is reverse only if every row carries the balance backwards and not every row forwards.
    """
    w = Window.partitionBy(key).orderBy(place)
    forward = F.abs(F.lag("balance").over(w) + signed() - F.col("balance")) <= limit
    backward = F.abs(F.col("balance") + F.lag(signed()).over(w) - F.lag("balance").over(w)) <= limit
    marked = df.withColumn("_f", forward).withColumn("_b", backward)
    g = marked.groupBy(key).agg(F.min_by("date", place).alias("a"), F.max_by("date", place).alias("z"), F.coalesce(F.bool_and("_f"), F.lit(True)).alias("f"), F.coalesce(F.bool_and("_b"), F.lit(True)).alias("b"))
    tie = F.when(F.col("b") & ~F.col("f"), "reverse").otherwise("correct")
    return g.select(key, F.when(F.col("a") < F.col("z"), "correct").when(F.col("a") > F.col("z"), "reverse").when(F.col("a") == F.col("z"), tie).alias("date_order"))


def first_break(df: DataFrame, key: str, place: str, row: str, limit: float = 0.1) -> DataFrame:
    """key, broken: the row at which a statement's balances first break, in its own orientation; null where none does.

    A statement of a single date that breaks is tried the other way round as well.
    """
    t = df.join(orientation(df, key, place, limit), key).withColumn("_p", F.when(F.col("date_order") == "reverse", -F.col(place)).otherwise(F.col(place)))
    up, down = Window.partitionBy(key).orderBy("_p"), Window.partitionBy(key).orderBy(F.col("_p").desc())
    t = t.withColumn("_up", breaks(up, limit)).withColumn("_down", breaks(down, limit))
    g = t.groupBy(key).agg(F.min(F.when(F.col("_up"), F.struct("_p", row))).alias("u"), F.bool_or("_down").alias("d"), (F.count_distinct("date") == 1).alias("one"))
    return g.select(key, F.when(F.col("one") & ~F.col("d"), None).otherwise(F.col(f"u.{row}")).alias("broken"))


def front_filled(df: DataFrame, key: str, order: Sequence[str], opening: Column, most: float = 0.7) -> DataFrame:
    """Null balances from the last known one, at first from the opening balance (null where there is none).

    Keys of which more than a share stays unknown are left out.
    """
    w = Window.partitionBy(key).orderBy(*order)
    total = F.sum(signed()).over(w.rowsBetween(Window.unboundedPreceding, 0))
    t = df.withColumn("_total", total).withColumn("_opening", opening)
    base = F.coalesce(F.last(F.col("balance") - F.col("_total"), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_opening"))
    t = t.withColumn("_filled", F.coalesce("balance", F.round(base + F.col("_total"), 2)))
    lost = F.count_if(F.col("_filled").isNull()).over(Window.partitionBy(key)) / F.count("*").over(Window.partitionBy(key))
    t = t.withColumn("_lost", lost).where(F.col("_lost") <= most)
    return t.withColumn("balance", F.col("_filled")).drop("_total", "_opening", "_filled", "_lost")


def blank_is_zero(order) -> Column:
    """The balance, 0 for a missing one that the balance before and the amount, or those after, bring to 0."""
    usable = lambda balance, amount: F.when((balance != 0) & (amount != 0), True)
    before, after = F.lag("balance").over(order), F.lead("balance").over(order)
    here, ahead = signed(), F.lead(signed()).over(order)
    left = F.when(usable(before, here), F.round(before + here, 2))
    right = F.when(usable(after, ahead), F.round(after - ahead, 2))
    return F.when(F.col("balance").isNull() & (F.coalesce(left, right) == 0), 0.0).otherwise(F.col("balance"))


def later_years(order, every: int = 12) -> Column:
    """Years to add: one each time so many changes of the month have passed."""
    month = F.month("date")
    change = F.coalesce((month != F.lag(month).over(order)).cast("int"), F.lit(0))
    return F.floor(F.sum(change).over(order.rowsBetween(Window.unboundedPreceding, 0)) / every).cast("int")


def later_dates(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Dates moved by later_years; a key with a 29 February that the new year lacks keeps its dates."""
    w = Window.partitionBy(key).orderBy(*order)
    t = df.withColumn("_years", _changes(df, key, order))
    moved = F.add_months("date", 12 * F.col("_years"))
    lost = F.bool_or((F.month("date") == 2) & (F.dayofmonth("date") == 29) & (F.dayofmonth(moved) != 29)).over(Window.partitionBy(key))
    back = F.make_timestamp(F.year(moved), F.month(moved), F.dayofmonth(moved), F.hour("date"), F.minute("date"), F.second("date"))
    return t.withColumn("_lost", lost).withColumn("date", F.when(F.col("_lost"), F.col("date")).otherwise(back)).drop("_years", "_lost")


def _changes(df: DataFrame, key: str, order: Sequence[str]) -> Column:
    w = Window.partitionBy(key).orderBy(*order)
    return later_years(w)


def same_balance_refund(order) -> Column:
    """Whether a credit after a debit of its date and note brings back the balance before that debit; never an end row."""
    before = lambda c, k=1: F.lag(c, k).over(order)
    pair = (F.col("transaction_type") == "credit") & (before("transaction_type") == "debit") & (before("date") == F.col("date")) & (before("transaction_note") == F.col("transaction_note"))
    free = ~F.col("transaction_channel").isin("refund", "auto_debit_payment_bounce", "inward_cheque_bounce", "inward_payment_bounce", "outward_cheque_bounce")
    return F.coalesce(pair & free & (before("balance", 2) == F.col("balance")), F.lit(False))


def bounced_pairs(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """df with bounce: debit or credit for the halves of a bounced payment, else null.

    Rows of one note and amount of a key are taken two by two; a pair of a debit and a
    credit, in either order, is a bounce if the debit's balance is negative, the first row's
    channel is open (Other or auto_debit_payment) and the second's is no bounce or refund yet.
    """
    group = Window.partitionBy(key, "transaction_note", "amount").orderBy(*order)
    n = F.row_number().over(group)
    t = df.withColumn("_pair", F.floor((n - 1) / 2)).withColumn("_half", (n - 1) % 2)
    pair = Window.partitionBy(key, "transaction_note", "amount", "_pair").orderBy("_half")
    ends = pair.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.struct("transaction_type", "balance", "transaction_channel")
    t = t.withColumn("_a", F.first(row).over(ends)).withColumn("_b", F.last(row).over(ends)).withColumn("_two", F.count("*").over(ends) == 2)
    closed = F.col("_b.transaction_channel").isin("auto_debit_payment_bounce", "inward_cheque_bounce", "inward_payment_bounce", "outward_cheque_bounce", "refund", "reversal")
    open_ = F.col("_two") & ~closed & F.col("_a.transaction_channel").isin("Other", "auto_debit_payment")
    kinds = F.concat_ws(">", F.col("_a.transaction_type"), F.col("_b.transaction_type"))
    bounce = open_ & (((kinds == "debit>credit") & (F.col("_a.balance") < 0)) | ((kinds == "credit>debit") & (F.col("_b.balance") < 0)))
    return t.withColumn("bounce", F.when(bounce, F.col("transaction_type"))).drop("_pair", "_half", "_a", "_b", "_two")


def salary_gaps(df: DataFrame, key: str, low: int, high: int, share: float) -> DataFrame:
    """key, regular: whether consecutive dates lie low to high days apart, but for a share of exceptions.

    From the latest date back; a gap between months of which one already had an exception is none.
    """

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        date, month = row
        if state is None:
            return (date, month, frozenset()), (False,)
        later, later_month, covered = state
        odd = not low <= (later - date).days <= high and later_month not in covered and month not in covered
        # dates only fall, so of the months covered the last exception's are enough
        return (date, month, frozenset((later_month, month)) if odd else covered), (odd,)

    rows = df.select(key, "date", F.date_format("date", "yyyy-MM").alias("month"), (-F.unix_timestamp("date")).alias("back"))
    marked = carried(rows, key, ["back"], ["date", "month"], step, "odd boolean")
    return marked.groupBy(key).agg((F.count_if("odd") <= share * F.count("*")).alias("regular"))


def notes_from_dates(df: DataFrame, key: str, order: Sequence[str], dated: Column, has_amount: Column) -> DataFrame:
    """A row with a date takes the next row's date cell as its note where that has no amounts; that row goes.

    Of rows that could both take and be taken, every second one is taken.
    """
    w = Window.partitionBy(key).orderBy(*order)
    t = df.withColumn("_dated", dated).withColumn("_bare", ~has_amount)
    t = t.withColumn("_can", F.col("_bare") & F.coalesce(F.lag("_dated").over(w), F.lit(False)))
    t = t.withColumn("_start", F.col("_can") & ~F.coalesce(F.lag("_can").over(w), F.lit(False)))
    t = t.withColumn("_run", F.sum(F.col("_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    k = F.row_number().over(Window.partitionBy(key, "_run", "_can").orderBy(*order))
    t = t.withColumn("_gone", F.col("_can") & (k % 2 == 1))
    note = F.when(F.lead("_gone").over(w), F.lead("date_cell").over(w)).otherwise(F.col("note"))
    return t.withColumn("note", note).where(~F.col("_gone")).drop("_dated", "_bare", "_can", "_start", "_run", "_gone")


def split_numbers(order, prefixes: Sequence[tuple[str, str]]) -> Column:
    """The balance cell with the next row's appended where a (prefix, suffix) pair of patterns fits both."""
    ahead = F.lead("balance_cell").over(order)
    fits = F.lit(False)
    for head, tail in prefixes:
        fits = fits | (F.col("balance_cell").rlike(head) & ahead.rlike(tail))
    return F.when(F.coalesce(fits, F.lit(False)), F.concat("balance_cell", ahead)).otherwise(F.col("balance_cell"))


def three_row_dates(order) -> Column:
    """A date over three rows, day, month and year, put together in the first; null where the cells make none."""
    joined = F.concat_ws(" ", "date_cell", F.lead("date_cell", 1).over(order), F.lead("date_cell", 2).over(order))
    return F.when(F.col("has_balance") & F.col("date_cell").rlike("^[0-9]{1,2}$"), F.try_to_timestamp(joined, F.lit("d MMM yyyy")))


def carried_dates(order, epoch: Column) -> Column:
    """The date, for the placeholder the last one that is not; leading placeholders stay."""
    return F.coalesce(carry(F.when(F.col("date") != epoch, F.col("date")), order), F.col("date"))


def aligned_notes(df: DataFrame, notes: DataFrame, keys: Sequence[str], order: Sequence[str], note: str, line: str, place: str) -> DataFrame:
    """df whose notes come from a parallel list of lines, where the two can be aligned.

    The first row (in order) of a key whose note of two characters or more stands in a line, in any case,
    fixes the offset: the first such line minus the row's number. It counts only if the list reaches from there to the last
    row; a negative offset aligns nothing. Keys without an alignment, and those without lines,
    keep their notes. notes: keys, place and line, a page's lines to a key, which are gathered in one array.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    lists = notes.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, line))), lambda s: s[line]).alias("_lines"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    n = F.count("*").over(Window.partitionBy(*keys))
    rows = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", n).join(lists, on, "left")
    text = F.upper(note)
    at = F.array_position(F.transform("_lines", lambda x: F.contains(F.upper(x), text)), True) - 1
    rows = rows.withColumn("_j", F.when(F.length(note) > 1, at))
    enough = (F.col("_j") >= 0) & (F.size("_lines") > F.col("_j") - F.col("_i") + F.col("_n") - 1)
    offset = F.min(F.when(enough, F.struct("_i", (F.col("_j") - F.col("_i")).alias("d")))).over(Window.partitionBy(*keys))
    rows = rows.withColumn("_d", offset["d"])
    made = F.when(F.col("_d") >= 0, F.get("_lines", (F.col("_d") + F.col("_i")).cast("int"))).otherwise(F.col(note))
    return rows.select(*[(made if c == note else F.col(f"`{c}`")).alias(c) for c in df.columns])
