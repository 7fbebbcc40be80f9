"""Whole statements: repeated blocks, lists folded into an account, and merged statements put right.

A statement is cut into chunks where its balances break. Tables of chunk heads say in which
order chunks stand; the rows then stream by in that order, one chunk and its predecessor
held at a time. Statements of few rows go through the same steps in one task, one at a time. Accounts of many statements are split where no statement spans the gap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.model import written
from tallyloom.operators.repairs import first_break, repair_types, repaired_type
from tallyloom.operators.similarity import partial

#: Columns that two rows of one transaction share; their notes need only be alike.
SAME = ("date", "amount", "balance", "chq_num")


def _named(keys: Sequence[str]) -> Column:
    """A key of any columns as one text, nulls told apart."""
    return F.to_json(F.array(*[F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("\u0000")) for k in keys]))


def folded(df: DataFrame, part: str, run: str, order: Sequence[str], columns: Sequence[str], step: Callable[[object, list[tuple]], tuple[object, int]], number: str | None = None) -> DataFrame:
    """Runs of rows in order, each given to step(state, rows) -> (state, how many of its first rows go).

    rows have the columns, in their order, nulls as None; state is None before a part's first
    run. number: a column that takes the place, from 0, of each row that stays within its
    part. One run is held besides the state, whatever the size of the part. part and run hold no nulls.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_frames: list[tuple[pd.DataFrame, np.ndarray, np.ndarray]] = []  # rows, which stay, their places
        rows: list[tuple] = []
        spots: list[tuple[np.ndarray, np.ndarray, int]] = []
        state, at, placed = None, None, 0

        def close() -> None:
            nonlocal state, placed, rows
            state, gone = step(state, rows)
            for k, (stays, place, i) in enumerate(spots):
                if k < gone:
                    stays[i] = False
                else:
                    place[i], placed = placed, placed + 1
            rows = []
            spots.clear()

        def done() -> Iterator[pd.DataFrame]:
            for frame, stays, place in open_frames:
                yield (frame if number is None else frame.assign(**{number: place}))[stays]
            open_frames.clear()

        for batch in batches:
            stays, place = np.ones(len(batch), bool), np.zeros(len(batch), np.int64)
            cells = list(zip(*[[None if v is None or v != v else v for v in batch[c].tolist()] for c in columns]))
            for i, key in enumerate(zip(batch[part].tolist(), batch[run].tolist())):
                if key != at:
                    if at is not None:
                        close()
                        if key[0] != at[0]:
                            state, placed = None, 0
                    yield from done()  # the run that opens stands in no earlier batch
                    at = key
                rows.append(cells[i])
                spots.append((stays, place, i))
            open_frames.append((batch, stays, place))
        if at is not None:
            close()
        yield from done()

    schema = df.schema if number is None or number in df.columns else T.StructType([*df.schema.fields, T.StructField(number, T.LongType())])
    return df.repartition(part).sortWithinPartitions(part, run, *order).mapInPandas(stream, schema)


_MASK, _BASE = (1 << 61) - 1, 1_000_003_019


def repeats(cells: Sequence[int]) -> list[tuple[int, int]]:
    """(place, length) of the blocks that repeat the rows kept just before them, of any two that begin at one place the longer.

    Prefix hashes of the kept rows and of all rows decide equality in one step; places to
    try are those where two successive rows agree, and the last row itself.
    """
    power, whole = [1], [0]
    for c in cells:
        whole.append((whole[-1] * _BASE + c % _MASK) % _MASK)
        power.append(power[-1] * _BASE % _MASK)
    kept: list[int] = []
    prefix, pairs, out, i = [0], {}, [], 0
    while i < len(cells):
        n = 0
        for p in pairs.get((cells[i], cells[i + 1]), ()) if i + 1 < len(cells) else ():
            m = len(kept) - p
            if i + m <= len(cells) and (prefix[-1] - prefix[p] * power[m] - whole[i + m] + whole[i] * power[m]) % _MASK == 0:
                n = m
                break  # places ascend, so the first is the longest
        if not n and kept and kept[-1] == cells[i]:
            n = 1
        if n:
            out.append((i, n))
            i += n
            continue
        if kept:
            pairs.setdefault((kept[-1], cells[i]), []).append(len(kept) - 1)
        kept.append(cells[i])
        prefix.append((prefix[-1] * _BASE + cells[i] % _MASK) % _MASK)
        i += 1
    return out


def without_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], single: Column | None = None) -> DataFrame:
    """df without blocks of rows that repeat, in the given columns, the block of their length kept just before them.

    Rows for which single holds repeat nothing. A task holds the 64-bit hashes of one key's
    rows, never the rows; the blocks found, one row each, then take their rows away. Null keys
    and null values are equal among themselves.
    """
    key, rank, cell = "_repeat_key", "_repeat_rank", "_repeat_cell"
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    rows = df.withColumn(key, _named(keys)).withColumn(rank, place.cast("long"))
    # a null has no part in a hash, so which values are null is hashed too
    said = F.xxhash64(*[F.col(f"`{c}`") for c in columns], *[F.col(f"`{c}`").isNull() for c in columns])
    rows = rows.withColumn(cell, F.when(single, F.xxhash64(said, F.col(rank))).otherwise(said) if single is not None else said)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, cells = None, []
        for batch in batches:
            out: list[tuple] = []
            for k, c in zip(batch[key].tolist(), batch[cell].tolist()):
                if k != at:
                    out += [(at, i + 1, n) for i, n in repeats(cells)]
                    at, cells = k, []
                cells.append(c)
            yield pd.DataFrame(out, columns=["key", "first", "n"])
        yield pd.DataFrame([(at, i + 1, n) for i, n in repeats(cells)], columns=["key", "first", "n"])

    blocks = rows.select(key, rank, cell).repartition(key).sortWithinPartitions(key, rank).mapInPandas(find, "key string, first long, n long")
    gone = blocks.select(F.col("key").alias(key), F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias(rank))
    return rows.join(gone, [key, rank], "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def _bare(note: object) -> str:
    return "".join(c for c in str(note or "").lower() if c.isascii() and c.isalnum())


def _same_row(a: tuple, b: tuple) -> bool:
    """Day, amount, balance and type equal, and notes equal but for signs or, from four characters, half alike."""
    if a[:4] != b[:4]:
        return False
    x, y = _bare(a[4]), _bare(b[4])
    return x == y or len(str(a[4] or "")) >= 4 and len(str(b[4] or "")) >= 4 and partial(x, y) >= 50


def folded_lists(df: DataFrame, keys: Sequence[str], list_col: str, order: Sequence[str], least: int = 3) -> DataFrame:
    """Ordered lists of one account folded into one: date, amount, balance, transaction_type, transaction_note say what is equal.

    Lists come by the date of their first row, of equals by list_col. A list that ends no later than what is kept
    adds nothing. One that begins no later than that loses the rows of its overlap: the kept
    rows from the first place, on the day of its first row, where its first `least` rows (or all
    that either side has left) agree. Without such a place it is added whole, as is one that
    begins later. Rows need dates; of an account, stretches that no list spans are folded apart.
    """
    key, run, segment = "_fold_key", "_fold_run", "_fold_part"
    rows = df.withColumn(key, _named(keys))
    first = F.min_by("date", F.struct(*order))
    heads = rows.groupBy(key, list_col).agg(first.alias("_low"), F.max("date").alias("_high"))
    by_first = Window.partitionBy(key).orderBy("_low", F.col(list_col))  # a row a list
    before = F.max("_high").over(by_first.rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.withColumn(run, F.row_number().over(by_first).cast("long")).withColumn("_new", F.coalesce(F.col("_low") > before, F.lit(True)).cast("int"))
    heads = heads.withColumn(segment, F.concat_ws("|", F.sum("_new").over(by_first.rowsBetween(Window.unboundedPreceding, 0)), key))
    placed = rows.join(heads.select(F.col(key).alias("_k"), F.col(list_col).alias("_l"), run, segment), (F.col(key) == F.col("_k")) & F.col(list_col).eqNullSafe(F.col("_l"))).drop("_k", "_l")

    def fold(state: list | None, new: list[tuple]) -> tuple[list, int]:
        own = [(r[0].normalize(), *r[1:], r[0]) for r in new]
        if not state:
            return own, 0
        low, high, last = own[0][5], own[-1][5], state[-1][5]
        begin = next((i for i, r in enumerate(state) if r[0] >= own[0][0]), len(state))
        state = state[begin:] or state[-1:]  # lists come by their first day, so no later one looks further back
        if low <= last and high <= last:
            return state, len(own)
        drop = 0
        if low <= last:
            for k, r in enumerate(state):
                m = min(least, len(own), len(state) - k)
                if r[0] == own[0][0] and all(_same_row(state[k + i], own[i]) for i in range(m)):
                    drop = len(state) - k
                    break
        return state + own[drop:], min(drop, len(own))

    out = folded(placed, segment, run, list(order), ["date", "amount", "balance", "transaction_type", "transaction_note"], fold)
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def edits(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _alike(a: tuple, b: tuple) -> bool:
    """The SAME columns equal and notes more than three quarters alike."""
    if a[1:] != b[1:]:
        return False
    x, y = a[0], b[0]
    return x == y or round(100 * (1 - edits(x, y) / max(len(x), len(y))), 2) > 75


def without_overlap(before: list[tuple], own: list[tuple]) -> int:
    """How many rows of own repeat the end of before: up to the first row like its last one, if all of them are like its last rows."""
    found = next((i for i, r in enumerate(own) if _alike(before[-1], r)), None)
    if found is None or found + 1 > len(before):
        return 0
    return found + 1 if all(_alike(a, b) for a, b in zip(before[len(before) - found - 1 :], own)) else 0


def _chunk(state: tuple | None, rows: list[tuple]) -> tuple[tuple, int]:
    """One chunk (note, then the SAME columns) after another: contained and equal ones go, overlaps are cut."""
    cells = [(r[0] or "", *r[1:]) for r in rows]
    low, high, cut = cells[0][1], cells[-1][1], 0
    if state is not None:
        old_low, old_high, old = state
        known = None not in (low, high, old_low, old_high)
        inside = known and low > old_low and high < old_high and len(cells) < len(old)
        equal = low == old_low and high == old_high and len(cells) == len(old) and all(map(_alike, old, cells))
        cut = len(cells) if inside or equal else without_overlap(old, cells) if known and old_high >= low else 0
        if cut == len(cells):
            return state, cut
    return (low, high, cells[cut:]), cut


def _repaired(df: DataFrame, limit: float) -> DataFrame:
    """Types, amounts and signs by repair_types, what was done added to _done, breaks in _bad."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("transaction_type", "amount", "balance", "_done", "_bad")]
    r = repair_types(df, "_way", ["_place"], limit)
    done = F.concat("_done", "optimizations").alias("_done")
    return r.select(*kept, F.col("type").alias("transaction_type"), F.col("value").alias("amount"), F.col("sum").alias("balance"), done, F.col("inconsistent").alias("_bad"))


def _rechained(df: DataFrame) -> DataFrame:
    """df cut at its breaks, chunks by first and last date, with new places."""
    number = F.sum(F.col("_bad").cast("long")).over(Window.partitionBy("_way").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    cut = df.withColumn("_chunk", number)
    heads = cut.groupBy("_way", "_chunk").agg(F.min_by("date", "_place").alias("low"), F.max_by("date", "_place").alias("high"))
    heads = heads.withColumn("_run", F.row_number().over(Window.partitionBy("_way").orderBy("low", "high", "_chunk")).cast("long"))  # a row a chunk
    runs = cut.join(heads.select("_way", "_chunk", "_run"), ["_way", "_chunk"])
    return written(folded(runs, "_way", "_run", ["_place"], ["transaction_note", *SAME], _chunk, number="_place").drop("_chunk", "_run"), "chunks")


def merged_statements(df: DataFrame, key: str, place: str, limit: float = 0.1, share: float = 0.15, rows_least: int = 20, small: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Statements whose pages were merged or jumbled, put right where that is possible: (rows, verdicts).

    df has the key, the given place, date, transaction_type, amount, balance,
    transaction_note, chq_num and page_number, and any other columns but such with a leading
    _. Up to three rounds repair types and signs, cut at breaks, order the chunks by their dates, drop
    contained and equal ones and cut overlaps; the whole is tried on the rows and on the rows
    reversed. Without a break left, repeated blocks go if the balances still tally, and rows
    come back repaired, in _order. A statement with breaks left both ways, or with more than
    a share of breaks at the first repair if it has more than rows_least rows, comes back as it was, and so does one
    of one or two rows. verdicts: key, is_inconsistent, breaks, ranges (of the chunks, in
    order), is_missing_data (whether a chunk begins a day or more after the end of that before),
    pages (whose rows changed or went; none if the statement stays as it was).
    Statements of up to small rows are put right in one pass over the rows, the others by
    rounds over tables.
    """
    df = df.withColumns({c: F.col(c).cast("double") for c in ("amount", "balance")})
    page_type = df.schema["page_number"].dataType
    rows = written(_put_right_small(df.withColumn("_key", _named([key])), place, limit, share, rows_least, small), "passed")
    names = [F.col(f"`{c}`") for c in df.columns]
    out = rows.where("NOT _large").select(*names, "_order", "_done")
    said = rows.where("_verdict IS NOT NULL").select(F.col(f"`{key}`"), "_verdict.*")
    large = rows.where("_large").select(*names)
    if not large.isEmpty():
        more, found = _put_right_large(large, key, place, limit, share, rows_least)
        out, said = out.unionByName(more), said.unionByName(found)
    return out, said.withColumn("pages", F.col("pages").cast(T.ArrayType(page_type)))


def _tried(cells: list[tuple], back: bool, limit: float, share: float, rows_least: int) -> tuple[list[list], bool, int]:
    """Small statements one way: (rows, whether the rounds were made, breaks). A row: index, date, note, chq, type, amount, balance, done, whether it breaks."""

    def repaired(rows: list[list]) -> list[list]:
        before, out, turned = None, [], 0
        for r in rows:
            before, made = repaired_type(before, tuple(r[4:7]), limit)
            out.append([*r[:4], *made[:3], r[7] + made[3], made[4]])
            turned += "BALANCE_SIGN_CHANGED" in made[3]
        if turned / len(rows) > 0.2 if len(rows) > 10 else turned > 2:
            return [[*r[:8], o[8]] for r, o in zip(rows, out)]
        return out

    def rechained(rows: list[list]) -> list[list]:
        cuts = [0, *[i for i, r in enumerate(rows) if r[8]], len(rows)]
        first = lambda d: (d is not None, d) if d is not None else (False,)  # noqa: E731  nulls first
        runs = sorted((first(rows[i][1]), first(rows[j - 1][1]), i, j) for i, j in zip(cuts, cuts[1:]) if i < j)
        state, out = None, []
        for _, _, i, j in runs:
            none = lambda v: None if v != v else v
            state, gone = _chunk(state, [(r[2], r[1], none(r[5]), none(r[6]), r[3]) for r in rows[i:j]])
            out += rows[i + gone : j]
        return out

    order = range(len(cells) - 1, -1, -1) if back else range(len(cells))
    rows = repaired([[i, *cells[i], [], False] for i in order])
    n, bad = len(rows), sum(r[8] for r in rows)
    if n <= 2:
        return [[*r[:8], False] for r in rows], False, 0
    if bad > share * n and n > rows_least:
        return rows, False, bad
    for _ in range(2):
        rows = repaired(rechained(rows))
    return rows, True, sum(r[8] for r in rows)


def _cents(x: float) -> float:
    """As Spark rounds to two places."""
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_UP)) if abs(x) < 1e15 else x


def _tallies(rows: list[list], limit: float) -> bool:
    """Whether first_break finds none: in the rows' own orientation, or of a single date either way."""
    plus = lambda r: -r[5] if r[4] == "debit" else r[5]
    low, high = rows[0][1], rows[-1][1]
    turn = low is not None and high is not None and low > high
    if low is not None and low == high:
        pairs = list(zip(rows, rows[1:]))
        near = lambda x: x <= limit or x != x  # noqa: E731  an unknown balance says nothing
        forward = all(near(abs(a[6] + plus(b) - b[6])) for a, b in pairs)
        turn = not forward and all(near(abs(b[6] + plus(a) - a[6])) for a, b in pairs)
    breaks = lambda x: any(abs(_cents(a[6] + plus(b)) - _cents(b[6])) > limit for a, b in zip(x, x[1:]) if a[6] + plus(b) - b[6] == a[6] + plus(b) - b[6])
    one = len({r[1] for r in rows} - {None}) == 1
    ways = (rows[::-1], rows) if turn else (rows, rows[::-1])
    return not breaks(ways[0]) or one and not breaks(ways[1])


def _solved(cells: list[tuple], pages: list, limit: float, share: float, rows_least: int) -> tuple[list[list] | None, bool, dict]:
    """One statement: (its rows in order if it is put right, whether backwards, its verdict). cells: date, note, chq, type, amount, balance."""
    rows, made, breaks = _tried(cells, False, limit, share, rows_least)
    back = False
    if breaks:
        other = _tried(cells, True, limit, share, rows_least)
        if other[2] < breaks:
            (rows, made, breaks), back = other, True
    cuts = [0, *[i for i, r in enumerate(rows) if r[8] and i], len(rows)]
    ranges = [(rows[i][1], rows[j - 1][1]) for i, j in zip(cuts, cuts[1:])]
    day = lambda d: d.date() if hasattr(d, "date") else d
    gap = any(b[0] is not None and a[1] is not None and (day(b[0]) - day(a[1])).days >= 1 for a, b in zip(ranges, ranges[1:]))
    verdict = {"is_inconsistent": breaks > 0, "breaks": breaks, "ranges": [{"low": a, "high": z} for a, z in ranges], "is_missing_data": breaks > 0 and gap, "pages": []}
    if breaks or not made:
        return None, False, verdict
    rows = [[*r, k] for k, r in enumerate(rows)]
    known: dict = {}
    said = lambda r: tuple(None if v != v else v for v in (r[1], r[5], r[6], r[4], r[2]))
    found = repeats([known.setdefault((r[9],) if len(r[2] or "") < 3 else said(r), len(known) + 1) for r in rows])
    if found:
        gone = {i + j for i, n in found for j in range(n)}
        thinner = [r for i, r in enumerate(rows) if i not in gone]
        rows = thinner if _tallies(thinner, limit) else rows
    stayed = {r[0]: r for r in rows}
    verdict["pages"] = sorted({p for i, p in enumerate(pages) if p is not None and (i not in stayed or stayed[i][7])})
    return rows, back, verdict


def _put_right_small(df: DataFrame, place: str, limit: float, share: float, rows_least: int, small: int) -> DataFrame:
    """df, sorted by _key and place, with _order, _done, _verdict (on one row of a statement) and _large, in one pass.

    At most small rows of a statement are held; those of a longer one come out as they are, marked _large.
    """
    date, page = df.schema["date"].dataType, df.schema["page_number"].dataType
    span = T.StructType([T.StructField("low", date), T.StructField("high", date)])
    said = T.StructType([T.StructField("is_inconsistent", T.BooleanType()), T.StructField("breaks", T.LongType()), T.StructField("ranges", T.ArrayType(span)), T.StructField("is_missing_data", T.BooleanType()), T.StructField("pages", T.ArrayType(page))])
    own = [f for f in df.schema.fields if f.name != "_key"]
    schema = T.StructType([*own, T.StructField("_order", T.LongType()), T.StructField("_done", T.ArrayType(T.StringType())), T.StructField("_verdict", said), T.StructField("_large", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lambda x: [float("nan") if v is None else v for v in x]

        def made(table: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
            """Whole statements, which begin at these places but the last."""
            at, pages = {f.name: table.column(f.name).to_pylist() for f in own if f.name in ("date", "transaction_note", "chq_num", "transaction_type", "amount", "balance")}, table.column("page_number").to_pylist()
            cells = list(zip(at["date"], at["transaction_note"], at["chq_num"], at["transaction_type"], known(at["amount"]), known(at["balance"])))
            take, kinds, amounts, balances, orders, dones, verdicts = [], [], [], [], [], [], []
            for i, j in zip(starts, starts[1:]):
                rows, back, verdict = _solved(cells[i:j], pages[i:j], limit, share, rows_least)
                stay = [(k, at["transaction_type"][i + k], at["amount"][i + k], at["balance"][i + k], k + 1, []) for k in range(j - i)]
                if rows is not None:
                    stay = [(r[0], r[4], r[5] if r[5] == r[5] else None, r[6] if r[6] == r[6] else None, -r[9] if back else r[9], r[7]) for r in rows]
                for k, kind, amount, balance, order, done in stay:
                    take.append(i + k)
                    kinds.append(kind)
                    amounts.append(amount)
                    balances.append(balance)
                    orders.append(order)
                    dones.append(done)
                verdicts += [verdict, *[None] * (len(stay) - 1)]
            yield from shaped(table.take(take), {"transaction_type": kinds, "amount": amounts, "balance": balances}, orders, dones, verdicts, False)

        def shaped(table: pa.Table, changed: dict, orders: list, dones: list, verdicts: list, large: bool) -> Iterator[pa.RecordBatch]:
            n, when = len(table), table.schema.field("date").type
            kept = {f.name: pa.array(changed[f.name], table.schema.field(f.name).type) if f.name in changed else table.column(f.name) for f in own}
            ranges = pa.list_(pa.struct([("low", when), ("high", when)]))
            verdict = pa.struct([("is_inconsistent", pa.bool_()), ("breaks", pa.int64()), ("ranges", ranges), ("is_missing_data", pa.bool_()), ("pages", pa.list_(table.schema.field("page_number").type))])
            kept |= {"_order": pa.array(orders, pa.int64()), "_done": pa.array(dones, pa.list_(pa.string())), "_verdict": pa.array(verdicts, verdict), "_large": pa.array([large] * n, pa.bool_())}
            yield from pa.table(kept).to_batches()

        def plain(table: pa.Table) -> Iterator[pa.RecordBatch]:
            n = len(table)
            yield from shaped(table, {}, [None] * n, [None] * n, [None] * n, True)

        held, large = None, None  # the open statement's rows so far; its key once it is known to be large
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            keys = np.asarray(table.column("_key").to_pylist(), object)
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
            ends = [*starts[1:], len(table)]
            whole = []  # ranges of whole small statements that follow each other
            for i, j in zip(starts, ends):
                last = j == len(table)
                if keys[i] == large or j - i > small:
                    large = keys[i]
                    if len(whole) > 1:
                        yield from made(table.slice(whole[0], whole[-1] - whole[0]), [w - whole[0] for w in whole])
                    whole = []
                    yield from plain(table.slice(i, j - i))
                elif not last:
                    whole = [*whole, j] if whole else [i, j]
            if len(whole) > 1:
                yield from made(table.slice(whole[0], whole[-1] - whole[0]), [w - whole[0] for w in whole])
            held = None if keys[-1] == large else table.slice(starts[-1])
        if held is not None:
            yield from made(held, [0, len(held)])

    return df.repartition("_key").sortWithinPartitions("_key", place).mapInArrow(run, schema)


def _put_right_large(df: DataFrame, key: str, place: str, limit: float, share: float, rows_least: int) -> tuple[DataFrame, DataFrame]:
    """merged_statements by rounds over tables, for statements of any number of rows."""
    given = written(df.withColumn("_key", _named([key])).withColumn("_given", F.row_number().over(Window.partitionBy("_key").orderBy(place)).cast("long")), "given")
    both = given.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_back"))
    both = both.withColumn("_way", F.concat_ws("|", F.col("_back").cast("string"), "_key")).withColumn("_place", F.when(F.col("_back") == 1, -F.col("_given")).otherwise(F.col("_given")))
    rows = both.withColumn("_done", F.array().cast("array<string>"))
    first = written(_repaired(rows.withColumn("_bad", F.lit(False)), limit), "repaired")
    n, bad = F.count("*"), F.count_if("_bad")
    early = first.groupBy("_way").agg(n.alias("_n"), bad.alias("_first_bad")).withColumn("_open", (F.col("_n") > 2) & ~((F.col("_first_bad") > share * F.col("_n")) & (F.col("_n") > rows_least)))
    left = first.join(early.where("_open").select("_way"), "_way", "left_semi")
    for _ in range(2):
        left = written(_repaired(_rechained(left), limit), "repaired")
    left_bad = left.groupBy("_way").agg(F.count_if("_bad").alias("_last_bad"))
    ways = early.join(left_bad, "_way", "left").withColumn("_breaks", F.when(F.col("_n") <= 2, F.lit(0)).when(F.col("_open"), F.col("_last_bad")).otherwise(F.col("_first_bad")))
    ways = ways.withColumn("_back", F.substring("_way", 1, 1).cast("int")).withColumn("_key", F.expr("substring(_way, 3)"))
    best = ways.groupBy("_key").agg(F.min(F.struct("_breaks", "_back")).alias("b"), F.first("_n").alias("_n"))
    best = written(best.select("_key", "b._breaks", "b._back", F.concat_ws("|", F.col("b._back").cast("string"), "_key").alias("_way"), "_n"), "best")

    # repeated blocks go where the balances tally without them
    right = left.join(best.where("_breaks = 0 AND _n > 2").select("_way"), "_way", "left_semi")
    thinner = written(without_repeats(right, ["_way"], ["_place"], ["date", "amount", "balance", "transaction_type", "transaction_note"], F.length(F.coalesce("transaction_note", F.lit(""))) < 3), "thinner")
    sound = first_break(thinner, "_way", "_place", "_given", limit).where(F.col("broken").isNull()).select("_way")
    right = thinner.join(sound, "_way", "left_semi").union(right.join(sound, "_way", "left_anti"))
    right = written(right.withColumn("_order", F.when(F.col("_back") == 1, -F.col("_place")).otherwise(F.col("_place"))), "right")
    names = [F.col(f"`{c}`") for c in df.columns]
    whole = given.join(right.select("_key").distinct(), "_key", "left_anti").withColumn("_done", F.array().cast("array<string>")).select(*names, F.col("_given").alias("_order"), "_done")
    out = whole.union(right.select(*names, "_order", "_done"))

    # verdicts: the chunks that the last repair leaves, or one for a statement of up to two rows
    early_out = first.join(early.where("NOT _open").select("_way", "_n"), "_way").withColumn("_bad", F.col("_bad") & (F.col("_n") > 2)).drop("_n")
    stays = left.unionByName(early_out).join(best.select("_way"), "_way", "left_semi")
    number = F.sum(F.col("_bad").cast("long")).over(Window.partitionBy("_key").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    heads = stays.withColumn("_chunk", number).groupBy("_key", "_chunk").agg(F.min_by("date", "_place").alias("low"), F.max_by("date", "_place").alias("high"))
    gap = F.datediff("low", F.lag("high").over(Window.partitionBy("_key").orderBy("_chunk"))) >= 1
    ranges = heads.withColumn("_gap", F.coalesce(gap, F.lit(False))).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_chunk", "low", "high"))).alias("r"), F.bool_or("_gap").alias("_gap"))
    kept = right.select("_key", F.col("_given").alias("_g"), "_done")
    touched = given.join(right.select("_key").distinct(), "_key").join(kept.withColumnRenamed("_key", "_k"), (F.col("_key") == F.col("_k")) & (F.col("_given") == F.col("_g")), "left")
    pages = touched.where(F.col("_g").isNull() | (F.size("_done") > 0)).groupBy("_key").agg(F.array_sort(F.collect_set("page_number")).alias("pages"))
    named = given.select("_key", F.col(f"`{key}`")).dropDuplicates(["_key"])
    broken = F.col("_breaks") > 0
    verdicts = named.join(best, "_key").join(ranges, "_key", "left").join(pages, "_key", "left")
    spans = F.transform("r", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high")))
    page_type = given.schema["page_number"].dataType
    return out, verdicts.select(
        F.col(f"`{key}`"), broken.alias("is_inconsistent"), F.col("_breaks").cast("long").alias("breaks"), spans.alias("ranges"), (broken & F.coalesce("_gap", F.lit(False))).alias("is_missing_data"), F.coalesce("pages", F.array().cast(T.ArrayType(page_type))).alias("pages")
    )
