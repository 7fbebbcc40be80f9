"""Queries of the statement repairs, over transactions with known damage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.model import by_account
from tallyloom.operators import repairs
from tallyloom.plans.registry import query, worn

_W = "WINDOW w AS (PARTITION BY account_id ORDER BY date, seq)"
_FLIP = "CASE WHEN transaction_type = 'debit' THEN 'credit' ELSE 'debit' END"
#: Some types, signs of balances and of amounts turned, some balances wrong; one account in nine has every second sign turned.
_TURNED = f"""SELECT account_id, seq, date, CASE WHEN seq % 7 = 3 THEN {_FLIP} ELSE transaction_type END AS transaction_type, CASE WHEN seq % 13 = 6 THEN -amount ELSE amount END AS amount,
  CASE WHEN seq % 11 = 5 OR (account_id % 9 = 0 AND seq % 2 = 0) THEN -balance WHEN seq % 17 = 7 THEN balance + 1000 ELSE balance END AS balance FROM txn"""
_NEAR = lambda x, y: f"abs(round({x}, 2) - round({y}, 2)) <= 0.1"
_STEPS = f"""r AS (SELECT *, row_number() OVER w AS k FROM given {_W}),
  walk AS (SELECT account_id, seq, k, transaction_type, amount, balance, transaction_type AS type, abs(amount) AS value, balance AS sum, amount < 0 AS pos, false AS typed, false AS turned, false AS inconsistent FROM r WHERE k = 1
    UNION ALL SELECT account_id, seq, k, transaction_type, amount, balance, CASE h WHEN 1 THEN 'credit' WHEN 4 THEN 'credit' WHEN 0 THEN transaction_type ELSE 'debit' END, a, CASE WHEN h > 2 THEN -balance ELSE balance END, amount < 0,
      h > 0 AND CASE WHEN h IN (1, 4) THEN 'credit' ELSE 'debit' END <> transaction_type, h > 2 AND balance <> 0, h = 0
    FROM (SELECT r.*, abs(r.amount) AS a, CASE WHEN {_NEAR('walk.sum + abs(r.amount)', 'r.balance')} THEN 1 WHEN {_NEAR('walk.sum - abs(r.amount)', 'r.balance')} THEN 2 WHEN {_NEAR('walk.sum - abs(r.amount)', '-r.balance')} THEN 3 WHEN {_NEAR('walk.sum + abs(r.amount)', '-r.balance')} THEN 4 ELSE 0 END AS h
      FROM walk JOIN r ON r.account_id = walk.account_id AND r.k = walk.k + 1)),
  counted AS (SELECT *, count(*) FILTER (turned) OVER (PARTITION BY account_id) AS t, count(*) OVER (PARTITION BY account_id) AS n, count(*) FILTER (typed) OVER (PARTITION BY account_id) AS c FROM walk),
  undone AS (SELECT *, (t / n > 0.2 AND n > 10) OR (t > 2 AND n <= 10) AS undo FROM counted)"""


@query(
    f"WITH given AS ({_TURNED}), {_STEPS} SELECT seq, CASE WHEN undo THEN transaction_type ELSE type END AS type, CASE WHEN undo THEN amount ELSE value END AS value, CASE WHEN undo THEN balance ELSE sum END AS sum, CASE WHEN undo THEN '' ELSE concat_ws(',', CASE WHEN pos THEN 'AMOUNT_MADE_POSITIVE' END, CASE WHEN typed THEN 'TRANSACTION_TYPE_CHANGED' END, CASE WHEN turned THEN 'BALANCE_SIGN_CHANGED' END) END AS optimizations, inconsistent FROM undone",
    recursive=True,
)
def win_7_type_and_sign_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = repairs.repair_types(worn(spark, sf_dir, _TURNED), "account_id", ["date", "seq"])
    return r.select("seq", "type", "value", "sum", F.array_join("optimizations", ",").alias("optimizations"), "inconsistent")


#: One account in three with some types turned, one with all, and one with wrong balances as well.
_TYPES = f"SELECT account_id, seq, date, CASE WHEN (account_id % 3 = 0 AND seq % 5 = 2) OR account_id % 3 = 1 OR seq % 19 = 4 THEN {_FLIP} ELSE transaction_type END AS transaction_type, amount, CASE WHEN account_id % 3 = 2 AND seq % 23 = 1 THEN balance + 500 ELSE balance END AS balance FROM txn"


@query(
    f"""WITH given AS ({_TYPES}), {_STEPS}, f AS (SELECT *, CASE WHEN undo THEN transaction_type WHEN k = 1 AND n > 1 AND c = n - 1 THEN CASE WHEN type = 'credit' THEN 'debit' ELSE 'credit' END ELSE type END AS final FROM undone),
    b AS (SELECT *, coalesce(abs(round(lag(balance) OVER w + CASE WHEN transaction_type = 'debit' THEN -amount ELSE amount END, 2) - round(balance, 2)) > 0.1, false) AS bad, coalesce(abs(round(lag(CASE WHEN undo THEN balance ELSE sum END) OVER w + CASE WHEN final = 'debit' THEN -value ELSE value END, 2) - round(CASE WHEN undo THEN balance ELSE sum END, 2)) > 0.1, false) AS still FROM f WINDOW w AS (PARTITION BY account_id ORDER BY k))
    SELECT seq, CASE WHEN bool_or(bad) OVER (PARTITION BY account_id) AND NOT bool_or(still) OVER (PARTITION BY account_id) THEN final ELSE transaction_type END AS type FROM b""",
    recursive=True,
)
def win_8_optimised_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.optimised(worn(spark, sf_dir, _TYPES), "account_id", ["date", "seq"]).select("seq", "type")


_REFUNDS = "SELECT account_id, seq, date, CASE WHEN seq % 2 = 0 THEN 'debit' ELSE transaction_type END AS transaction_type, CASE WHEN seq % 3 <> 0 THEN 'refund' ELSE 'upi' END AS transaction_channel, CASE WHEN seq % 4 = 0 THEN -amount ELSE amount END AS amount, balance FROM txn"


@query(f"WITH g AS ({_REFUNDS}) SELECT seq, CASE WHEN transaction_channel = 'refund' AND transaction_type = 'debit' AND round(lag(balance) OVER w + abs(amount), 2) = round(balance, 2) THEN 'credit' ELSE transaction_type END AS type FROM g {_W}")
def win_8_refund_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worn(spark, sf_dir, _REFUNDS).select("seq", repairs.refunds_as_credits(by_account()).alias("type"))


#: Statements in their own order: as they are, reversed, of a single date, of a single date reversed; some balances wrong.
_ORDERED = """SELECT account_id, seq, CASE WHEN account_id % 4 >= 2 THEN CAST('2020-01-01' AS TIMESTAMP) ELSE date END AS date, transaction_type, amount, CASE WHEN account_id % 5 = 0 AND seq % 9 = 4 THEN balance + 7 ELSE balance END AS balance,
  CASE WHEN account_id % 2 = 1 THEN -row_number() OVER (PARTITION BY account_id ORDER BY date, seq) ELSE row_number() OVER (PARTITION BY account_id ORDER BY date, seq) END AS place FROM txn"""
_SIGNED = "CASE WHEN transaction_type = 'debit' THEN -amount ELSE amount END"
_ORIENTED = f"""g AS ({_ORDERED}), m AS (SELECT *, abs(lag(balance) OVER p + {_SIGNED} - balance) <= 0.1 AS f, abs(balance + lag({_SIGNED}) OVER p - lag(balance) OVER p) <= 0.1 AS b FROM g WINDOW p AS (PARTITION BY account_id ORDER BY place)),
  o AS (SELECT account_id, CASE WHEN arg_min(date, place) < arg_max(date, place) THEN 'correct' WHEN arg_min(date, place) > arg_max(date, place) THEN 'reverse' WHEN coalesce(bool_and(b), true) AND NOT coalesce(bool_and(f), true) THEN 'reverse' ELSE 'correct' END AS date_order FROM m GROUP BY 1)"""


@query(f"WITH {_ORIENTED} SELECT * FROM o")
def win_10_date_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.orientation(worn(spark, sf_dir, _ORDERED), "account_id", "place")


@query(
    f"""WITH {_ORIENTED}, t AS (SELECT g.*, CASE date_order WHEN 'reverse' THEN -place ELSE place END AS p FROM g JOIN o USING (account_id)),
    x AS (SELECT *, coalesce(abs(round(lag(balance) OVER u + {_SIGNED}, 2) - round(balance, 2)) > 0.1, false) AS up, coalesce(abs(round(lag(balance) OVER d + {_SIGNED}, 2) - round(balance, 2)) > 0.1, false) AS down FROM t WINDOW u AS (PARTITION BY account_id ORDER BY p), d AS (PARTITION BY account_id ORDER BY p DESC))
    SELECT account_id, CASE WHEN count(DISTINCT date) = 1 AND NOT bool_or(down) THEN NULL ELSE arg_min(seq, p) FILTER (up) END AS broken FROM x GROUP BY 1"""
)
def win_5_balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.first_break(worn(spark, sf_dir, _ORDERED), "account_id", "place", "seq")


_BLANKS = """SELECT account_id, seq, date, transaction_type, amount, CASE WHEN row_number() OVER (PARTITION BY account_id ORDER BY date, seq) < (account_id % 7) * 3 OR seq % 3 = 1 THEN NULL ELSE balance END AS balance, CASE WHEN account_id % 2 = 0 THEN 100.0 END AS opening FROM txn"""


@query(
    f"""WITH g AS ({_BLANKS}), s AS (SELECT *, sum({_SIGNED}) OVER r AS total FROM g WINDOW r AS (PARTITION BY account_id ORDER BY date, seq ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT *, coalesce(balance, round(coalesce(last_value(balance - total IGNORE NULLS) OVER r, opening) + total, 2)) AS filled FROM s WINDOW r AS (PARTITION BY account_id ORDER BY date, seq ROWS UNBOUNDED PRECEDING))
    SELECT seq, filled AS balance FROM f QUALIFY count(*) FILTER (filled IS NULL) OVER (PARTITION BY account_id) / count(*) OVER (PARTITION BY account_id) <= 0.7"""
)
def win_18_front_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.front_filled(worn(spark, sf_dir, _BLANKS), "account_id", ["date", "seq"], F.col("opening")).select("seq", "balance")


_EMPTIED = """SELECT account_id, seq, date, CASE WHEN seq % 5 = 0 THEN 'debit' ELSE transaction_type END AS transaction_type, CASE WHEN seq % 5 = 0 AND seq % 2 = 0 THEN abs(lag(balance) OVER (PARTITION BY account_id ORDER BY date, seq)) WHEN seq % 5 = 1 AND seq % 2 = 0 THEN abs(balance) ELSE amount END AS amount,
  CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 31 = 2 THEN 0 ELSE balance END AS balance FROM txn"""


@query(
    f"""WITH g AS ({_EMPTIED}), s AS (SELECT *, {_SIGNED} AS v FROM g), n AS (SELECT *, lag(balance) OVER w AS pb, lead(balance) OVER w AS nb, lead(v) OVER w AS nv FROM s {_W})
    SELECT seq, CASE WHEN balance IS NULL AND coalesce(CASE WHEN pb <> 0 AND v <> 0 THEN round(pb + v, 2) END, CASE WHEN nb <> 0 AND nv <> 0 THEN round(nb - nv, 2) END) = 0 THEN 0.0 ELSE balance END AS balance FROM n"""
)
def win_19_blank_is_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worn(spark, sf_dir, _EMPTIED).select("seq", repairs.blank_is_zero(by_account()).alias("balance"))


_YEARLESS = "SELECT account_id, seq, date AS real, CAST(concat('2020-', substr(CAST(date AS STRING), 6)) AS TIMESTAMP) AS date FROM txn WHERE NOT (account_id % 2 = 0 AND month(date) = 2 AND day(date) = 29)"


@query(
    f"""WITH g AS ({_YEARLESS}), c AS (SELECT *, coalesce(CAST(month(date) <> lag(month(date)) OVER (PARTITION BY account_id ORDER BY real, seq) AS INTEGER), 0) AS change FROM g),
    y AS (SELECT *, CAST(floor(sum(change) OVER (PARTITION BY account_id ORDER BY real, seq ROWS UNBOUNDED PRECEDING) / 12) AS INTEGER) AS years FROM c),
    l AS (SELECT *, bool_or(month(date) = 2 AND day(date) = 29 AND years % 4 <> 0) OVER (PARTITION BY account_id) AS lost FROM y)
    SELECT seq, strftime(CASE WHEN lost THEN date ELSE date + to_years(years) END, '%Y-%m-%d %H:%M') AS moved FROM l"""
)
def win_22_later_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = repairs.later_dates(worn(spark, sf_dir, _YEARLESS), "account_id", ["real", "seq"])
    return moved.select("seq", F.date_format("date", "yyyy-MM-dd HH:mm").alias("moved"))


#: Each row of some accounts is followed by a credit that undoes it.
_UNDONE = """SELECT account_id, seq * 2 + half AS seq, date, CASE WHEN half = 1 THEN 'credit' ELSE transaction_type END AS transaction_type, amount, CASE WHEN half = 1 THEN round(balance + CASE WHEN transaction_type = 'debit' THEN amount ELSE -amount END, 2) ELSE balance END AS balance,
  CASE WHEN seq % 5 = 0 THEN 'refund' WHEN seq % 5 = 1 THEN 'Other' WHEN seq % 5 = 2 THEN 'inward_cheque_bounce' ELSE transaction_channel END AS transaction_channel, CASE WHEN half = 1 AND seq % 7 = 0 THEN 'other note' ELSE transaction_note END AS transaction_note
  FROM (SELECT *, 0 AS half FROM txn UNION ALL SELECT *, 1 AS half FROM txn)"""


@query(
    f"""WITH g AS ({_UNDONE}) SELECT seq, coalesce(transaction_type = 'credit' AND lag(transaction_type) OVER w = 'debit' AND lag(date) OVER w = date AND lag(transaction_note) OVER w = transaction_note AND transaction_channel NOT IN ('refund', 'inward_cheque_bounce') AND lag(balance, 2) OVER w = balance, false) AS refund FROM g {_W}"""
)
def win_23_same_balance_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worn(spark, sf_dir, _UNDONE).select("seq", repairs.same_balance_refund(by_account()).alias("refund"))


@query(
    f"""WITH g AS ({_UNDONE}), p AS (SELECT *, floor((row_number() OVER (PARTITION BY account_id, transaction_note, amount ORDER BY date, seq) - 1) / 2) AS pair, (row_number() OVER (PARTITION BY account_id, transaction_note, amount ORDER BY date, seq) - 1) % 2 AS half FROM g),
    q AS (SELECT a.seq AS s1, b.seq AS s2, a.transaction_type AS t1, b.transaction_type AS t2 FROM p a JOIN p b ON a.account_id = b.account_id AND a.transaction_note = b.transaction_note AND a.amount = b.amount AND a.pair = b.pair AND a.half = 0 AND b.half = 1
      WHERE a.transaction_channel IN ('Other', 'auto_debit_payment') AND b.transaction_channel NOT IN ('refund', 'inward_cheque_bounce') AND ((a.transaction_type = 'debit' AND b.transaction_type = 'credit' AND a.balance < 0) OR (a.transaction_type = 'credit' AND b.transaction_type = 'debit' AND b.balance < 0))),
    h AS (SELECT s1 AS seq, t1 AS t FROM q UNION ALL SELECT s2, t2 FROM q) SELECT g.seq, h.t AS bounce FROM g LEFT JOIN h USING (seq)"""
)
def win_25_bounced_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs.bounced_pairs(worn(spark, sf_dir, _UNDONE), "account_id", ["date", "seq"]).select("seq", "bounce")


_CREDITS = "SELECT account_id, seq, date FROM txn WHERE transaction_type = 'credit' OR account_id % 2 = 0"


def _gaps_sql(low: int, high: int, share: int) -> str:
    return f"""SELECT account_id, count(*) FILTER (odd) * {share} <= count(*) AS regular FROM walk GROUP BY 1""".replace("walk", f"walk_{low}_{high}")


def _walk_sql(low: int, high: int) -> str:
    return f"""walk_{low}_{high} AS (SELECT account_id, k, date, month, false AS odd, CAST(NULL AS VARCHAR) AS c1, CAST(NULL AS VARCHAR) AS c2 FROM r WHERE k = 1
      UNION ALL SELECT account_id, k, date, month, odd, CASE WHEN odd THEN later ELSE c1 END, CASE WHEN odd THEN month ELSE c2 END FROM (SELECT r.*, w.month AS later, w.c1, w.c2,
        NOT (date_diff('second', r.date, w.date) // 86400 BETWEEN {low} AND {high}) AND coalesce(w.month NOT IN (w.c1, w.c2) AND r.month NOT IN (w.c1, w.c2), true) AS odd FROM walk_{low}_{high} w JOIN r ON r.account_id = w.account_id AND r.k = w.k + 1))"""


@query(
    f"""WITH g AS ({_CREDITS}), r AS (SELECT account_id, date, strftime(date, '%Y-%m') AS month, row_number() OVER (PARTITION BY account_id ORDER BY date DESC) AS k FROM g), {_walk_sql(25, 35)}, {_walk_sql(20, 400)},
    h AS ({_gaps_sql(25, 35, 6)}), e AS ({_gaps_sql(20, 400, 4)}) SELECT h.account_id, h.regular AS hard, e.regular AS easy FROM h JOIN e USING (account_id)""",
    recursive=True,
)
def win_30_salary_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = worn(spark, sf_dir, _CREDITS)
    hard, easy = repairs.salary_gaps(rows, "account_id", 25, 35, 1 / 6), repairs.salary_gaps(rows, "account_id", 20, 400, 1 / 4)
    return hard.withColumnRenamed("regular", "hard").join(easy.withColumnRenamed("regular", "easy"), "account_id")


_UNDATED = "SELECT account_id, seq, date AS real, CASE WHEN seq % 3 = 0 OR account_id % 4 = 1 AND seq % 2 = 0 THEN CAST('1970-01-01' AS TIMESTAMP) ELSE date END AS date FROM txn"


@query(f"WITH g AS ({_UNDATED}) SELECT seq, strftime(coalesce(last_value(CASE WHEN date <> TIMESTAMP '1970-01-01' THEN date END IGNORE NULLS) OVER (PARTITION BY account_id ORDER BY real, seq ROWS UNBOUNDED PRECEDING), date), '%Y-%m-%d') AS day FROM g")
def win_34_carried_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("account_id").orderBy("real", "seq")
    return worn(spark, sf_dir, _UNDATED).select("seq", F.date_format(repairs.carried_dates(w, F.lit("1970-01-01").cast("timestamp")), "yyyy-MM-dd").alias("day"))


_CELLS = """SELECT account_id, seq, date, seq % 3 <> 1 AS has_balance, CASE seq % 3 WHEN 0 THEN CAST(1 + seq % 28 AS STRING) WHEN 1 THEN CASE WHEN seq % 4 = 0 THEN 'May' ELSE 'Xyz' END ELSE '2021' END AS date_cell,
  CASE WHEN seq % 2 = 0 THEN 'a note' END AS note, CASE seq % 5 WHEN 0 THEN 'INR 1,200.' WHEN 1 THEN '35' WHEN 2 THEN '4,100' WHEN 3 THEN '.77' ELSE '9.10' END AS balance_cell FROM txn"""


@query(
    f"""WITH g AS ({_CELLS}), n AS (SELECT *, lead(date_cell) OVER w AS c1, lead(date_cell, 2) OVER w AS c2 FROM g WINDOW w AS (PARTITION BY account_id ORDER BY seq))
    SELECT seq, CASE WHEN has_balance AND length(date_cell) < 3 AND length(c2) = 4 THEN strftime(try_strptime(date_cell || ' ' || c1 || ' ' || c2, '%d %b %Y'), '%Y-%m-%d') END AS day FROM n"""
)
def bnk_4_three_row_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("account_id").orderBy("seq")
    return worn(spark, sf_dir, _CELLS).select("seq", F.date_format(repairs.three_row_dates(w), "yyyy-MM-dd").alias("day"))


@query(
    f"""WITH g AS ({_CELLS}), n AS (SELECT *, lead(balance_cell) OVER (PARTITION BY account_id ORDER BY seq) AS ahead FROM g)
    SELECT seq, CASE WHEN (regexp_matches(balance_cell, '^(INR +)?[0-9,]+\\.$') AND regexp_matches(ahead, '^[0-9][0-9]$')) OR (regexp_matches(balance_cell, '^(INR +)?[0-9,]+$') AND regexp_matches(ahead, '^\\.[0-9][0-9]$')) THEN balance_cell || ahead ELSE balance_cell END AS balance_cell FROM n"""
)
def bnk_3_split_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("account_id").orderBy("seq")
    pairs = [(r"^(?:INR\s+)?[0-9,]+\.$", r"^\d{2}$"), (r"^(?:INR\s+)?[0-9,]+$", r"^\.\d{2}$")]
    return worn(spark, sf_dir, _CELLS).select("seq", repairs.split_numbers(w, pairs).alias("balance_cell"))


_LINES = "SELECT account_id, seq, CASE WHEN seq % 7 IN (0, 1, 2, 4) THEN '01/02/2021' ELSE concat('text ', seq) END AS date_cell, seq % 7 IN (0, 5) AS has_amount, 'own' AS note FROM txn"


@query(
    f"""WITH g AS ({_LINES}), r AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY seq) AS k, date_cell LIKE '%/%' AS dated FROM g),
    walk AS (SELECT account_id, seq, k, dated, date_cell, note, false AS gone FROM r WHERE k = 1 UNION ALL SELECT r.account_id, r.seq, r.k, r.dated, r.date_cell, r.note, NOT w.gone AND w.dated AND NOT r.has_amount FROM walk w JOIN r ON r.account_id = w.account_id AND r.k = w.k + 1)
    SELECT seq, CASE WHEN next_gone THEN next_cell ELSE note END AS note FROM (SELECT *, lead(gone) OVER w AS next_gone, lead(date_cell) OVER w AS next_cell FROM walk WINDOW w AS (PARTITION BY account_id ORDER BY k)) WHERE NOT gone""",
    recursive=True,
)
def bnk_5_notes_from_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = worn(spark, sf_dir, _LINES)
    return repairs.notes_from_dates(g, "account_id", ["seq"], F.col("date_cell").rlike("^[0-9]+/"), F.col("has_amount")).select("seq", "note")


#: Notes read short, some as a single sign; and the page's lines: heads, whole notes, sometimes too few.
_SHORT = """SELECT statement_id, seq, date, k, n, CASE WHEN k % 4 = 0 AND account_id % 2 = 0 THEN 'x' WHEN account_id % 7 = 3 THEN 'none of them' ELSE lower(substr(transaction_note, 1, 14 + CAST(account_id % 20 AS INTEGER))) END AS note, transaction_note, account_id
  FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY date, seq) - 1 AS k, count(*) OVER (PARTITION BY statement_id) AS n FROM txn) t"""
_PAGE_LINES = f"""SELECT statement_id, k + account_id % 3 AS place, transaction_note AS line FROM ({_SHORT}) s WHERE NOT (account_id % 5 = 1 AND k = n - 1) UNION ALL SELECT statement_id, 0 - 1 AS place, 'head of the page' AS line FROM ({_SHORT}) s WHERE k = 0 AND account_id % 6 <> 2"""


@query(
    f"""WITH s AS ({_SHORT}), l AS (SELECT statement_id, line, row_number() OVER (PARTITION BY statement_id ORDER BY place, line) - 1 AS p, count(*) OVER (PARTITION BY statement_id) AS lines FROM ({_PAGE_LINES}) x),
    j AS (SELECT s.statement_id, s.k, s.n, min(l.p) AS j, max(l.lines) AS lines FROM s JOIN l ON l.statement_id = s.statement_id AND contains(upper(l.line), upper(s.note)) WHERE length(s.note) > 1 GROUP BY 1, 2, 3),
    o AS (SELECT statement_id, arg_min(j - k, k) AS d FROM j WHERE lines > j - k + n - 1 GROUP BY 1)
    SELECT s.seq, CASE WHEN o.d >= 0 THEN l.line ELSE s.note END AS note FROM s LEFT JOIN o ON o.statement_id = s.statement_id LEFT JOIN l ON l.statement_id = s.statement_id AND l.p = o.d + s.k"""
)
def bnk_12_aligned_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repairs.aligned_notes(worn(spark, sf_dir, _SHORT), worn(spark, sf_dir, _PAGE_LINES), ["statement_id"], ["date", "seq"], "note", "line", "place")
    return out.select("seq", "note")
