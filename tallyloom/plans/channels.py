"""Queries of the transaction classifiers: channels, descriptions, self transfers, categories, cached results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.model import shared, table, transactions
from tallyloom.operators import channels, rules
from tallyloom.operators.stages import Enrichments, Stage
from tallyloom.plans.registry import query, worn

#: Transactions whose notes, amounts and types make every branch of the channel rules fire; the same text in both engines.
_NOTES = """SELECT seq, account_id, date, CASE WHEN seq % 29 = 28 THEN 'other' ELSE transaction_type END AS transaction_type,
  CASE seq % 6 WHEN 0 THEN 17.7 WHEN 1 THEN 2999.5 WHEN 2 THEN 4999.5 WHEN 3 THEN 60000.0 ELSE amount END AS amount,
  CASE seq % 23 WHEN 0 THEN 'salary june' WHEN 1 THEN 'ADVANCE SALARY' WHEN 2 THEN 'SAL/ACME 7' WHEN 3 THEN 'ACME SAL' WHEN 4 THEN 'Atm wdl 77' WHEN 5 THEN 'min bal chrg' WHEN 6 THEN 'NEFT to b'
    WHEN 7 THEN 'cc interest' WHEN 8 THEN 'WAGES MAY' WHEN 9 THEN 'WAGES OF ADVANCE SALARIES' WHEN 10 THEN 'payroll x' WHEN 11 THEN 'payroll early' WHEN 12 THEN ' upi/9/é ' WHEN 13 THEN 'REVERSAL of upi/9' WHEN 14 THEN NULL
    ELSE transaction_note END AS transaction_note FROM txn"""
_DEBIT = [("salary_paid", ["WAGES"]), ("bank_charge", ["MIN BAL", "CHRG"]), ("cc_interest", ["CC INTEREST"]), ("cash_withdrawl", ["^ATM", "CASH"]), ("net_banking_transfer", ["NEFT", "TRANSFER"]), ("upi", ["^UPI/"])]
_CREDIT = [("reversal", ["REVERSAL"]), ("salary", ["PAYROLL"]), ("net_banking_transfer", ["NEFT"]), ("upi", ["^UPI/"])]
_CHARGES, _SKIP_DEBIT, _SKIP_CREDIT = [17.7, 59.0], ["ADVANCE"], ["ADVANCE", "EARLY"]


def _mark_sql(skip: list[str]) -> str:
    ignored = " OR ".join(f"contains(replace(n, ' ', ''), '{w}')" for w in skip)
    word = "CASE WHEN contains(n, 'SALARY') THEN 'SALARY' WHEN contains(n, 'SALARIE') THEN 'SALARIE' END"
    return f"CASE WHEN {word} IS NOT NULL THEN CASE WHEN NOT ({ignored}) THEN {word} END WHEN regexp_matches(n, '^SAL[^A-Za-z]+') THEN '^SAL' WHEN regexp_matches(n, '[^a-zA-Z]SAL$') THEN 'SAL$' END"


_CHANNEL_SQL = f"""notes AS ({_NOTES}),
  n AS (SELECT *, trim(upper(regexp_replace(transaction_note, '[^\\x00-\\x7F]', ' ', 'g'))) AS n FROM notes),
  m AS (SELECT *, {_mark_sql(_SKIP_DEBIT)} AS md, {_mark_sql(_SKIP_CREDIT)} AS mc, amount IN (17.7, 59.0) AS fee FROM n),
  found AS (SELECT *, CASE WHEN transaction_type = 'debit' THEN CASE
      WHEN amount < 5000 AND contains(n, 'WAGES') THEN 'salary_paid|WAGES'
      WHEN amount >= 5000 AND md IS NOT NULL THEN 'salary_paid|' || md
      WHEN amount >= 5000 AND contains(n, 'WAGES') AND NOT contains(replace(n, ' ', ''), 'ADVANCE') THEN 'salary_paid|'
      WHEN amount <= 50000 AND contains(n, 'MIN BAL') THEN 'bank_charge|MIN BAL'
      WHEN amount <= 50000 AND contains(n, 'CHRG') THEN 'bank_charge|CHRG'
      WHEN starts_with(n, 'ATM') THEN CASE WHEN fee THEN 'bank_charge|^ATM' ELSE 'cash_withdrawl|^ATM' END
      WHEN contains(n, 'CASH') THEN CASE WHEN fee THEN 'bank_charge|CASH' ELSE 'cash_withdrawl|CASH' END
      WHEN contains(n, 'NEFT') THEN CASE WHEN fee THEN 'bank_charge|NEFT' ELSE 'net_banking_transfer|NEFT' END
      WHEN contains(n, 'TRANSFER') THEN CASE WHEN fee THEN 'bank_charge|TRANSFER' ELSE 'net_banking_transfer|TRANSFER' END
      WHEN starts_with(n, 'UPI/') THEN 'upi|^UPI/' ELSE 'Other|' END
    WHEN transaction_type = 'credit' THEN CASE
      WHEN contains(n, 'REVERSAL') THEN 'reversal|REVERSAL'
      WHEN amount > 3000 AND mc IS NOT NULL THEN 'salary|' || mc
      WHEN amount > 3000 AND contains(n, 'PAYROLL') AND NOT (contains(replace(n, ' ', ''), 'ADVANCE') OR contains(replace(n, ' ', ''), 'EARLY')) THEN 'salary|PAYROLL'
      WHEN contains(n, 'NEFT') THEN 'net_banking_transfer|NEFT'
      WHEN starts_with(n, 'UPI/') THEN 'upi|^UPI/' ELSE 'Other|' END
    ELSE '|' END AS f FROM m)"""


@query(f"WITH {_CHANNEL_SQL} SELECT seq, split_part(f, '|', 1) AS transaction_channel, split_part(f, '|', 2) AS transaction_channel_regex FROM found")
def sca_26_27_28_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = channels.channel(worn(spark, sf_dir, _NOTES), _DEBIT, _CREDIT, _CHARGES, _SKIP_DEBIT, _SKIP_CREDIT)
    return t.select("seq", "transaction_channel", "transaction_channel_regex")


#: The same with the account's category and country, notes that hold ACH as a word or a part, and payees to capture.
_KEPT = f"""SELECT seq, account_id, date, transaction_type, amount, CASE WHEN seq % 31 = 3 THEN 'ach-debit of a' WHEN seq % 31 = 4 THEN 'teacher 7' WHEN seq % 31 = 5 THEN 'PAID TO: ann lee /9' WHEN seq % 31 = 6 THEN 'from bob rd' ELSE transaction_note END AS transaction_note,
  CASE account_id % 4 WHEN 0 THEN 'overdraft' WHEN 1 THEN 'individual' WHEN 2 THEN 'corporate' END AS category, CASE account_id % 3 WHEN 0 THEN 'ID' WHEN 1 THEN 'IN' END AS country FROM ({_NOTES}) x"""
_KEPT_DEBIT = [("salary_paid", ["WAGES"]), ("auto_debit_payment", ["ACH"]), *_DEBIT[1:]]
_KEPT_SQL = _CHANNEL_SQL.replace(f"notes AS ({_NOTES})", f"notes AS ({_KEPT})").replace("amount >= 5000 AND", "coalesce(category, '') <> 'individual' AND amount >= 5000 AND").replace("amount <= 50000 AND", "(amount <= 50000 OR coalesce(country, '') = 'ID') AND")
_KEPT_SQL = _KEPT_SQL.replace("      WHEN (amount <= 50000 OR coalesce(country, '') = 'ID') AND contains(n, 'MIN BAL')", "      WHEN regexp_matches(n, '\\bACH\\b') THEN 'auto_debit_payment|ACH'\n      WHEN (amount <= 50000 OR coalesce(country, '') = 'ID') AND contains(n, 'MIN BAL')")
_KEPT_SQL = _KEPT_SQL.replace("      WHEN starts_with(n, 'ATM')", "      WHEN category = 'overdraft' AND contains(n, 'CC INTEREST') THEN 'cc_interest|CC INTEREST'\n      WHEN starts_with(n, 'ATM')")


@query(
    f"""WITH {_KEPT_SQL}, u AS (SELECT *, upper(regexp_replace(transaction_note, '[^\\x00-\\x7F]', ' ', 'g')) AS t FROM found)
    SELECT seq, split_part(f, '|', 1) AS transaction_channel, split_part(f, '|', 2) AS transaction_channel_regex,
      CASE WHEN transaction_type = 'debit' AND regexp_matches(t, 'PAID TO: ([A-Z ]+)') THEN regexp_extract(t, 'PAID TO: ([A-Z ]+)', 1) WHEN transaction_type = 'debit' AND regexp_matches(t, '^UPI/([^/]+)/') THEN regexp_extract(t, '^UPI/([^/]+)/', 1)
        WHEN transaction_type = 'credit' AND regexp_matches(t, 'FROM ([A-Z]+)') THEN regexp_extract(t, 'FROM ([A-Z]+)', 1) ELSE '' END AS unclean_merchant FROM u"""
)
def sca_26_27_account_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels by the category and country of each account, and the merchant that the note names."""
    t = channels.channel(worn(spark, sf_dir, _KEPT), _KEPT_DEBIT, _CREDIT, _CHARGES, _SKIP_DEBIT, _SKIP_CREDIT, F.col("category"), F.col("country"))
    payee = channels.merchant(["PAID TO: ([A-Z ]+)", "^UPI/([^/]+)/"], ["FROM ([A-Z]+)"])
    return t.select("seq", "transaction_channel", "transaction_channel_regex", payee.alias("unclean_merchant"))


_CHANNELS = ["salary", "refund", "cash_withdrawl", "cash_deposit", "bank_charge", "inward_cheque_bounce", "auto_debit_payment", "net_banking_transfer", "upi", "bi_fast", "Other"]
_LISTS = {
    "deposit_by_machine": ["CDM"], "chq_bounce_insuff_funds": ["INSUFF"], "chq_technical_bounce": ["SIGNATURE"], "minimum_balance_charge": ["MIN BAL"], "sms_charge": ["SMS"], "pension": ["PENSION"], "gst": ["GST"],
    "cash_back": ["CASHBACK"], "fixed_deposit": ["\\bFD\\b"], "dividend": ["DIV"], "crypto": ["COIN"], "credit_card_bill": ["CARD BILL"], "telco_bill": ["MOBILE"], "share_purchase": ["SHARES"], "rent_received": ["RENT"], "share_sell": ["SHARES"],
}
_WORDS = ["CDM 7", "Insuff funds", "signature differs", "min bal fee", "sms fee", "pension june", "gst paid", "cashback x", "fd 12", "div z", "bitcoin", "card bill", "mobile top", "shares y", "rent may", "nothing here", "mr ann lee pvt"]
_DESCRIBED = f"""SELECT seq, transaction_type, amount, CASE seq % 11 {' '.join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CHANNELS))} END AS transaction_channel,
  CASE (seq * 7 + account_id) % 17 {' '.join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(_WORDS))} END AS transaction_note,
  CASE (seq + account_id) % 9 WHEN 0 THEN 'investments' WHEN 1 THEN 'insurance' WHEN 2 THEN 'mutual_funds' WHEN 3 THEN 'home_loan' ELSE '' END AS merchant_category,
  CASE (seq + 3 * account_id) % 5 WHEN 0 THEN 'ann lee shop' WHEN 1 THEN 'Zed' WHEN 2 THEN '' WHEN 3 THEN 'Bob & Co' END AS unclean_merchant,
  (seq * 3 + account_id) % 7 = 0 AS is_lender FROM txn"""


def _listed(*names: str) -> str:
    pick = " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{name}'" for name in names for p in _LISTS.get(name, []))
    return f"CASE {pick} END"


_DESCRIPTION_SQL = f"""given AS ({_DESCRIBED}), d AS (SELECT *, upper(transaction_note) AS n, transaction_channel IN ('inward_cheque_bounce') AS bounce,
    CASE WHEN coalesce(unclean_merchant, '') <> '' THEN CASE transaction_type WHEN 'debit' THEN 'Transfer to ' || unclean_merchant ELSE 'Transfer from ' || unclean_merchant END END AS transfer,
    contains(CASE WHEN length(unclean_merchant) > 3 THEN lower(unclean_merchant) ELSE lower(transaction_note) END, 'ann lee') AS own FROM given),
  f AS (SELECT *, CASE WHEN transaction_channel = 'bank_charge' THEN {_listed('minimum_balance_charge', 'sms_charge')} WHEN is_lender THEN 'lender_transaction' WHEN transaction_channel = 'auto_debit_payment' THEN 'unidentified_obligation'
      WHEN transaction_channel IN ('net_banking_transfer', 'upi', 'bi_fast') THEN CASE WHEN own THEN 'self_transfer' END
      ELSE coalesce(CASE WHEN bounce THEN {_listed('chq_bounce_insuff_funds', 'chq_technical_bounce')} END, CASE WHEN transaction_type = 'credit' THEN {_listed('pension')} END, {_listed('gst')}) END AS f1 FROM d),
  described AS (SELECT *, coalesce(CASE WHEN transaction_channel IN ('salary', 'refund') THEN transfer WHEN transaction_channel = 'cash_withdrawl' THEN NULL WHEN transaction_channel = 'cash_deposit' THEN {_listed('deposit_by_machine')}
      WHEN merchant_category IN ('investments', 'insurance', 'mutual_funds') THEN merchant_category
      WHEN f1 IS NOT NULL AND (f1 <> 'unidentified_obligation' OR transaction_type = 'credit') THEN f1
      ELSE coalesce(CASE WHEN f1 IS NULL THEN {_listed('cash_back', 'fixed_deposit', 'dividend', 'crypto')} END, CASE WHEN transaction_type = 'debit' THEN coalesce({_listed('credit_card_bill', 'telco_bill')}, {_listed('share_purchase')}) ELSE {_listed('rent_received', 'share_sell')} END, CASE WHEN NOT bounce THEN transfer END) END, '') AS description FROM f)"""


@query(f"WITH {_DESCRIPTION_SQL} SELECT seq, description FROM described")
def sca_31_32_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = worn(spark, sf_dir, _DESCRIBED)
    own = channels.self_transfer(F.lit("Mr Ann Lee Pvt S/O Bob 12"), F.col("unclean_merchant"), F.col("transaction_note"), fuzzy=False)
    return channels.description(t, _LISTS, own).select("seq", "description")


_HOLDERS = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Mr. Ann  Lee S/O Old Lee' WHEN 1 THEN 'Acme Private Limited' WHEN 2 THEN 'Bob The 3rd' ELSE 'Jo Ltd' END AS holder,
  CASE c_custkey % 5 WHEN 0 THEN 'ANN LEE STORE' WHEN 1 THEN 'acme' WHEN 2 THEN NULL WHEN 3 THEN 'xy' ELSE 'bob rd' END AS merchant,
  CASE c_custkey % 3 WHEN 0 THEN 'to acme now' WHEN 1 THEN 'jo ltd/7' ELSE 'pay Bob Rd' END AS note FROM customer"""


@query(
    f"""WITH h AS ({_HOLDERS}), c AS (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'ann lee' WHEN 1 THEN 'acme' WHEN 2 THEN 'bob rd' ELSE 'jo ltd' END AS clean FROM h)
    SELECT c_custkey, clean, coalesce(contains(CASE WHEN length(merchant) > 3 THEN lower(merchant) ELSE lower(note) END, clean), false) AS own FROM c""",
    txn=False,
)
def sca_33_self_transfer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = spark.sql(_HOLDERS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    return h.select("c_custkey", channels.clean_name(F.col("holder")).alias("clean"), channels.self_transfer(F.col("holder"), F.col("merchant"), F.col("note"), fuzzy=False).alias("own"))


@query()
def sca_33_self_transfers_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = spark.sql(_HOLDERS.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))
    return h.select("c_custkey", "holder", "merchant", "note", channels.self_transfer(F.col("holder"), F.col("merchant"), F.col("note")).alias("own"))


_MAP = [("upi", "self_transfer", "", "Own Account"), ("upi", "lender_transaction", "", "Loans"), ("net_banking_transfer", "", "", "Bank Transfer"), ("", "lender_transaction", "", "Loan"), ("", "mutual_funds", "", "Funds"), ("", "investments", "", "Invest"), ("", "gst", "", "Tax"), ("", "gst", "", "Later Tax"), ("", "", "home_loan", "Housing"), ("", "", "insurance", "Cover")]
_CATEGORY_SQL = f"""{_DESCRIPTION_SQL}, m AS (SELECT *, CASE merchant_category WHEN 'home_loan' THEN 'Home Loan' ELSE '' END AS loan FROM described),
  l AS (SELECT *, CASE WHEN transaction_type = 'credit' THEN loan || ' Disbursed' WHEN regexp_matches(transaction_note, '(?i)\\bEMI\\b') THEN 'EMI Payment' ELSE loan END AS lender FROM m),
  categorised AS (SELECT *, CASE WHEN transaction_channel = 'upi' AND description = 'self_transfer' THEN 'Own Account' WHEN transaction_channel = 'upi' AND description = 'lender_transaction' THEN lender
    WHEN transaction_channel = 'net_banking_transfer' THEN 'Bank Transfer' WHEN transaction_channel = 'upi' THEN 'Own Account' WHEN description = 'lender_transaction' THEN lender
    WHEN description = 'mutual_funds' THEN CASE transaction_type WHEN 'debit' THEN 'MF Purchase' ELSE 'MF Redemption' END WHEN description = 'investments' THEN CASE transaction_type WHEN 'credit' THEN 'Investment Income' ELSE 'Investment Expense' END
    WHEN description = 'gst' THEN 'Tax' WHEN description = 'self_transfer' THEN 'Own Account' WHEN merchant_category = 'home_loan' THEN 'Housing' WHEN merchant_category = 'insurance' THEN 'Cover' WHEN contains(lower(description), 'transfer') THEN description ELSE 'Others' END AS category FROM l)"""


def _mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, place) for place, row in enumerate(_MAP)], "transaction_channel string, description string, merchant_category string, category string, place int")


@query(f"WITH {_CATEGORY_SQL} SELECT seq, category FROM categorised")
def sca_35_36_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = channels.self_transfer(F.lit("Ann Lee"), F.col("unclean_merchant"), F.col("transaction_note"), fuzzy=False)
    return channels.category(channels.description(worn(spark, sf_dir, _DESCRIBED), _LISTS, own), _mapping(spark)).select("seq", "category")


@query(
    f"""WITH {_CHANNEL_SQL}, c AS (SELECT seq, account_id, date, amount, transaction_note, transaction_type, split_part(f, '|', 1) AS transaction_channel FROM found),
    d AS (SELECT *, CASE WHEN transaction_channel = 'upi' AND transaction_type = 'debit' THEN 'paid' WHEN regexp_matches(upper(transaction_note), 'NEFT') THEN 'sent' ELSE '' END AS description FROM c)
    SELECT seq, transaction_channel, description, md5(regexp_replace(concat(coalesce(transaction_note, 'None'), transaction_type, CAST(round(amount * 100) AS BIGINT), strftime(date, '%Y%m%d'), transaction_channel, description), '[^0-9A-Za-z]', '', 'g')) AS hash FROM d"""
)
def sca_45_channel_description_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = channels.channel(worn(spark, sf_dir, _NOTES), _DEBIT, _CREDIT, _CHARGES, _SKIP_DEBIT, _SKIP_CREDIT)
    text = F.when((F.col("transaction_channel") == "upi") & (F.col("transaction_type") == "debit"), "paid").when(F.upper("transaction_note").rlike("NEFT"), "sent").otherwise("")
    d = c.withColumn("description", text)
    parts = [F.coalesce("transaction_note", F.lit("None")), "transaction_type", F.round(F.col("amount") * 100).cast("long").cast("string"), F.date_format("date", "yyyyMMdd"), "transaction_channel", "description"]
    return d.select("seq", "transaction_channel", "description", F.md5(F.regexp_replace(F.concat(*parts), "[^0-9A-Za-z]", "")).alias("hash"))


@query(
    f"""WITH {_CHANNEL_SQL}, x AS (SELECT *, CASE WHEN amount > 5000 THEN 1 ELSE 0 END AS large FROM found), k AS (SELECT DISTINCT transaction_type, transaction_note, amount FROM x WHERE account_id % 3 = 0)
    SELECT seq, split_part(f, '|', 1) AS transaction_channel, EXISTS (SELECT 1 FROM k WHERE k.transaction_type = x.transaction_type AND k.transaction_note IS NOT DISTINCT FROM x.transaction_note AND k.amount = x.amount) AS from_cache FROM x"""
)
def udf_14_15_classified_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, inputs, outputs = worn(spark, sf_dir, _NOTES), ["transaction_type", "transaction_note", "amount"], ["transaction_channel"]
    classify = lambda df: channels.channel(df, _DEBIT, _CREDIT, _CHARGES, _SKIP_DEBIT, _SKIP_CREDIT)
    none = spark.createDataFrame([], "input_hash string, transaction_channel string")
    _, known = channels.classified_once(rows.where("account_id % 3 = 0"), none, inputs, classify, outputs)
    return channels.classified_once(rows, known, inputs, classify, outputs)[0].select("seq", "transaction_channel", "from_cache")


@query(
    """WITH r AS (SELECT 2 * c_custkey AS place, c_mktsegment AS label, '(?i)customer#0*' || c_custkey || '/[0-9]*[02468]$' AS pattern, printf('%09d', c_custkey) AS literal FROM customer WHERE c_custkey % 3 <> 2 UNION ALL SELECT 2 * c_custkey + 1, 'odd ' || c_nationkey, '#0*' || c_custkey || '/', printf('%09d', c_custkey) FROM customer UNION ALL SELECT -1, 'cash', '^CASH', NULL)
    SELECT seq, arg_min(label, place) AS label FROM (SELECT seq, r.label, r.place FROM txn LEFT JOIN r ON (r.literal IS NULL OR contains(transaction_note, '#' || r.literal || '/')) AND regexp_matches(transaction_note, r.pattern)) x GROUP BY 1"""
)
def sca_26_34_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two patterns a customer and one for all: as many rules as a bank's lenders and merchants, found by their literals."""
    c, literal = table(spark, sf_dir, "customer"), F.format_string("%09d", "c_custkey")
    even = c.where("c_custkey % 3 <> 2").select((2 * F.col("c_custkey")).alias("place"), F.col("c_mktsegment").alias("label"), F.concat(F.lit("(?i)customer#0*"), F.col("c_custkey").cast("string"), F.lit("/[0-9]*[02468]$")).alias("pattern"), literal.alias("literal"))
    any_ = c.select((2 * F.col("c_custkey") + 1).alias("place"), F.concat(F.lit("odd "), F.col("c_nationkey").cast("string")).alias("label"), F.concat(F.lit("#0*"), F.col("c_custkey").cast("string"), F.lit("/")).alias("pattern"), literal.alias("literal"))
    cash = c.sparkSession.createDataFrame([(-1, "cash", "^CASH", None)], "place long, label string, pattern string, literal string")
    found = rules.first_by_literal(transactions(spark, sf_dir), "transaction_note", even.union(any_).unionByName(cash))
    return found.select("seq", "label")


_CHANGED = "SELECT account_id, seq, date, CASE WHEN account_id % 7 = 0 AND seq % 3 = 0 THEN amount + 10 ELSE amount END AS amount, transaction_type, transaction_channel FROM txn WHERE account_id % 9 <> 4"


@query(
    f"""WITH c AS ({_CHANGED}), m AS (SELECT account_id, strftime(date, '%Y-%m') AS month, round(sum(amount), 2) AS total FROM c GROUP BY 1, 2), k AS (SELECT account_id, count(DISTINCT transaction_channel) AS channels FROM c GROUP BY 1),
    p AS (SELECT account_id, max(total) AS top, count(*) AS months FROM m GROUP BY 1), again AS (SELECT DISTINCT account_id FROM txn WHERE account_id % 7 = 0 AND seq % 3 = 0 AND account_id % 9 <> 4),
    tops AS (SELECT account_id, max(total) AS top, count(*) AS months FROM (SELECT account_id, strftime(date, '%Y-%m') AS month, round(sum(amount), 2) AS total FROM txn GROUP BY 1, 2) GROUP BY 1)
    SELECT p.account_id, p.top, p.months, k.channels, a.account_id IS NOT NULL AS monthly_ran, a.account_id IS NOT NULL AS channels_ran, a.account_id IS NOT NULL AND (p.top <> t.top OR p.months <> t.months) AS report_ran
    FROM p JOIN k ON k.account_id = p.account_id JOIN tops t ON t.account_id = p.account_id LEFT JOIN again a ON a.account_id = p.account_id"""
)
def udf_15_enrichment_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four stages over the transactions; then some accounts change and some go, and only what they touch runs again."""
    keep = ["account_id", "seq", "date", "amount", "transaction_type", "transaction_channel"]
    before, after = transactions(spark, sf_dir).select(*keep), worn(spark, sf_dir, _CHANGED).select(*keep)
    month = F.date_format("date", "yyyy-MM").alias("month")
    graph = [
        Stage("report", ("tops", "channels"), lambda g: g["tops"].join(g["channels"], "account_id")),
        Stage("tops", ("monthly",), lambda g: g["monthly"].groupBy("account_id").agg(F.max("total").alias("top"), F.count("*").alias("months"))),
        Stage("monthly", ("rows",), lambda g: g["rows"].groupBy("account_id", month).agg(F.round(F.sum("amount"), 2).alias("total"))),
        Stage("channels", ("rows",), lambda g: g["rows"].groupBy("account_id").agg(F.count_distinct("transaction_channel").alias("channels"))),
    ]
    store = Enrichments(spark, shared(spark, "enrichments"), "account_id", graph, ["rows"])
    store.refresh({"rows": before}, 0)
    results, ran = store.refresh({"rows": after}, 1)
    flags = ran.groupBy("key").agg(*[F.max((F.col("stage") == s).cast("int")).alias(s) for s in ("monthly", "channels", "report")])
    said = lambda s: (F.coalesce(F.col(f"ran.{s}"), F.lit(0)) == 1).alias(f"{s}_ran")
    out = results["report"].alias("r").join(flags.alias("ran"), F.col("r.account_id").cast("string") == F.col("ran.key"), "left")
    return out.select("r.account_id", "r.top", "r.months", "r.channels", said("monthly"), said("channels"), said("report"))
