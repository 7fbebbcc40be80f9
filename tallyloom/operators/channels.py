"""The classifiers of a transaction: channel, description, self transfer, category, and results kept by input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.operators import similarity

#: Charges that banks take, amount bounds of the channel rules, and the words that mark a salary.
CHARGE_ABOVE, SALARY_PAID_BELOW, SALARY_ABOVE = 50_000, 5_000, 3_000
SALARY_WORDS = ("SALARY", "SALARIE")
#: Countries of large amounts, and patterns that stand for whole words.
INFLATED, WHOLE_WORDS = ("ID",), ("ACH",)
#: Words that begin a relation in a holder's name, words that are no part of it.
RELATIONS = ("s/o", "d/o", "w/o", "c/o", "r/o", "son of", "daughter of", "wife of", "care of", "resident of")
TITLES = ("mr", "mrs", "miss", "master", "dr", "ms", "st", "sr", "jr", "eng", "m/s")
COMMON = ("pvt", "ltd", "private", "limited", "corporation", "technologies", "india", "software", "solutions", "bank", "enterprises", "and", "the", "international", "group", "services", "of", "for", "to")

Rules = Sequence[tuple[str, Sequence[str]]]


def _none() -> Column:
    return F.lit(None).cast("string")


def salary_mark(note: Column, ignore: Sequence[str]) -> Column:
    """What marks an upper-case note as salary: a word, unless one to ignore stands in it, or SAL at its start or end."""
    word = F.coalesce(*[F.when(F.contains(note, F.lit(w)), F.lit(w)) for w in SALARY_WORDS])
    tight = F.replace(note, F.lit(" "), F.lit(""))
    ignored = F.exists(F.array(*[F.lit(w) for w in ignore]), lambda w: F.contains(tight, w)) if ignore else F.lit(False)
    edge = F.when(note.rlike("^SAL[^A-Za-z]+"), "^SAL").when(note.rlike("[^a-zA-Z]SAL$"), "SAL$")
    return F.when(word.isNotNull(), F.when(~ignored, word)).otherwise(edge)


def channel(df: DataFrame, debit: Rules, credit: Rules, charges: Sequence[float], ignore_debit: Sequence[str], ignore_credit: Sequence[str], category: Column | str = "", country: Column | str = "IN") -> DataFrame:
    """df with transaction_channel and transaction_channel_regex: the first channel, in order, with a pattern that matches.

    debit, credit: (channel, patterns) in order of priority; category and country are of the
    account, columns or one for all. Guards: a charge above CHARGE_ABOVE is none, but in
    INFLATED countries; a pattern among WHOLE_WORDS fits whole words only; card interest counts for overdraft accounts alone; cash or a
    transfer of an amount among charges is a charge; salaries paid from SALARY_PAID_BELOW on
    need a salary mark or a note without words to ignore, and an account that is not
    individual; salaries received need more than SALARY_ABOVE. Other types have no channel.
    The rules are code, so they become one expression and no row moves.
    """
    note = F.trim(F.upper(F.regexp_replace("transaction_note", r"[^\x00-\x7F]", " ")))
    kept_as, land = (F.coalesce(c if isinstance(c, Column) else F.lit(c), F.lit("")) for c in (category, country))
    amount, tight = F.col("amount"), F.replace(note, F.lit(" "), F.lit(""))
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(tight, w)) if words else F.lit(False)
    pair = lambda name, regex: F.struct(F.lit(name).alias("c"), F.lit(regex).alias("r")) if isinstance(regex, str) else F.struct(F.lit(name).alias("c"), regex.alias("r"))

    def of(rules: Rules, kind: str) -> Column:
        found = []
        for name, patterns in rules:
            for p in patterns:
                fits = note.rlike(rf"\b{p}\b") if kind == "debit" and p in WHOLE_WORDS else note.rlike(p)
                if kind == "debit" and name == "bank_charge":
                    fits = fits & ((amount <= CHARGE_ABOVE) | land.isin(*INFLATED))
                if kind == "debit" and name == "cc_interest":
                    fits = fits & (kept_as == "overdraft")
                if kind == "debit" and name == "salary_paid":
                    fits = fits & (amount < SALARY_PAID_BELOW)
                if kind == "credit" and name == "salary":
                    continue
                hit = pair(name, p)
                if kind == "debit" and name in ("cash_withdrawl", "net_banking_transfer"):
                    hit = F.when(amount.isin(*charges), pair("bank_charge", p)).otherwise(hit)
                found.append(F.when(fits, hit))
            if kind == "debit" and name == "salary_paid":
                mark, due = salary_mark(note, ignore_debit), (amount >= SALARY_PAID_BELOW) & (kept_as != "individual")
                found.append(F.when(due & mark.isNotNull(), pair(name, mark)))
                found += [F.when(due & note.rlike(p) & ~has(ignore_debit), pair(name, "")) for p in patterns]
            if kind == "credit" and name == "salary":
                mark = salary_mark(note, ignore_credit)
                found.append(F.when((amount > SALARY_ABOVE) & mark.isNotNull(), pair(name, mark)))
                found += [F.when((amount > SALARY_ABOVE) & note.rlike(p) & ~has(ignore_credit), pair(name, p)) for p in patterns]
        return F.coalesce(*found, pair("Other", ""))

    kind = F.col("transaction_type")
    got = F.when(kind == "debit", of(debit, "debit")).when(kind == "credit", of(credit, "credit")).otherwise(pair("", ""))
    return df.withColumn("_found", got).withColumns({"transaction_channel": F.col("_found.c"), "transaction_channel_regex": F.col("_found.r")}).drop("_found")


def merchant(debit: Sequence[str], credit: Sequence[str]) -> Column:
    """What the first pattern of the transaction's type that fits captures in its upper-case note; empty where none does."""
    note = F.upper(F.regexp_replace("transaction_note", r"[^\x00-\x7F]", " "))
    first = lambda patterns: F.coalesce(*[F.when(note.rlike(p), F.regexp_extract(note, p, 1)) for p in patterns], F.lit(""))
    kind = F.col("transaction_type")
    return F.when(kind == "debit", first(debit)).when(kind == "credit", first(credit)).otherwise("")


def clean_name(name: Column) -> Column:
    """A holder's name: cut at a relation, without titles, digits and common words; short rests keep the common words."""
    low = F.regexp_replace(F.lower(name), rf"(?s) (?:{'|'.join(RELATIONS)}) .*", " ")
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(low, r"\W+", " "), r"\d+", " ")), " +")
    named = F.filter(words, lambda w: (w != "") & ~w.isin(*TITLES))
    rare = F.filter(named, lambda w: ~w.isin(*COMMON))
    short = F.array_join(rare, " ")
    return F.when(F.size(rare) == 0, "None").when(F.length(short) > 3, short).otherwise(F.array_join(named, " "))


@F.pandas_udf(T.BooleanType())
def _near(name: pd.Series, other: pd.Series) -> pd.Series:
    pairs = [(a, b) if a and b else None for a, b in zip(name, other)]
    known: dict = {p: p is not None and similarity.weighted(*p) > 87 for p in set(pairs)}  # of a batch, each pair once
    return pd.Series([known[p] for p in pairs], dtype="boolean")


def self_transfer(holder: Column, merchant: Column, note: Column, fuzzy: bool = True) -> Column:
    """Whether money went to the holder's own name.

    The clean name stands in the merchant, or in the note where the merchant has at most
    three letters; else (fuzzy) they score above 87 as they are, without spaces, or without
    separators.
    """
    name, low = clean_name(holder), F.lower(merchant)
    named = F.coalesce(F.length(merchant) > 3, F.lit(False))
    where = F.when(named, low).otherwise(F.lower(note))
    inside = F.coalesce(F.contains(where, name), F.lit(False))
    if not fuzzy:
        return inside
    tight = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    near = _near(name, where) | (named & (_near(tight(name), tight(where)) | _near(name, F.regexp_replace(where, r"[/,\-.]", " "))))
    return inside | near


def description(df: DataFrame, lists: Mapping[str, Sequence[str]], self_transfers: Column) -> DataFrame:
    """df with description: the first step of the decision list that has an answer.

    df: transaction_channel, transaction_type, transaction_note, merchant_category,
    unclean_merchant, is_lender. lists: the patterns of each description. Salaries, refunds
    and reversals are transfers; cash withdrawals have none, deposits the machine's;
    investments and insurance their category; charges and bounces their own lists; lenders,
    unidentified obligations and self transfers follow; then the general lists, those of
    debits and of credits, and last the transfer by its merchant.
    """
    kind, ch, mc = F.col("transaction_type"), F.col("transaction_channel"), F.col("merchant_category")
    note, who = F.upper("transaction_note"), F.col("unclean_merchant")
    listed = lambda *names: F.coalesce(*[F.when(note.rlike(p), F.lit(n)) for n in names for p in lists.get(n, ())], _none())
    blank = lambda c: F.coalesce(c, F.lit(""))
    bounce = ch.isin("inward_cheque_bounce", "outward_cheque_bounce", "auto_debit_payment_bounce", "inward_payment_bounce")
    transfer = F.when(blank(who) != "", F.when(kind == "debit", F.concat(F.lit("Transfer to "), who)).when(kind == "credit", F.concat(F.lit("Transfer from "), who)))
    bounced = F.when(bounce, listed("chq_bounce_insuff_funds", "chq_technical_bounce"))
    general = listed("cash_back", "fixed_deposit", "upi_settlement", "card_settlement", "dividend", "subsidy", "small_savings", "brokerage", "crypto")
    bills = F.when(kind == "debit", listed("credit_card_bill", "telco_bill", "electric_bill"))
    rest = F.coalesce(F.when(kind == "debit", listed("share_purchase", "donation")), F.when(kind == "credit", listed("rent_received", "share_sell")), F.when(~bounce, transfer))
    own = F.when(F.col("is_lender"), "lender_transaction").when(ch == "auto_debit_payment", "unidentified_obligation").when(ch.isin("net_banking_transfer", "upi", "chq", "bi_fast"), F.when(self_transfers, "self_transfer"))
    own = own.otherwise(F.coalesce(bounced, F.when(kind == "credit", listed("pension")), listed("gst")))
    first = F.when(ch == "bank_charge", listed("minimum_balance_charge", "ach_bounce_charge", "chq_bounce_charge", "card_charge", "sms_charge")).otherwise(own)
    # each step is a column of its own, so that later steps refer to it and do not repeat it
    steps = df.withColumn("_first", first).withColumn("_rest", F.coalesce(bills, rest))
    steps = steps.withColumn("_general", F.when(F.col("_first").isNull(), general))
    open_ = F.col("_first") == "unidentified_obligation"  # looked up among the bills and lists of debits, where it loses its name
    found = F.when(F.col("_first").isNull(), F.coalesce("_general", "_rest")).when(open_ & (kind == "debit"), F.col("_rest")).otherwise(F.col("_first"))
    out = (
        F.when(ch.isin("salary", "refund", "reversal"), transfer)
        .when(ch == "cash_withdrawl", _none())
        .when(ch == "cash_deposit", listed("deposit_by_machine"))
        .when(mc.isin("investments", "trading/investments", "insurance", "mutual_funds"), mc)
        .otherwise(found)
    )
    return steps.withColumn("description", blank(out)).drop("_first", "_rest", "_general")


def category(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """df with category: (channel, description), channel, description, merchant category, transfer, else Others.

    mapping: transaction_channel, description, merchant_category, category (empty text where
    unused) and place, which orders it; the first of several rows decides. Lenders' rows take
    their loan's name and direction, mutual funds and investments their direction.
    """
    ch, text, mc, kind = F.trim("transaction_channel"), F.trim("description"), F.trim("merchant_category"), F.col("transaction_type")

    def first(name: str, keys: Mapping[str, Column]) -> None:
        nonlocal df
        side = mapping
        for k in keys:
            side = side.where(F.col(k) != "")
        side = side.groupBy(*keys).agg(F.min_by("category", "place").alias(name)).toDF(*[f"_m_{k}" for k in keys], name)
        on = [F.col(f"_m_{k}") == c for k, c in keys.items()]
        df = df.join(F.broadcast(side) if small else side, on, "left").drop(*[f"_m_{k}" for k in keys])

    small = mapping.count() <= 100_000
    for name, keys in (("_a", {"transaction_channel": ch, "description": text}), ("_b", {"transaction_channel": ch}), ("_c", {"description": text}), ("_d", {"merchant_category": mc})):
        first(name, keys)
    loans = {"loans": "Loan", "home_loan": "Home Loan", "gold_loan": "Gold Loan", "auto_loan": "Auto Loan", "personal_loan": "Personal Loan", "business_loan": "Business Loan", "term_loan": "Term Loan"}
    loan = F.coalesce(*[F.when(mc == k, F.lit(v)) for k, v in loans.items()], F.lit(""))
    lender = F.when(kind == "credit", F.concat(loan, F.lit(" Disbursed"))).when((kind == "debit") & F.col("transaction_note").rlike(r"(?i)\bEMI\b"), "EMI Payment").otherwise(loan)
    is_lender, fund = text == "lender_transaction", F.when(kind == "debit", "MF Purchase").otherwise("MF Redemption")
    invest = F.when(kind == "credit", "Investment Income").otherwise("Investment Expense")
    by_text = F.when(is_lender, lender).when(text == "mutual_funds", fund).when(text.isin("investments", "trading/investments"), invest).otherwise(F.col("_c"))
    by_merchant = F.when(mc.isin("investments", "trading/investments"), invest).when(is_lender, lender).when(mc == "mutual_funds", fund).otherwise(F.col("_d"))
    out = (
        F.when(F.col("_a").isNotNull(), F.when(is_lender, lender).otherwise(F.col("_a")))
        .when(F.col("_b").isNotNull(), F.col("_b"))
        .when(F.col("_c").isNotNull(), by_text)
        .when(F.col("_d").isNotNull(), by_merchant)
        .when(F.contains(F.lower(text), F.lit("transfer")), text)
        .otherwise("Others")
    )
    return df.withColumn("category", out).drop("_a", "_b", "_c", "_d")


def input_hash(columns: Sequence[str]) -> Column:
    """md5 of what a classifier reads, nulls told apart from empty texts."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def classified_once(df: DataFrame, known: DataFrame, inputs: Sequence[str], classify, outputs: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """df with outputs and from_cache, and the rows that known (input_hash, outputs) lacks.

    Equal inputs are classified once: the distinct ones that known does not have go through
    classify (a function of a DataFrame); all rows then meet their result by its hash.
    """
    keyed = df.withColumn("input_hash", input_hash(inputs))
    new = keyed.select("input_hash", *inputs).dropDuplicates(["input_hash"]).join(known.select("input_hash"), "input_hash", "left_anti")
    fresh = classify(new).select("input_hash", *outputs)
    results = known.select("input_hash", *outputs).withColumn("from_cache", F.lit(True)).unionByName(fresh.withColumn("from_cache", F.lit(False)))
    kept = [c for c in df.columns if c not in outputs]
    return keyed.select("input_hash", *kept).join(results, "input_hash"), fresh
