"""Wide features of an account: predictors over look-back windows, and the basic features of each month.

Each is one aggregate with conditions, so all of them are one pass and one shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.records import daily_levels
from tallyloom.operators.rolling import CREDIT_CHANNELS, DEBIT_CHANNELS

_LOAN, _OTHER = "transaction_type = 'debit' AND merchant_category = 'loans'", "transaction_type = 'debit' AND merchant_category <> 'loans'"
#: Feature -> (how it is added up, of what, over which rows, in which window). Windows: cN, the N days up to the last row; mN, the Nth calendar month before that of the last row; all.
PREDICTORS: Mapping[str, tuple[str, str, str, str]] = {
    "cnt_credit_txns": ("count", "amount", "transaction_type = 'credit'", "all"),
    "amt_bank_charge_txns_c30": ("sum", "amount", "transaction_channel = 'bank_charge'", "c30"),
    "balance_min_c60": ("min", "balance", "true", "c60"),
    "amt_upi_txns_c60": ("sum", "amount", "transaction_channel = 'upi'", "c60"),
    "cnt_refund_txns_c60": ("count", "amount", "transaction_channel = 'refund'", "c60"),
    "sum_amount_nonlender_debits_c60": ("sum", "amount", _OTHER, "c60"),
    "cnt_txns_balance_less_than_100_c90": ("count", "amount", "balance < 100", "c90"),
    "cnt_txns_balance_more_than_5000_c90": ("count", "amount", "balance > 5000", "c90"),
    "balance_median_c90": ("median", "balance", "true", "c90"),
    "credit_max_c90": ("max", "amount", "transaction_type = 'credit'", "c90"),
    "cnt_net_banking_transfer_txns_c90": ("count", "amount", "transaction_channel = 'net_banking_transfer'", "c90"),
    "balance_mean_c180": ("mean", "balance", "true", "c180"),
    "debit_max_c180": ("max", "amount", "transaction_type = 'debit'", "c180"),
    "amt_net_banking_transfer_txns_c180": ("sum", "amount", "transaction_channel = 'net_banking_transfer'", "c180"),
    "amt_bank_interest_txns_c180": ("sum", "amount", "transaction_channel = 'bank_interest'", "c180"),
    "amt_salary_txns_c180": ("sum", "amount", "transaction_channel = 'salary'", "c180"),
    "balance_median_m0": ("median", "balance", "true", "m0"),
    "balance_min_m0": ("min", "balance", "true", "m0"),
    "balance_max_m0": ("max", "balance", "true", "m0"),
    "credit_mean_m0": ("mean", "amount", "transaction_type = 'credit'", "m0"),
    "credit_max_m0": ("max", "amount", "transaction_type = 'credit'", "m0"),
    "debit_mean_m0": ("mean", "amount", "transaction_type = 'debit'", "m0"),
    "cnt_txns_balance_more_than_5000_m0": ("count", "amount", "balance > 5000", "m0"),
    "cnt_debit_card_txns_m0": ("count", "amount", "transaction_channel = 'debit_card'", "m0"),
    "amt_bank_interest_txns_m0": ("sum", "amount", "transaction_channel = 'bank_interest'", "m0"),
    "debit_max_m1": ("max", "amount", "transaction_type = 'debit'", "m1"),
    "cnt_upi_txns_m1": ("count", "amount", "transaction_channel = 'upi'", "m1"),
    "balance_min_m2": ("min", "balance", "true", "m2"),
    "amt_refund_txns_m2": ("sum", "amount", "transaction_channel = 'refund'", "m2"),
    "amt_bills_txns_m2": ("sum", "amount", "merchant_category = 'bills'", "m2"),
    "credit_max_m3": ("max", "amount", "transaction_type = 'credit'", "m3"),
    "balance_mean_m4": ("mean", "balance", "true", "m4"),
    "balance_max_m4": ("max", "balance", "true", "m4"),
    "debit_max_m4": ("max", "amount", "transaction_type = 'debit'", "m4"),
    "cnt_ewallet_txns_m4": ("count", "amount", "transaction_type = 'debit' AND merchant_category = 'ewallet'", "m4"),
    "amt_fuel_txns_m4": ("sum", "amount", "transaction_type = 'debit' AND merchant_category = 'fuel'", "m4"),
    "balance_median_m5": ("median", "balance", "true", "m5"),
}
#: Feature -> (how both parts are added up, the rows above, the rows below, window, times what).
RATIOS: Mapping[str, tuple[str, str, str, str, int]] = {
    "credit_to_debit_txns": ("count", "transaction_type = 'credit'", "transaction_type = 'debit'", "all", 1),
    "ratio_cnt_nonlender_to_lender_debits": ("count", _OTHER, _LOAN, "all", 1),
    "ratio_amt_nonlender_to_lender_debits_c90": ("sum", _OTHER, _LOAN, "c90", 1),
    "perc_luxury_spends_amt_m0": ("sum", "transaction_type = 'debit' AND merchant_category IN ('food', 'entertainment', 'shopping', 'travel')", "transaction_type = 'debit'", "m0", 100),
    "ratio_lender_credits_to_debits_m3": ("sum", "transaction_type = 'credit' AND merchant_category = 'loans'", _LOAN, "m3", 1),
    "perc_basicneed_spends_amt_m3": ("sum", "transaction_type = 'debit' AND merchant_category IN ('groceries', 'fuel')", "transaction_type = 'debit'", "m3", 100),
}


def _window(name: str) -> Column:
    if name == "all":
        return F.lit(True)
    if name[0] == "c":
        return F.col("date") > F.col("_last") - F.make_dt_interval(days=F.lit(int(name[1:])))
    return F.col("_months") == int(name[1:])


def predictors(df: DataFrame, key: str) -> DataFrame:
    """key and the 43 features of PREDICTORS and RATIOS; a count, sum or ratio that is zero, and what has no rows, is null."""
    last = F.max("date").over(Window.partitionBy(key))
    rows = df.where(F.col("date").isNotNull()).withColumn("merchant_category", F.coalesce("merchant_category", F.lit(""))).withColumn("_last", last)
    apart = 12 * (F.year("_last") - F.year("date")) + F.month("_last") - F.month("date")
    rows = rows.withColumn("_months", apart)
    added = {"min": F.min, "max": F.max, "mean": F.avg, "median": F.median}

    def part(how: str, of: str, rule: str, window: str) -> Column:
        value = F.when(F.expr(rule) & _window(window), F.col(of))
        if how == "count":
            return F.count(value).cast("double")
        return F.round(F.coalesce(F.sum(value), F.lit(0.0)), 2) if how == "sum" else added[how](value)

    out = [(F.nullif(part(*p), F.lit(0.0)) if p[0] in ("count", "sum") else part(*p)).alias(name) for name, p in PREDICTORS.items()]
    for name, (how, above, below, window, times) in RATIOS.items():
        top, bottom = part(how, "amount", above, window), part(how, "amount", below, window)
        ratio = F.when(bottom != 0, top / bottom * times)
        out.append((ratio if name == "ratio_cnt_nonlender_to_lender_debits" else F.nullif(ratio, F.lit(0.0))).alias(name))
    return rows.groupBy(key).agg(*out)


def basic_features(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """key, month and the sixty features of a calendar month: counts, sums, balances at its ends and over its days, and each channel's."""
    kind, amount, place = F.col("transaction_type"), F.col("amount"), F.struct(*order)
    month, day = F.date_format("date", "yyyy-MM"), F.to_date("date")
    total = lambda rows: F.round(F.coalesce(F.sum(F.when(rows, amount)), F.lit(0.0)), 2)
    before = F.when(kind == "debit", F.col("balance") + amount).when(kind == "credit", F.col("balance") - amount).otherwise(F.col("balance"))
    opening = F.round(F.min_by(before, place), 2)
    out = [
        F.count("*").alias("cnt_transactions"), F.count_if(kind == "debit").alias("cnt_debit"), F.count_if(kind == "credit").alias("cnt_credit"), opening.alias("opening_balance"),
        total(kind == "debit").alias("amt_debit"), total(kind == "credit").alias("amt_credit"), F.max_by("balance", place).alias("closing_balance"),
        F.least(F.min("balance"), opening).alias("min_bal"), F.greatest(F.max("balance"), opening).alias("max_bal"),
        F.avg(F.when(kind == "credit", amount)).alias("avg_credit_transaction_size"), F.avg(F.when(kind == "debit", amount)).alias("avg_debit_transaction_size"),
    ]
    for side, names in (("debit", DEBIT_CHANNELS), ("credit", CREDIT_CHANNELS)):
        for c in names:
            hit = (F.col("transaction_channel") == c) & (kind == side)
            out += [total(hit).alias(f"amt_{c}_{side}"), F.count_if(F.coalesce(hit, F.lit(False))).alias(f"cnt_{c}_{side}")]
    rows = df.where(F.col("date").isNotNull())
    wide = rows.groupBy(key, month.alias("month")).agg(*out).withColumn("net_cash_inflow", F.round(F.col("amt_credit") - F.col("amt_debit"), 2))
    eod = rows.groupBy(key, day.alias("day")).agg(F.max_by("balance", place).alias("b"))
    levels = daily_levels(eod, [key], "day", "b").withColumnsRenamed({"mean": "avg_bal", "median": "median_balance", "mode": "mode_balance"})
    ends = eod.groupBy(key, F.date_format("day", "yyyy-MM").alias("month")).agg(F.max("b").alias("max_eod_balance"), F.min("b").alias("min_eod_balance"))
    per_day = levels.join(ends.withColumnsRenamed({key: "_ek", "month": "_em"}), F.col(key).eqNullSafe(F.col("_ek")) & (F.col("month") == F.col("_em"))).drop("_ek", "_em").withColumnsRenamed({key: "_k", "month": "_m"})
    return wide.join(per_day, F.col(key).eqNullSafe(F.col("_k")) & (F.col("month") == F.col("_m"))).drop("_k", "_m")
