"""Behaviour patterns: per-account measures, and their averages by class (averages of account rates)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import features, profile, stats

KEY, TS, AMT = "account_id", "transaction_timestamp", "amount"


def by_class(per_account: DataFrame, labels: DataFrame, measures: list[str], label: str = "is_mule") -> DataFrame:
    """(label, n_accounts, mean and median of each measure)"""
    j = per_account.join(labels.select(KEY, label), KEY)
    out = j.groupBy(label).agg(F.count(F.lit(1)).alias("n_accounts"), *[F.avg(m).alias(f"mean_{m}") for m in measures])
    for m in measures:
        q = stats.quantiles(j, m, {f"median_{m}": 0.5}, [label]).withColumnRenamed(label, "__label")
        out = out.join(q, out[label].eqNullSafe(q["__label"]), "left").drop("__label")
    return out


def dormancy(txn: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account, dormant_days, span_days, txn_per_day): from opening to the first transaction, then activity."""
    g = txn.groupBy(KEY).agg(F.min(TS).alias("a"), F.max(TS).alias("b"), F.count(F.lit(1)).alias("n"))
    j = g.join(accounts.select(KEY, "account_opening_date"), KEY)
    span = X.floor_days(F.col("b"), F.col("a"))
    return j.select(KEY, X.floor_days(F.col("a"), F.col("account_opening_date")).alias("dormant_days"), span.alias("span_days"), X.guarded_ratio(F.col("n"), span, 1.0).alias("txn_per_day"))


def income_mismatch(txn: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account, total_amount, avg_balance, ratio): turnover against the balance, for positive balances."""
    g = txn.groupBy(KEY).agg(X.exact_sum(F.col(AMT)).alias("total_amount"))
    j = g.join(accounts.filter(F.col("avg_balance") > 0).select(KEY, "avg_balance"), KEY)
    return j.withColumn("ratio", F.try_divide(F.col("total_amount"), F.col("avg_balance")))


def new_accounts(accounts: DataFrame, ref_date: str, edges: list[float], label: str = "is_mule") -> DataFrame:
    """(age_bin, n, n_positive, rate) by age in months."""
    age = X.months_between(F.lit(ref_date).cast("timestamp_ntz"), F.col("account_opening_date"))
    return profile.rate_by_group(accounts.withColumn("age_bin", profile.cut(age, edges)), "age_bin", label, name="age_bin")


def branch_collusion(accounts: DataFrame, min_support: int = 5, above: float = 0.3, label: str = "is_mule") -> DataFrame:
    """(branch_code, n, n_positive, rate) of branches with many positives."""
    return profile.rate_by_group(accounts, "branch_code", label, min_support, "branch_code").filter(F.col("rate") > above)


def salary_window(txn: DataFrame) -> DataFrame:
    return features.temporal(txn).select(KEY, "salary_window_rate")


def routing(df: DataFrame, score: str, low: float, high: float) -> DataFrame:
    """``df`` with ``tier``: low, medium or high by two thresholds."""
    s = F.col(score)
    return df.withColumn("tier", F.when(s >= high, "high").when(s >= low, "medium").otherwise("low"))
