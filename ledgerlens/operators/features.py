"""Per-account behavioural features.

Everything that one pass over transactions can give is one ``groupBy``; what needs a finer key first
(entropies, days, gaps, distinct counts, quantiles) is aggregated on that key and joined on the account.  All stages hash on
account_id, so a groupBy's shuffle also serves the join that follows it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.shared import Tables, kept
from . import ordered, stats

# Channels with a rate of their own, and high-risk merchant codes.
CHANNELS = ["UPC", "UPD", "IPM", "NTD", "FTD", "ATW", "CHQ", "END", "P2A", "MCR"]
RISK_MCC = [6011, 5933, 6051, 6012, 4814]

KEY, TS, AMT = "account_id", "transaction_timestamp", "amount"


# One pass over transactions gives every feature that is a plain aggregate.  A group of features is a dict of
# aggregates and a step that derives the rest from them, so that any set of groups shares one groupBy.


def _basic() -> dict[str, Column]:
    a = F.col(AMT)
    return {
        "txn_count": F.count("transaction_id"), "total_amount": X.exact_sum(a), "mean_amount": X.exact_mean(a), "std_amount": F.stddev_samp(a),
        "max_amount": F.max(a), "min_amount": F.min(a), "first_txn": F.min(TS), "last_txn": F.max(TS),
    }


def _derive_basic(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns(
        {
            "amount_range": c("max_amount") - c("min_amount"),
            "iqr_amount": c("p75_amount") - c("p25_amount"),
            "cv_amount": X.guarded_ratio(c("std_amount"), c("mean_amount"), 0.01),
            "active_span_days": X.floor_days(c("last_txn"), c("first_txn")),
        }
    ).withColumns(
        {
            "txn_per_day": X.guarded_ratio(c("txn_count"), c("active_span_days"), 1.0),
            "cp_per_txn": X.guarded_ratio(c("n_unique_counterparties"), c("txn_count"), 1.0),
        }
    )


AMOUNT_QUANTILES = {"p25_amount": 0.25, "median_amount": 0.5, "p75_amount": 0.75, "p95_amount": 0.95}


def distinct_count(txn: DataFrame, column: str, name: str) -> DataFrame:
    """(account, name): distinct non-null values, by pairs first, so that no row is expanded and a hot account is spread."""
    pairs = txn.filter(F.col(column).isNotNull()).select(KEY, column).distinct()
    return pairs.groupBy(KEY).agg(F.count(F.lit(1)).alias(name))


def basic_stats(txn: DataFrame, mcc: bool = True) -> DataFrame:
    """Counts, moments and exact quantiles of amounts; partners; active span.

    ``txn_count`` counts transaction ids.  Quantiles go by ranges of amounts and distinct counts by pairs,
    so an account with most of the rows is no single task's.
    """
    txn = gathered(txn.select(KEY, "transaction_id", TS, AMT, "counterparty_id", *(["mcc_code"] if mcc else [])))
    return _derive_basic(_with_spread(txn, txn.groupBy(KEY).agg(*_named(_basic())), mcc))


def gathered(txn: DataFrame) -> DataFrame:
    """``txn`` written once, an account's rows side by side, for the passes that follow.

    What makes ``txn`` is then not done again for each pass, and partial aggregates give a row or two an account instead of
    one for nearly every transaction.  Spark splits the part of an account that has far more rows than others.
    Ids of transactions are only counted, so 1 stands for each: they are long, all different and would be shuffled with the rows.
    """
    txn = txn.withColumn("transaction_id", F.when(F.col("transaction_id").isNotNull(), F.lit(1)))
    return Tables(txn.sparkSession).keep(txn.hint("rebalance", KEY), "transactions")


def _named(aggs: dict[str, Column]) -> list[Column]:
    return [c.alias(k) for k, c in aggs.items()]


def _with_spread(txn: DataFrame, g: DataFrame, mcc: bool) -> DataFrame:
    """``g`` with what needs a finer key: distinct counts and quantiles."""
    for column, name in [("counterparty_id", "n_unique_counterparties"), *([("mcc_code", "n_unique_mcc")] if mcc else [])]:
        g = g.join(distinct_count(txn, column, name), KEY, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return g.join(stats.quantiles(txn, AMT, AMOUNT_QUANTILES, [KEY]), KEY, "left")


def _flow() -> dict[str, Column]:
    a, aggs = F.col(AMT), {}
    for side, code in (("credit", "C"), ("debit", "D")):
        own = F.when(F.col("txn_type") == code, a)
        aggs |= {
            f"{side}_count": F.count(own), f"{side}_total": F.coalesce(X.exact_sum(own), F.lit(0.0)),
            f"{side}_mean": X.exact_mean(own), f"{side}_max": F.max(own),
        }
    return aggs


def _derive_flow(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns(
        {
            "passthrough_ratio": X.guarded_ratio(c("debit_total"), c("credit_total"), 1.0),
            "net_flow": (X.money(c("credit_total")) - X.money(c("debit_total"))).cast("double"),
            "credit_debit_ratio": X.guarded_ratio(c("credit_count"), c("credit_count") + c("debit_count"), 1.0),
        }
    )


def flow(txn: DataFrame) -> DataFrame:
    """Credit and debit sides by conditional aggregates.  A missing side has count and total 0, mean and max null."""
    return _derive_flow(txn.groupBy(KEY).agg(*_named(_flow())))


def plain(txn: DataFrame) -> DataFrame:
    """What one groupBy gives without categories: amounts, flows, times of day and week, structuring."""
    return _derive_flow(txn.groupBy(KEY).agg(*_named(_basic() | _flow() | _temporal() | _structuring())))


def category_shares(txn: DataFrame, category: str) -> DataFrame:
    """(account, category, n, share): long form instead of a wide pivot.  Null categories are left out."""
    counts = txn.filter(F.col(category).isNotNull()).groupBy(KEY, category).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(KEY)))


def entropy(txn: DataFrame, category: str | Column, name: str, n_name: str | None = None) -> DataFrame:
    """Shannon entropy (natural logarithm) of the categories' shares per account, 0 for a single one.

    From counts alone: ln N - sum(n ln n) / N, so two aggregations and no window.
    """
    cat = F.col(category) if isinstance(category, str) else category
    counts = txn.select(KEY, cat.alias("__cat")).filter(F.col("__cat").isNotNull()).groupBy(KEY, "__cat").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").cast("double")
    out = [F.greatest(F.lit(0.0), F.ln(total) - F.sum(F.col("n") * F.ln("n")) / total).alias(name)]
    if n_name:
        out.append(F.count(F.lit(1)).alias(n_name))
    return counts.groupBy(KEY).agg(*out)


def _rates(category: str, values: list, prefix: str, of_known: bool) -> dict[str, Column]:
    base = F.count(category) if of_known else F.count(F.lit(1))
    return {f"{prefix}{v}_rate": F.coalesce(F.try_divide(F.sum(X.flag(F.col(category) == v)).cast("double"), base), F.lit(0.0)) for v in values}


def category_rates(txn: DataFrame, category: str, values: list, prefix: str, of_known: bool) -> DataFrame:
    """Share of each listed category per account, 0 where it never occurs.  ``of_known``: null rows do not count."""
    return txn.groupBy(KEY).agg(*_named(_rates(category, values, prefix, of_known)))


def _temporal() -> dict[str, Column]:
    hour, dom = F.hour(TS), F.dayofmonth(TS)
    return {
        "night_rate": X.share((hour >= 0) & (hour < 6)), "weekend_rate": X.share(F.weekday(TS) >= 5),
        "salary_window_rate": X.share((dom <= 5) | (dom >= 25)),
    }


def temporal(txn: DataFrame) -> DataFrame:
    return txn.groupBy(KEY).agg(*_named(_temporal()))


def gaps(txn: DataFrame, hot: int = stats.HOT, parts: int | None = None) -> DataFrame:
    """Hours between consecutive transactions: median, least, deviation, 10th percentile; null for one transaction.

    An account of more than ``hot`` transactions is ordered range by range of time and its quantiles come from
    counts per distinct gap, so it is no single task's; both ways give the same numbers.
    """
    rows, split = ordered.with_previous_time(txn.select(KEY, TS), KEY, TS, "prev", hot, parts)
    g = rows.select(KEY, X.hours_between(F.col(TS), F.col("prev")).alias("gap"))
    rest = [F.min("gap").alias("min_gap_hrs"), F.stddev_samp("gap").alias("std_gap_hrs")]
    if split:
        q = stats.quantiles(g, "gap", {"p10_gap_hrs": 0.1, "med_gap_hrs": 0.5}, [KEY], hot)
        g = g.groupBy(F.col(KEY).alias("__a")).agg(*rest)
        g = g.join(q, F.col("__a").eqNullSafe(F.col(KEY)), "left").drop(KEY).withColumnRenamed("__a", KEY)
    else:
        g = g.groupBy(KEY).agg(F.percentile("gap", F.array(F.lit(0.1), F.lit(0.5))).alias("q"), *rest)
        g = g.withColumns({"p10_gap_hrs": F.get("q", F.lit(0)), "med_gap_hrs": F.get("q", F.lit(1))})
    return g.select(KEY, "med_gap_hrs", "min_gap_hrs", "std_gap_hrs", "p10_gap_hrs")


def _structuring(scale: float = 1.0) -> dict[str, Column]:
    a = F.col(AMT)
    return {
        "near_50k_rate": X.share(X.in_band(a, 45000 * scale, 50000 * scale)), "near_10k_rate": X.share(X.in_band(a, 9000 * scale, 10000 * scale)),
        **{f"round_{k}k_rate": X.share(X.multiple_of(a, k * 1000)) for k in (1, 5, 10, 50)}, "negative_rate": X.share(a < 0),
    }


def structuring(txn: DataFrame, scale: float = 1.0) -> DataFrame:
    """Rates of amounts just under reporting limits, of round amounts and of reversals."""
    return txn.groupBy(KEY).agg(*_named(_structuring(scale)))


def bursts(txn: DataFrame) -> DataFrame:
    """Daily counts and totals per account, then their mean, peak and spread."""
    day = txn.groupBy(KEY, F.to_date(TS).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(X.money(F.col(AMT))), F.lit(0).cast("decimal(18,2)")).alias("v"))
    g = day.groupBy(KEY).agg(
        F.avg("n").alias("mean_daily_txn"), F.max("n").alias("max_daily_txn"), F.stddev_samp("n").alias("std_daily_txn"), F.count(F.lit(1)).alias("n_active_days"),
        (F.sum("v").cast("double") / F.count(F.lit(1))).alias("mean_daily_amount"), F.max("v").cast("double").alias("max_daily_amount"),
    )
    c = F.col
    return g.withColumns(
        {"burstiness": X.guarded_ratio(c("max_daily_txn"), c("mean_daily_txn"), 0.01), "amount_burstiness": X.guarded_ratio(c("max_daily_amount"), c("mean_daily_amount"), 0.01)}
    )


def degrees(txn: DataFrame) -> DataFrame:
    """Distinct counterparties in all, on the credit side (in) and on the debit side (out); pairs first."""
    side = lambda t: F.coalesce(F.bool_or(F.col("txn_type") == t), F.lit(False))
    pairs = txn.groupBy(KEY, "counterparty_id").agg(side("C").alias("c"), side("D").alias("d"))
    known = F.col("counterparty_id").isNotNull()
    return pairs.groupBy(KEY).agg(F.count_if(known).alias("n_counterparties"), F.count_if(known & F.col("c")).alias("in_degree"), F.count_if(known & F.col("d")).alias("out_degree"))


FEW_CODES = 50_000  # codes that are sent to every task; more are joined by a shuffle


def label_codes(df: DataFrame, *columns: str) -> DataFrame:
    """(column, value, code): codes from 0 in the order of the values' text, nulls as MISSING, for each column.

    Fitted on all rows, in one pass for all columns; the order goes by ranges of texts.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("MISSING"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("value")) for c in columns])
    seen = df.select(F.explode(pairs).alias("p")).select("p.column", "p.value").distinct().withColumn("n", F.lit(1))
    return stats.running(seen, "value", {"k": "n"}, ["column"]).select("column", "value", (F.col("k") - 1).cast("int").alias("code"))


def encode(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``{column}_enc`` for each column."""
    codes = kept(label_codes(df, *columns))
    few = codes.count() <= FEW_CODES
    for c in columns:
        own = codes.filter(F.col("column") == c).select(F.col("value").alias(f"__{c}"), F.col("code").alias(f"{c}_enc"))
        df = df.join(F.broadcast(own) if few else own, F.coalesce(F.col(c).cast("string"), F.lit("MISSING")) == F.col(f"__{c}"), "left").drop(f"__{c}")
    return df


BALANCES = ("avg_balance", "monthly_avg_balance", "quarterly_avg_balance", "daily_avg_balance")


def account_attributes(acct: DataFrame, ref_date: str) -> DataFrame:
    """Ages in days and months at ``ref_date``, event indicators, durations and the spread of balances."""
    ref, c = F.lit(ref_date).cast("timestamp_ntz"), F.col
    known = lambda x: c(x).isNotNull().cast("int")
    bal = [c(b) for b in BALANCES]
    out = {
        "acct_age_days": X.floor_days(ref, c("account_opening_date")),
        "acct_age_months": X.months_between(ref, c("account_opening_date")),
        "was_frozen": known("freeze_date"),
        "was_unfrozen": known("unfreeze_date"),
        "had_mobile_update": known("last_mobile_update_date"),
        "days_since_mobile_update": X.floor_days(ref, c("last_mobile_update_date")),
        "frozen_duration": X.floor_days(c("unfreeze_date"), c("freeze_date")),
        "balance_range": X.widest(*bal),
        "balance_std": X.row_std(*bal),
    }
    if "last_kyc_date" in acct.columns:
        out["days_since_kyc"] = X.floor_days(ref, c("last_kyc_date"))
    return acct.withColumns(out)


ENCODED_ACCOUNT = ("account_status", "product_family", "nomination_flag", "cheque_allowed", "cheque_availed", "kyc_compliant", "rural_branch")
KYC = ("pan_available", "aadhaar_available", "passport_available")
DIGITAL = ("mobile_banking_flag", "internet_banking_flag", "atm_card_flag", "demat_flag", "credit_card_flag", "fastag_flag")
PRODUCTS = ("loan", "cc", "od", "ka", "sa")


def flag_score(df: DataFrame, columns, name: str) -> DataFrame:
    """How many of the Y/N columns are Y; null is not Y."""
    return df.withColumn(name, reduce(lambda a, b: a + b, [X.equals(F.col(c), "Y").cast("int") for c in columns]))


def customer_attributes(customers: DataFrame, products: DataFrame, linkage: DataFrame, ref_date: str) -> DataFrame:
    """One row per account: its customer's ages, flags, scores, holdings and number of accounts."""
    ref, c = F.lit(ref_date).cast("timestamp_ntz"), F.col
    out = encode(customers, *KYC, *DIGITAL).withColumns(
        {"age": X.years_between(ref, c("date_of_birth")), "rel_years": X.years_between(ref, c("relationship_start_date")), "pin_mismatch": X.differs(c("customer_pin"), c("permanent_pin")).cast("int")}
    )
    out = flag_score(flag_score(out, KYC, "kyc_score"), DIGITAL, "digital_score")
    n = linkage.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_accounts_customer"))
    keep = ["age", "rel_years", "pin_mismatch", *[f"{x}_enc" for x in KYC + DIGITAL], "kyc_score", "digital_score"]
    held = [f"{p}_{x}" for p in PRODUCTS for x in ("sum", "count")]
    out = out.join(products, "customer_id", "left").join(n, "customer_id", "left")
    return linkage.join(out, "customer_id", "left").select(KEY, *keep, "n_accounts_customer", *held)


def ratios(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns(
        {
            "txn_to_balance_ratio": X.guarded_ratio(c("total_amount"), c("avg_balance"), 1.0),
            "max_txn_to_balance": X.guarded_ratio(c("max_amount"), c("avg_balance"), 1.0),
            "acct_age_txn_ratio": X.guarded_ratio(c("txn_count"), c("acct_age_days"), 1.0),
        }
    )


LEAKING = ("was_frozen", "was_unfrozen", "frozen_duration", "account_status_enc")


def build(txn: DataFrame, accounts: DataFrame, customers: DataFrame, products: DataFrame, linkage: DataFrame, ref_date: str = "2025-06-30", leakage_free: bool = False, channels: list = CHANNELS, mccs: list = RISK_MCC) -> DataFrame:
    """The 122 features for every account with a transaction.  ``leakage_free`` leaves out what a freeze gives away.

    All plain aggregates share one groupBy on the account; entropies, days, gaps, distinct counts and
    quantiles use a finer key first.  ``channels`` and ``mccs``: the categories with a rate of their own.
    """
    txn = gathered(txn)
    plain = _basic() | _flow() | _temporal() | _structuring() | _rates("channel", channels, "ch_", True) | _rates("mcc_code", mccs, "mcc_", False)
    one = _derive_flow(_derive_basic(_with_spread(txn, txn.groupBy(KEY).agg(*_named(plain)), True))).drop("first_txn", "last_txn")
    finer = [entropy(txn, "channel", "channel_entropy", "n_channels_used"), entropy(txn, F.hour(TS), "hour_entropy"), entropy(txn, "mcc_code", "mcc_entropy"), gaps(txn), bursts(txn)]
    out = reduce(lambda a, b: a.join(b, KEY, "left"), finer, one)
    acct = encode(account_attributes(accounts, ref_date), *ENCODED_ACCOUNT)
    own = [
        KEY, *BALANCES, "num_chequebooks", "acct_age_days", "acct_age_months", "was_frozen", "was_unfrozen", "had_mobile_update", "days_since_mobile_update", "days_since_kyc",
        "frozen_duration", *[f"{c}_enc" for c in ENCODED_ACCOUNT], "balance_range", "balance_std", "product_code", "currency_code",
    ]
    out = out.join(acct.select(*own), KEY, "left").join(customer_attributes(customers, products, linkage, ref_date), KEY, "left")
    zero = ["channel_entropy", "n_channels_used", "mcc_entropy", "hour_entropy"]
    out = ratios(out).fillna(0, subset=zero)
    return out.drop(*LEAKING) if leakage_free else out


def matrix(features: DataFrame, columns: list[str], key: str = KEY) -> DataFrame:
    """Doubles with null, NaN as 0 and infinities as +-1e10, ready for a vector."""
    big = F.lit(1e10)

    def clean(c: Column) -> Column:
        x = F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
        return F.when(x == float("inf"), big).when(x == float("-inf"), -big).otherwise(x)

    return features.select(key, *[clean(F.col(c)).alias(c) for c in columns])
