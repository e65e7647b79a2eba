"""The query catalogue: every query beside the plain SQL that checks it.

Queries take (spark, sf_dir) and run over whole tables.  Sums are exact decimals; quantiles, deviations,
entropies and correlations are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..operators import boosting, features, graph, models, ordered, patterns, profile, quality, sketches, stats, text, timeseries
from ..sources.binding import ACCOUNTS_T, BANK_T, TXN_E, TXN_T, accounts_t, bank_t, read, txn_e, txn_t
from ..sources import io
from ..sources.shared import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
REF = "2000-01-01"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: X.r6(F.col(n)) for n in names})


_DAYS = "CAST(floor((epoch_us({a}) - epoch_us({b})) / 86400e6) AS BIGINT)"
_SUM = "CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)"


def dated(df: DataFrame, *names: str) -> DataFrame:
    """Dates as ISO text, which reads the same from every client."""
    return df.withColumns({n: F.col(n).cast("date").cast("string") for n in names})


def days(a: str, b: str) -> str:
    return _DAYS.format(a=a, b=b)


# --- features -----------------------------------------------------------------------------------

BASIC = f"""g AS (
  SELECT account_id, count(transaction_id) AS txn_count, {_SUM} AS total_amount, {_SUM} / count(amount) AS mean_amount,
    stddev_samp(amount) AS s, max(amount) AS max_amount, min(amount) AS min_amount,
    quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS q2, quantile_cont(amount, 0.75) AS q3, quantile_cont(amount, 0.95) AS q4,
    count(DISTINCT counterparty_id) AS n_unique_counterparties, count(DISTINCT mcc_code) AS n_unique_mcc,
    min(transaction_timestamp) AS a, max(transaction_timestamp) AS b FROM txn GROUP BY account_id)"""


@query(
    f"""WITH {TXN_T}, {BASIC}
SELECT account_id, txn_count, total_amount, mean_amount, round(s, 6) AS std_amount, max_amount, min_amount,
  round(q1, 6) AS p25_amount, round(q2, 6) AS median_amount, round(q3, 6) AS p75_amount, round(q4, 6) AS p95_amount,
  n_unique_counterparties, n_unique_mcc, round(max_amount - min_amount, 6) AS amount_range, round(q3 - q1, 6) AS iqr_amount,
  round(s / greatest(mean_amount, 0.01), 6) AS cv_amount, {days('b', 'a')} AS active_span_days,
  round(txn_count / greatest({days('b', 'a')}, 1), 6) AS txn_per_day, round(n_unique_counterparties / greatest(txn_count, 1), 6) AS cp_per_txn
FROM g"""
)
def txn_basic_stats(spark, sf_dir):
    """Flagship: amounts, quantiles, partners and activity span of every account."""
    out = features.basic_stats(txn_t(spark, sf_dir, mcc=True)).drop("first_txn", "last_txn")
    return rounded(out, "std_amount", "p25_amount", "median_amount", "p75_amount", "p95_amount", "amount_range", "iqr_amount", "cv_amount", "txn_per_day", "cp_per_txn")


_SIDE = "CAST(sum(CASE WHEN txn_type = '{t}' THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE)"


@query(
    f"""WITH {TXN_E}, g AS (SELECT account_id,
  count(CASE WHEN txn_type = 'C' THEN amount END) AS credit_count, coalesce({_SIDE.format(t='C')}, 0) AS credit_total,
  {_SIDE.format(t='C')} / count(CASE WHEN txn_type = 'C' THEN amount END) AS credit_mean, max(CASE WHEN txn_type = 'C' THEN amount END) AS credit_max,
  count(CASE WHEN txn_type = 'D' THEN amount END) AS debit_count, coalesce({_SIDE.format(t='D')}, 0) AS debit_total,
  {_SIDE.format(t='D')} / count(CASE WHEN txn_type = 'D' THEN amount END) AS debit_mean, max(CASE WHEN txn_type = 'D' THEN amount END) AS debit_max
  FROM txn GROUP BY account_id)
SELECT *, round(debit_total / greatest(credit_total, 1), 6) AS passthrough_ratio,
  CAST(CAST(credit_total AS DECIMAL(18,2)) - CAST(debit_total AS DECIMAL(18,2)) AS DOUBLE) AS net_flow,
  round(credit_count / greatest(credit_count + debit_count, 1), 6) AS credit_debit_ratio FROM g"""
)
def flow_credit_debit(spark, sf_dir):
    return rounded(features.flow(txn_e(spark, sf_dir)), "passthrough_ratio", "credit_debit_ratio")


def _rate(cond: str) -> str:
    return f"round(CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6)"


@query(
    f"""WITH {TXN_T} SELECT account_id, {_rate('amount >= 45000 AND amount < 50000')} AS near_50k_rate, {_rate('amount >= 9000 AND amount < 10000')} AS near_10k_rate,
  {_rate('amount % 1000 = 0')} AS round_1k_rate, {_rate('amount % 5000 = 0')} AS round_5k_rate, {_rate('amount % 10000 = 0')} AS round_10k_rate,
  {_rate('amount % 50000 = 0')} AS round_50k_rate, {_rate('amount < 0')} AS negative_rate FROM txn GROUP BY account_id"""
)
def structuring_rates(spark, sf_dir):
    out = features.structuring(txn_t(spark, sf_dir))
    return rounded(out, *[c for c in out.columns if c != "account_id"])


@query(f"""WITH {TXN_E} SELECT account_id, {_rate('floor(amount) % 5 = 0')} AS round_5_rate, {_rate('floor(amount) % 10 = 0')} AS round_10_rate, {_rate('floor(amount) % 50 = 0')} AS round_50_rate FROM txn GROUP BY 1""")
def round_amount_rates(spark, sf_dir):
    a = F.floor("amount")
    out = txn_e(spark, sf_dir).groupBy("account_id").agg(*[X.share(X.multiple_of(a, k)).alias(f"round_{k}_rate") for k in (5, 10, 50)])
    return rounded(out, "round_5_rate", "round_10_rate", "round_50_rate")


@query(
    f"""WITH {TXN_E}, c AS (SELECT account_id, channel, count(*) AS n FROM txn WHERE channel IS NOT NULL GROUP BY 1, 2)
SELECT account_id, channel, n, round(n / sum(n) OVER (PARTITION BY account_id), 6) AS share FROM c"""
)
def channel_mix(spark, sf_dir):
    return rounded(features.category_shares(txn_e(spark, sf_dir), "channel"), "share")


def _entropy(cat: str, name: str, extra: str = "") -> str:
    return f"""c AS (SELECT account_id, {cat} AS k, count(*) AS n FROM txn WHERE {cat} IS NOT NULL GROUP BY 1, 2),
p AS (SELECT account_id, n / sum(n) OVER (PARTITION BY account_id) AS p FROM c)
SELECT account_id, round(abs(sum(-p * ln(p))), 6) AS {name}{extra} FROM p GROUP BY 1"""


@query(f"WITH {TXN_E}, {_entropy('channel', 'channel_entropy', ', count(*) AS n_channels_used')}")
def channel_entropy(spark, sf_dir):
    return rounded(features.entropy(txn_e(spark, sf_dir), "channel", "channel_entropy", "n_channels_used"), "channel_entropy")


@query(f"WITH {TXN_T}, {_entropy('mcc_code', 'mcc_entropy')}")
def mcc_entropy(spark, sf_dir):
    return rounded(features.entropy(txn_t(spark, sf_dir, True), "mcc_code", "mcc_entropy"), "mcc_entropy")


@query(f"WITH {TXN_T} SELECT account_id, " + ", ".join(f"{_rate(f'mcc_code = {k}')} AS mcc_{k}_rate" for k in (1, 7, 13, 25, 50)) + " FROM txn GROUP BY 1")
def mcc_rates(spark, sf_dir):
    out = features.category_rates(txn_t(spark, sf_dir, True), "mcc_code", [1, 7, 13, 25, 50], "mcc_", False)
    return rounded(out, *out.columns[1:])


@query(
    f"WITH {TXN_E} SELECT account_id, "
    + ", ".join(f"coalesce(round(CAST(sum(CASE WHEN channel = '{k}' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(channel), 0), 6), 0) AS ch_{k}_rate" for k in ("click", "purchase", "view", "absent"))
    + " FROM txn GROUP BY 1"
)
def channel_rates(spark, sf_dir):
    out = features.category_rates(txn_e(spark, sf_dir), "channel", ["click", "purchase", "view", "absent"], "ch_", True)
    return rounded(out, *out.columns[1:])


@query(f"WITH {TXN_E}, {_entropy('hour(transaction_timestamp)', 'hour_entropy')}")
def hour_entropy(spark, sf_dir):
    return rounded(features.entropy(txn_e(spark, sf_dir), F.hour("transaction_timestamp"), "hour_entropy"), "hour_entropy")


@query(
    f"""WITH {TXN_E} SELECT account_id, {_rate('hour(transaction_timestamp) < 6')} AS night_rate, {_rate('isodow(transaction_timestamp) >= 6')} AS weekend_rate,
  {_rate('day(transaction_timestamp) <= 5 OR day(transaction_timestamp) >= 25')} AS salary_window_rate FROM txn GROUP BY 1"""
)
def temporal_rates(spark, sf_dir):
    return rounded(features.temporal(txn_e(spark, sf_dir)), "night_rate", "weekend_rate", "salary_window_rate")


@query(
    f"""WITH {TXN_E}, g AS (SELECT account_id, (epoch_us(transaction_timestamp) - lag(epoch_us(transaction_timestamp)) OVER (PARTITION BY account_id ORDER BY transaction_timestamp)) / 3.6e9 AS gap FROM txn)
SELECT account_id, round(quantile_cont(gap, 0.5), 6) AS med_gap_hrs, round(min(gap), 6) AS min_gap_hrs, round(stddev_samp(gap), 6) AS std_gap_hrs, round(quantile_cont(gap, 0.1), 6) AS p10_gap_hrs FROM g GROUP BY 1"""
)
def velocity_gaps(spark, sf_dir):
    return rounded(features.gaps(txn_e(spark, sf_dir)), "med_gap_hrs", "min_gap_hrs", "std_gap_hrs", "p10_gap_hrs")


@query(
    f"""WITH {TXN_E}, d AS (SELECT account_id, CAST(transaction_timestamp AS DATE) AS d, count(*) AS n, coalesce(sum(CAST(amount AS DECIMAL(18,2))), 0) AS v FROM txn GROUP BY 1, 2),
g AS (SELECT account_id, avg(n) AS m, max(n) AS max_daily_txn, stddev_samp(n) AS s, count(*) AS n_active_days, CAST(sum(v) AS DOUBLE) / count(*) AS ma, CAST(max(v) AS DOUBLE) AS max_daily_amount FROM d GROUP BY 1)
SELECT account_id, round(m, 6) AS mean_daily_txn, max_daily_txn, round(s, 6) AS std_daily_txn, n_active_days, round(ma, 6) AS mean_daily_amount, max_daily_amount,
  round(max_daily_txn / greatest(m, 0.01), 6) AS burstiness, round(max_daily_amount / greatest(ma, 0.01), 6) AS amount_burstiness FROM g"""
)
def daily_bursts(spark, sf_dir):
    return rounded(features.bursts(txn_e(spark, sf_dir)), "mean_daily_txn", "std_daily_txn", "mean_daily_amount", "burstiness", "amount_burstiness")


@query(
    f"""WITH {TXN_T} SELECT account_id, count(DISTINCT counterparty_id) AS n_counterparties, count(DISTINCT CASE WHEN txn_type = 'C' THEN counterparty_id END) AS in_degree,
  count(DISTINCT CASE WHEN txn_type = 'D' THEN counterparty_id END) AS out_degree FROM txn GROUP BY 1"""
)
def counterparty_degrees(spark, sf_dir):
    return features.degrees(txn_t(spark, sf_dir))


@query(
    f"""WITH {ACCOUNTS_T}, b AS (SELECT *, list_filter([avg_balance, monthly_avg_balance, quarterly_avg_balance, daily_avg_balance], lambda x: x IS NOT NULL) AS l FROM acct)
SELECT account_id, {days(f"TIMESTAMP '{REF}'", 'account_opening_date')} AS acct_age_days, round({days(f"TIMESTAMP '{REF}'", 'account_opening_date')} / 30.44, 6) AS acct_age_months,
  CAST(freeze_date IS NOT NULL AS INT) AS was_frozen, CAST(unfreeze_date IS NOT NULL AS INT) AS was_unfrozen, CAST(last_mobile_update_date IS NOT NULL AS INT) AS had_mobile_update,
  {days(f"TIMESTAMP '{REF}'", 'last_mobile_update_date')} AS days_since_mobile_update, {days('unfreeze_date', 'freeze_date')} AS frozen_duration,
  round(list_max(l) - list_min(l), 6) AS balance_range, round(CASE WHEN len(l) > 1 THEN list_aggregate(l, 'stddev_samp') END, 6) AS balance_std FROM b"""
)
def account_features(spark, sf_dir):
    out = features.account_attributes(accounts_t(spark, sf_dir), REF)
    names = ["acct_age_days", "acct_age_months", "was_frozen", "was_unfrozen", "had_mobile_update", "days_since_mobile_update", "frozen_duration", "balance_range", "balance_std"]
    return rounded(out.select("account_id", *names), "acct_age_months", "balance_range", "balance_std")


def _code(c: str) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY coalesce(CAST({c} AS VARCHAR), 'MISSING') COLLATE C) - 1 AS INT) AS {c}_enc"


@query(f"WITH {ACCOUNTS_T} SELECT account_id, {', '.join(_code(c).replace(' COLLATE C', '') for c in ('account_status', 'product_family', 'nomination_flag', 'kyc_compliant'))} FROM acct")
def label_encoding(spark, sf_dir):
    cols = ("account_status", "product_family", "nomination_flag", "kyc_compliant")
    return features.encode(accounts_t(spark, sf_dir), *cols).select("account_id", *[f"{c}_enc" for c in cols])


@query(
    f"""WITH {ACCOUNTS_T}, n AS (SELECT branch_code, count(*) AS n_accounts_customer FROM acct GROUP BY 1)
SELECT account_id, CAST(coalesce(customer_pin <> permanent_pin, true) AS INT) AS pin_mismatch,
  CAST(coalesce(nomination_flag = 'Y', false) AS INT) + CAST(coalesce(kyc_compliant = 'Y', false) AS INT) AS kyc_score, n_accounts_customer FROM acct JOIN n USING (branch_code)"""
)
def customer_scores(spark, sf_dir):
    a = accounts_t(spark, sf_dir)
    n = a.groupBy("branch_code").agg(F.count(F.lit(1)).alias("n_accounts_customer"))
    out = features.flag_score(a.withColumn("pin_mismatch", X.differs(F.col("customer_pin"), F.col("permanent_pin")).cast("int")), ("nomination_flag", "kyc_compliant"), "kyc_score")
    return out.join(n, "branch_code").select("account_id", "pin_mismatch", "kyc_score", "n_accounts_customer")


@query(
    f"""WITH {TXN_T}, {ACCOUNTS_T}, g AS (SELECT account_id, count(transaction_id) AS txn_count, {_SUM} AS total_amount, max(amount) AS max_amount FROM txn GROUP BY 1)
SELECT account_id, round(total_amount / CASE WHEN avg_balance IS NOT NULL THEN greatest(avg_balance, 1) END, 6) AS txn_to_balance_ratio,
  round(max_amount / CASE WHEN avg_balance IS NOT NULL THEN greatest(avg_balance, 1) END, 6) AS max_txn_to_balance,
  round(txn_count / CASE WHEN account_opening_date IS NOT NULL THEN greatest({days(f"TIMESTAMP '{REF}'", 'account_opening_date')}, 1) END, 6) AS acct_age_txn_ratio FROM g LEFT JOIN acct USING (account_id)"""
)
def derived_ratios(spark, sf_dir):
    a = features.account_attributes(accounts_t(spark, sf_dir), REF)
    g = txn_t(spark, sf_dir).groupBy("account_id").agg(F.count("transaction_id").alias("txn_count"), X.exact_sum(F.col("amount")).alias("total_amount"), F.max("amount").alias("max_amount"))
    out = features.ratios(g.join(a.select("account_id", "avg_balance", "acct_age_days"), "account_id", "left"))
    names = ("txn_to_balance_ratio", "max_txn_to_balance", "acct_age_txn_ratio")
    return rounded(out.select("account_id", *names), *names)


@query(
    f"""WITH {TXN_T}, {ACCOUNTS_T}, g AS (SELECT account_id, CAST(count(*) AS DOUBLE) AS txn_count, max(amount) AS max_amount FROM txn GROUP BY 1)
SELECT account_id, txn_count, max_amount, coalesce(avg_balance, 0) AS avg_balance, round(coalesce(max_amount / CASE WHEN avg_balance IS NOT NULL THEN greatest(avg_balance, 1) END, 0), 6) AS ratio FROM g LEFT JOIN acct USING (account_id)"""
)
def feature_matrix(spark, sf_dir):
    g = txn_t(spark, sf_dir).groupBy("account_id").agg(F.count(F.lit(1)).alias("txn_count"), F.max("amount").alias("max_amount"))
    j = g.join(accounts_t(spark, sf_dir).select("account_id", "avg_balance"), "account_id", "left").withColumn("ratio", X.guarded_ratio(F.col("max_amount"), F.col("avg_balance"), 1.0))
    return rounded(features.matrix(j, ["txn_count", "max_amount", "avg_balance", "ratio"]), "ratio")


# --- joins, sets, quality -----------------------------------------------------------------------


@query(
    """SELECT c_custkey AS account_id, n_name, r_name, s.n_suppliers, round(s.balance, 2) AS supplier_balance FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n_suppliers, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance FROM supplier WHERE s_acctbal > 0 GROUP BY 1) s ON s_nationkey = c_nationkey"""
)
def train_table_join(spark, sf_dir):
    """A chain of left joins from the fact to its dimensions."""
    c, n, r = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    s = read(spark, sf_dir, "supplier").filter("s_acctbal > 0").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_suppliers"), X.exact_sum(F.col("s_acctbal")).alias("b"))
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").join(s, c.c_nationkey == s.s_nationkey, "left")
    return j.select(F.col("c_custkey").alias("account_id"), "n_name", "r_name", "n_suppliers", F.round("b", 2).alias("supplier_balance"))


@query("SELECT count(*) AS n_rows, count(o_custkey) AS n_matched, count(o_custkey) / count(*) AS coverage FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey")
def join_coverage(spark, sf_dir):
    own = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("has")).distinct()
    return quality.coverage(read(spark, sf_dir, "customer"), own, "c_custkey", "has")


@query(
    """SELECT o_orderkey, count(*) AS n_lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY
GROUP BY 1"""
)
def join_then_range(spark, sf_dir):
    """An equi-join with a date range on top: the equality is hashed, the range is checked at the join."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    near = (li.l_shipdate >= o.o_orderdate) & (li.l_shipdate < o.o_orderdate + F.expr("INTERVAL 30 DAY"))
    return o.join(li, (o.o_orderkey == li.l_orderkey) & near).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), X.exact_sum(F.col("l_extendedprice")).alias("amount"))


@query("SELECT count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def semi_join_filter(spark, sf_dir):
    o = read(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1"))
    li = read(spark, sf_dir, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey, "left_semi").agg(F.count(F.lit(1)).alias("n"), X.exact_sum(F.col("l_extendedprice")).alias("total"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def anti_join_orphans(spark, sf_dir):
    """Customers without any urgent order."""
    urgent = read(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1"))
    return quality.orphans(read(spark, sf_dir, "customer"), urgent, "c_custkey", "o_custkey")


@query("SELECT count(*) AS n_missing, CAST(count(*) = 0 AS INT) AS all_present FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))")
def membership_check(spark, sf_dir):
    return quality.all_members(read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), "o_custkey", "c_custkey")


def _keys(spark, sf_dir, side: int):
    return read(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 3 != side).select(F.col("o_custkey").alias("account_id"))


_A, _B = (f"SELECT o_custkey AS account_id FROM orders WHERE o_orderkey % 3 <> {k}" for k in (0, 1))


@query(f"{_A} INTERSECT {_B}")
def set_overlap(spark, sf_dir):
    return _keys(spark, sf_dir, 0).intersect(_keys(spark, sf_dir, 1))


@query(f"{_A} UNION {_B}")
def set_union(spark, sf_dir):
    return _keys(spark, sf_dir, 0).union(_keys(spark, sf_dir, 1)).distinct()


@query(f"{_A} EXCEPT {_B}")
def set_difference(spark, sf_dir):
    return _keys(spark, sf_dir, 0).subtract(_keys(spark, sf_dir, 1))


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def dedup_keys(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()


@query("SELECT count(*) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_distinct, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem")
def duplicate_count(spark, sf_dir):
    return quality.duplicate_count(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT 'customer' AS table_name, count(*) AS n_rows, 5 :: BIGINT AS n_cols FROM customer UNION ALL SELECT 'orders', count(*), 6 FROM orders UNION ALL SELECT 'events', count(*), 6 FROM events")
def table_shapes(spark, sf_dir):
    return quality.shape({n: read(spark, sf_dir, n) for n in ("customer", "orders", "events")})


@query("SELECT * FROM (VALUES ('bigint', 4 :: BIGINT), ('double', 4), ('int', 2), ('string', 4), ('timestamp_ntz', 4)) v(dtype, n_columns)")
def dtype_histogram(spark, sf_dir):
    return quality.dtype_histogram(spark, accounts_t(spark, sf_dir))


_NULLABLE = ("avg_balance", "quarterly_avg_balance", "kyc_compliant", "permanent_pin", "last_mobile_update_date", "unfreeze_date")


@query(f"WITH {ACCOUNTS_T} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, 100.0 :: DOUBLE * (count(*) - count({c})) / count(*) AS pct_null FROM acct" for c in _NULLABLE))
def null_profile(spark, sf_dir):
    return quality.null_profile(accounts_t(spark, sf_dir).select(*_NULLABLE))


@query(f"WITH {ACCOUNTS_T} " + " UNION ALL ".join(f"SELECT is_mule, '{c}' AS column_name, CAST(count(*) - count({c}) AS DOUBLE) / count(*) AS missing_rate FROM acct GROUP BY 1" for c in _NULLABLE))
def missing_by_class(spark, sf_dir):
    return quality.missing_by_class(accounts_t(spark, sf_dir).select("is_mule", *_NULLABLE), "is_mule")


@query(
    f"WITH {ACCOUNTS_T}, l AS (SELECT is_mule, avg_balance, kyc_compliant, CASE WHEN is_mule = 1 THEN freeze_date END AS mule_flag_date FROM acct) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NOT NULL AND is_mule = 1) AS n_positive, count(*) FILTER ({c} IS NOT NULL AND is_mule = 0) AS n_negative, "
        f"CAST(count(*) FILTER ({c} IS NOT NULL AND is_mule = 1) > 0 AND count(*) FILTER ({c} IS NOT NULL AND is_mule = 0) = 0 AS INT) AS leaks FROM l"
        for c in ("avg_balance", "kyc_compliant", "mule_flag_date")
    )
)
def leakage_audit(spark, sf_dir):
    a = accounts_t(spark, sf_dir)
    return quality.leakage_audit(a.select("is_mule", "avg_balance", "kyc_compliant", F.when(F.col("is_mule") == 1, F.col("freeze_date")).alias("mule_flag_date")), "is_mule")


@query(
    """WITH a AS (SELECT CAST(c_acctbal AS DECIMAL(18,2)) AS x FROM customer), g AS (SELECT count(*) AS n_rows, count(*) FILTER (x < 0) AS n_negative, count(*) FILTER (x = 0) AS n_zero,
  coalesce(CAST(sum(-x) FILTER (x < 0) AS DOUBLE), 0) AS reversed_amount, coalesce(CAST(sum(x) FILTER (x > 0) AS DOUBLE), 0) AS positive_amount FROM a)
SELECT *, n_negative / n_rows AS negative_share, reversed_amount / positive_amount AS reversal_amount_ratio FROM g"""
)
def sign_profile(spark, sf_dir):
    return quality.sign_profile(read(spark, sf_dir, "customer"), "c_acctbal")


_MIS = {"state_branch": ("customer_pin", "branch_pin", 10000), "district_branch": ("customer_pin", "branch_pin", 1000), "state_permanent": ("customer_pin", "permanent_pin", 10000), "district_permanent": ("customer_pin", "permanent_pin", 1000)}
_MISQ = {k: f"CAST((floor({a} / {n}) <> floor({b} / {n})) AS INT)" for k, (a, b, n) in _MIS.items()}


@query(
    f"WITH {ACCOUNTS_T} SELECT account_id, "
    + ", ".join(f"{q} AS {k}_mismatch" for k, q in _MISQ.items())
    + f", round(({' + '.join(f'coalesce({q}, 0)' for q in _MISQ.values())}) / nullif({' + '.join(f'CAST({q} IS NOT NULL AS INT)' for q in _MISQ.values())}, 0), 6) AS geo_mismatch_score FROM acct"
)
def geo_mismatch(spark, sf_dir):
    out = quality.pin_checks(accounts_t(spark, sf_dir))
    return rounded(out.select("account_id", *[f"{k}_mismatch" for k in _MIS], "geo_mismatch_score"), "geo_mismatch_score")


# --- profiles -----------------------------------------------------------------------------------


@query(f"WITH {ACCOUNTS_T} SELECT kyc_compliant AS value, count(*) AS n, count(*) / (SELECT count(*) FROM acct) AS share FROM acct GROUP BY 1")
def value_distribution(spark, sf_dir):
    return profile.value_distribution(accounts_t(spark, sf_dir), "kyc_compliant")


@query(
    f"""WITH {ACCOUNTS_T}, c AS (SELECT is_mule, kyc_compliant, count(*) AS n FROM acct WHERE kyc_compliant IS NOT NULL GROUP BY 1, 2)
SELECT *, n / sum(n) OVER (PARTITION BY is_mule) AS share FROM c"""
)
def crosstab_share(spark, sf_dir):
    return profile.crosstab(accounts_t(spark, sf_dir), "is_mule", "kyc_compliant")


@query(
    f"""WITH {TXN_T}, {ACCOUNTS_T} SELECT is_mule, count(amount) AS n, {_SUM} / count(amount) AS mean, round(stddev_samp(amount), 6) AS std, min(amount) AS min, max(amount) AS max,
  round(quantile_cont(amount, 0.25), 6) AS p25, round(quantile_cont(amount, 0.5), 6) AS median, round(quantile_cont(amount, 0.75), 6) AS p75, round(quantile_cont(amount, 0.95), 6) AS p95
FROM txn LEFT JOIN acct USING (account_id) GROUP BY 1"""
)
def class_summary(spark, sf_dir):
    return rounded(profile.class_summary(labelled_t(spark, sf_dir), "is_mule", "amount"), "std", "p25", "median", "p75", "p95")


def labelled_t(spark, sf_dir, mcc: bool = False):
    """Transactions with their account's label; the label depends on customers only, so their orders are not read."""
    y = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("is_mule"))
    t = txn_t(spark, sf_dir, mcc, y)
    return t.select("account_id", *[c for c in t.columns if c != "account_id"])


@query(f"WITH {TXN_T}, {ACCOUNTS_T} SELECT mcc_code, count(*) AS n, CAST(sum(is_mule) AS BIGINT) AS n_positive, sum(is_mule) / count(*) AS rate FROM txn LEFT JOIN acct USING (account_id) GROUP BY 1 HAVING count(*) >= 100")
def rate_by_group_min_support(spark, sf_dir):
    return profile.rate_by_group(labelled_t(spark, sf_dir, True), "mcc_code", "is_mule", 100, "mcc_code")


@query(
    f"""WITH {ACCOUNTS_T}, b AS (SELECT is_mule, {days(f"TIMESTAMP '{REF}'", 'account_opening_date')} / 30.44 AS m FROM acct),
c AS (SELECT is_mule, CAST(CASE WHEN m > 0 AND m <= 12 THEN 0 WHEN m > 12 AND m <= 24 THEN 1 WHEN m > 24 AND m <= 60 THEN 2 WHEN m > 60 AND m <= 1200 THEN 3 END AS INT) AS age_bin FROM b)
SELECT age_bin, count(*) AS n, CAST(sum(is_mule) AS BIGINT) AS n_positive, sum(is_mule) / count(*) AS rate FROM c WHERE age_bin IS NOT NULL GROUP BY 1"""
)
def binned_rate(spark, sf_dir):
    return patterns.new_accounts(accounts_t(spark, sf_dir), REF, [0, 12, 24, 60, 1200])


@query(
    """WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
SELECT CAST(greatest(0, least(9, CAST(ceil((c_acctbal - lo) / ((hi - lo) / 10)) AS INT) - 1)) AS INT) AS bin, count(*) AS n FROM customer, s GROUP BY 1"""
)
def equal_width_bins(spark, sf_dir):
    return profile.equal_bins(read(spark, sf_dir, "customer"), "c_acctbal", 10).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {TXN_T}, {ACCOUNTS_T}, c AS (SELECT CAST(CAST(date_trunc('quarter', transaction_timestamp) AS DATE) AS VARCHAR) AS period, is_mule, count(*) AS n FROM txn LEFT JOIN acct USING (account_id) GROUP BY 1, 2)
SELECT *, n / max(n) OVER (PARTITION BY is_mule) AS relative FROM c"""
)
def period_volume(spark, sf_dir):
    return dated(profile.period_volume(labelled_t(spark, sf_dir), "transaction_timestamp", "quarter", "is_mule"), "period")


@query(
    f"""WITH {TXN_T}, {ACCOUNTS_T}, c AS (SELECT mcc_code, count(*) FILTER (is_mule = 1) AS n1, count(*) FILTER (is_mule = 0) AS n0 FROM txn LEFT JOIN acct USING (account_id) GROUP BY 1),
s AS (SELECT mcc_code, n1 / (SELECT sum(n1) FROM c) AS a, n0 / (SELECT sum(n0) FROM c) AS b FROM c)
SELECT mcc_code, round(a, 6) AS share_1, round(b, 6) AS share_0, round(a - b, 6) AS diff FROM s ORDER BY round(a - b, 9) DESC, mcc_code LIMIT 12"""
)
def share_difference_topk(spark, sf_dir):
    return rounded(profile.share_difference(labelled_t(spark, sf_dir, True), "mcc_code", "is_mule", 12), "share_1", "share_0", "diff")


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i:]) + ")")
def correlation_matrix(spark, sf_dir):
    return rounded(profile.correlations(read(spark, sf_dir, "lineitem"), list(_NUM)), "corr")


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]) + ") SELECT a, b, corr, CAST(abs(corr) >= 0.7 :: DOUBLE AS INT) AS too_close FROM c ORDER BY abs(corr) DESC, a, b LIMIT 1")
def strongest_pair(spark, sf_dir):
    """The pair of columns with the largest correlation, and whether it reaches 0.70."""
    return profile.strongest_pair(rounded(profile.correlations(read(spark, sf_dir, "lineitem"), list(_NUM)), "corr"), 0.7)


@query(
    """WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), b AS (SELECT l_returnflag, CAST(least(floor((l_quantity - lo) / ((hi - lo) / 40)), 39) AS INT) AS bin, (hi - lo) / 40 AS w FROM lineitem, s),
c AS (SELECT l_returnflag, bin, count(*) AS n, any_value(w) AS w FROM b GROUP BY 1, 2)
SELECT l_returnflag, bin, n, round(n / (sum(n) OVER (PARTITION BY l_returnflag) * w), 6) AS density FROM c"""
)
def histogram_density(spark, sf_dir):
    return rounded(profile.histogram(read(spark, sf_dir, "lineitem"), "l_quantity", 40, "l_returnflag"), "density")


@query(
    """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(any_value(q1), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(q3), 6) AS q3,
  min(l_extendedprice) FILTER (l_extendedprice >= q1 - 1.5 * (q3 - q1)) AS low_whisker, max(l_extendedprice) FILTER (l_extendedprice <= q3 + 1.5 * (q3 - q1)) AS high_whisker,
  count(*) FILTER (l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM lineitem JOIN q USING (l_returnflag) GROUP BY 1"""
)
def box_stats(spark, sf_dir):
    return rounded(profile.box_stats(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice"), "q1", "median", "q3")


@query("SELECT DISTINCT l_returnflag, l_quantity, cume_dist() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS cdf FROM lineitem")
def empirical_cdf(spark, sf_dir):
    return profile.empirical_cdf(read(spark, sf_dir, "lineitem"), "l_quantity", "l_returnflag")


@query(
    f"WITH {ACCOUNTS_T} "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS flag, count(*) FILTER ({f} = 'Y' AND is_mule = 1) / count(*) FILTER (is_mule = 1) AS rate_1, count(*) FILTER ({f} = 'Y' AND is_mule = 0) / count(*) FILTER (is_mule = 0) AS rate_0, "
        f"count(*) FILTER ({f} = 'Y' AND is_mule = 1) / count(*) FILTER (is_mule = 1) - count(*) FILTER ({f} = 'Y' AND is_mule = 0) / count(*) FILTER (is_mule = 0) AS diff FROM acct"
        for f in ("nomination_flag", "kyc_compliant")
    )
)
def flag_prevalence(spark, sf_dir):
    return profile.flag_prevalence(accounts_t(spark, sf_dir), ["nomination_flag", "kyc_compliant"], "is_mule")


@query("SELECT c_custkey, least(greatest(c_acctbal, 0), 5000) AS clipped, round(log10(greatest(c_acctbal, 0.01)), 6) AS log_amount FROM customer WHERE c_acctbal > -500 AND c_acctbal < 8000")
def clipped_amounts(spark, sf_dir):
    c = read(spark, sf_dir, "customer").filter((F.col("c_acctbal") > -500) & (F.col("c_acctbal") < 8000))
    return rounded(c.select("c_custkey", X.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("clipped"), F.log10(X.clip_lower(F.col("c_acctbal"), 0.01)).alias("log_amount")), "log_amount")


# --- time series --------------------------------------------------------------------------------

DENSE = """d AS (SELECT account_id, CAST(transaction_timestamp AS DATE) AS day, count(*) AS n, coalesce(sum(CAST(amount AS DECIMAL(18,2))), 0) AS v FROM txn GROUP BY 1, 2),
span AS (SELECT account_id, unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS ts FROM d GROUP BY 1),
dense AS (SELECT s.account_id, CAST(s.ts AS DATE) AS day, coalesce(n, 0) AS n, coalesce(v, 0) AS v FROM span s LEFT JOIN d ON d.account_id = s.account_id AND d.day = CAST(s.ts AS DATE))"""


@query(f"WITH {TXN_E}, {DENSE} SELECT account_id, CAST(day AS VARCHAR) AS day, n, CAST(v AS DOUBLE) AS amount FROM dense")
def dense_daily_series(spark, sf_dir):
    return dated(timeseries.dense_daily(txn_e(spark, sf_dir)).withColumn("amount", F.col("amount").cast("double")), "day")


@query(f"WITH {TXN_E}, {DENSE} SELECT account_id, CAST(day AS VARCHAR) AS day, n, CAST(sum(n) OVER w AS BIGINT) AS n_7d, CAST(sum(v) OVER w AS DOUBLE) AS amount_7d FROM dense WINDOW w AS (PARTITION BY account_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def rolling_7d(spark, sf_dir):
    out = timeseries.rolling(timeseries.dense_daily(txn_e(spark, sf_dir)), 7, {"n_7d": "n", "amount_7d": "amount"})
    return dated(out.withColumn("amount_7d", F.col("amount_7d").cast("double")).drop("amount"), "day")


@query(
    f"""WITH {TXN_E}, {DENSE}, r AS (SELECT account_id, day, CAST(sum(n) OVER (PARTITION BY account_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS r FROM dense)
SELECT account_id, CAST(day AS VARCHAR) AS peak, r AS peak_value FROM r QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY r DESC, day) = 1"""
)
def peak_day(spark, sf_dir):
    return dated(timeseries.peak_day(timeseries.rolling(timeseries.daily(txn_e(spark, sf_dir)), 7, {"r": "n"}), "r"), "peak")


def _window_sql(txn: str, roll: int, reach: int) -> str:
    return f"""WITH {txn}, {DENSE}, ok AS (SELECT account_id FROM d GROUP BY 1 HAVING sum(n) >= 5 AND count(*) >= 3),
r AS (SELECT account_id, day, sum(n) OVER (PARTITION BY account_id ORDER BY day ROWS BETWEEN {roll - 1} PRECEDING AND CURRENT ROW) AS r FROM dense WHERE account_id IN (SELECT account_id FROM ok)),
p AS (SELECT account_id, day AS peak FROM r QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY r DESC, day) = 1)
SELECT account_id, CAST(peak AS VARCHAR) AS peak, strftime(min(day) FILTER (day >= peak - {reach} AND day <= peak), '%Y-%m-%dT00:00:00') AS suspicious_start,
  strftime(max(day) FILTER (day >= peak AND day <= peak + {reach}), '%Y-%m-%dT00:00:00') AS suspicious_end FROM d JOIN p USING (account_id) GROUP BY account_id, p.peak"""


def _iso(df):
    return dated(df.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") for c in ("suspicious_start", "suspicious_end")}), "peak")


@query(_window_sql(TXN_T, 30, 90))
def suspicious_window(spark, sf_dir):
    return _iso(timeseries.suspicious_windows(txn_t(spark, sf_dir)))


@query(_window_sql(TXN_E, 3, 5))
def suspicious_window_events(spark, sf_dir):
    return _iso(timeseries.suspicious_windows(txn_e(spark, sf_dir), roll=3, reach=5))


@query(
    f"""WITH {TXN_E}, w AS ({_window_sql(TXN_E, 3, 5).replace('WITH ' + TXN_E + ', ', 'WITH ')}), s AS (SELECT c_custkey AS account_id, (c_custkey % 10) / 10.0 :: DOUBLE AS score FROM customer)
SELECT account_id, score AS is_mule, coalesce(CASE WHEN score > 0.3 THEN suspicious_start END, '') AS suspicious_start, coalesce(CASE WHEN score > 0.3 THEN suspicious_end END, '') AS suspicious_end FROM s LEFT JOIN w USING (account_id)"""
)
def submission(spark, sf_dir):
    """Scores with the window of those above 0.3, as the prediction file has them."""
    from ..sources.io import predictions

    s = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), ((F.col("c_custkey") % 10) / 10.0).alias("score"))
    return predictions(s, timeseries.suspicious_windows(txn_e(spark, sf_dir), s, roll=3, reach=5))


@query(
    f"""WITH {TXN_E}, {DENSE} SELECT account_id, CAST(day AS VARCHAR) AS day, """
    + ", ".join(f"CAST(sum(n) OVER w{k} AS BIGINT) AS n_{k}d, CAST(sum(v) OVER w{k} AS DOUBLE) AS amount_{k}d" for k in (3, 10, 20))
    + " FROM d WINDOW "
    + ", ".join(f"w{k} AS (PARTITION BY account_id ORDER BY day RANGE BETWEEN INTERVAL {k - 1} DAY PRECEDING AND CURRENT ROW)" for k in (3, 10, 20))
)
def rolling_multi_window(spark, sf_dir):
    return dated(timeseries.multi_window(txn_e(spark, sf_dir), [3, 10, 20]), "day")


@query(
    f"""WITH {TXN_E}, k AS (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY transaction_timestamp DESC, transaction_id DESC) AS r FROM txn WHERE transaction_timestamp < TIMESTAMP '2024-01-15')
SELECT account_id, count(*) AS n_before, coalesce({_SUM}, 0) AS total_before, max(transaction_timestamp) AS last_ts, max(channel) FILTER (r = 1) AS last_channel FROM k GROUP BY 1"""
)
def point_in_time_features(spark, sf_dir):
    return timeseries.point_in_time(txn_e(spark, sf_dir), "2024-01-15")


@query(
    f"""WITH {TXN_E}, {DENSE}, s AS (SELECT account_id, day, count(*) OVER (PARTITION BY account_id) AS c, sum(n) OVER (PARTITION BY account_id ORDER BY day) * count(*) OVER (PARTITION BY account_id)
  - row_number() OVER (PARTITION BY account_id ORDER BY day) * sum(n) OVER (PARTITION BY account_id) AS s FROM dense)
SELECT account_id, CAST(day AS VARCHAR) AS change_day, CAST(abs(s) AS DOUBLE) / c AS cusum FROM s QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY abs(s) DESC, day) = 1"""
)
def change_points(spark, sf_dir):
    return dated(timeseries.cusum(timeseries.dense_daily(txn_e(spark, sf_dir))), "change_day")


@query(
    f"""WITH {TXN_E}, e AS (SELECT account_id, min(transaction_timestamp) AS event_ts FROM txn WHERE channel = 'signup' GROUP BY 1),
g AS (SELECT account_id, count(*) AS n, {_SUM} AS v FROM txn JOIN e USING (account_id) WHERE {days('transaction_timestamp', 'event_ts')} BETWEEN 0 AND 7 GROUP BY 1)
SELECT account_id, coalesce(n, 0) AS n_after, coalesce(v, 0) AS amount_after FROM e LEFT JOIN g USING (account_id)"""
)
def post_event_activity(spark, sf_dir):
    t = txn_e(spark, sf_dir)
    e = t.filter("channel = 'signup'").groupBy("account_id").agg(F.min("transaction_timestamp").alias("event_ts"))
    return timeseries.after_event(t, e, 7)


# --- patterns -----------------------------------------------------------------------------------


@query(
    f"""WITH {TXN_T}, {ACCOUNTS_T}, g AS (SELECT account_id, min(transaction_timestamp) AS a, max(transaction_timestamp) AS b, count(*) AS n FROM txn GROUP BY 1)
SELECT account_id, {days('a', 'account_opening_date')} AS dormant_days, {days('b', 'a')} AS span_days, round(n / greatest({days('b', 'a')}, 1), 6) AS txn_per_day FROM g JOIN acct USING (account_id)"""
)
def dormancy(spark, sf_dir):
    return rounded(patterns.dormancy(txn_t(spark, sf_dir), accounts_t(spark, sf_dir)), "txn_per_day")


@query(
    f"""WITH {TXN_T}, {ACCOUNTS_T}, g AS (SELECT account_id, {_SUM} AS total_amount FROM txn GROUP BY 1)
SELECT account_id, total_amount, avg_balance, round(total_amount / avg_balance, 6) AS ratio FROM g JOIN acct USING (account_id) WHERE avg_balance > 0"""
)
def income_mismatch(spark, sf_dir):
    return rounded(patterns.income_mismatch(txn_t(spark, sf_dir), accounts_t(spark, sf_dir)), "ratio")


@query(f"WITH {TXN_T} SELECT account_id, {_rate('day(transaction_timestamp) <= 5 OR day(transaction_timestamp) >= 25')} AS salary_window_rate FROM txn GROUP BY 1")
def salary_window(spark, sf_dir):
    return rounded(patterns.salary_window(txn_t(spark, sf_dir)), "salary_window_rate")


@query(f"WITH {ACCOUNTS_T} SELECT branch_code, count(*) AS n, CAST(sum(is_mule) AS BIGINT) AS n_positive, sum(is_mule) / count(*) AS rate FROM acct GROUP BY 1 HAVING count(*) >= 5 AND sum(is_mule) / count(*) > 0.1")
def branch_collusion(spark, sf_dir):
    return patterns.branch_collusion(accounts_t(spark, sf_dir), 5, 0.1)


@query(
    f"""WITH {TXN_T}, {ACCOUNTS_T}, g AS (SELECT account_id, CAST(sum(CASE WHEN amount >= 45000 AND amount < 50000 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS r FROM txn GROUP BY 1)
SELECT is_mule, count(*) AS n_accounts, round(avg(r), 6) AS mean_near_50k_rate, round(quantile_cont(r, 0.5), 6) AS median_near_50k_rate FROM g JOIN acct USING (account_id) GROUP BY 1"""
)
def pattern_by_class(spark, sf_dir):
    out = patterns.by_class(features.structuring(txn_t(spark, sf_dir)), accounts_t(spark, sf_dir), ["near_50k_rate"])
    return rounded(out, "mean_near_50k_rate", "median_near_50k_rate")


# --- statistics ---------------------------------------------------------------------------------

SCORED = "s AS (SELECT c_custkey AS account_id, c_nationkey AS seg, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS y, CAST((c_custkey * 37) % 101 AS DOUBLE) / 100 + CASE WHEN c_acctbal < 0 THEN 0.25 ELSE 0 END AS score FROM customer)"


def scored(spark, sf_dir):
    k, neg = F.col("c_custkey"), F.col("c_acctbal") < 0
    return read(spark, sf_dir, "customer").select(
        k.alias("account_id"), F.col("c_nationkey").alias("seg"), F.when(neg, 1).otherwise(0).alias("y"), (((k * 37) % 101).cast("double") / 100 + F.when(neg, 0.25).otherwise(0.0)).alias("score"), F.col("c_acctbal"),
    )


@query(
    f"""WITH {SCORED}, r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM s), t AS (SELECT sum(c * c * c - c) AS tie FROM (SELECT count(*) AS c FROM s GROUP BY score)),
g AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, sum(rk) FILTER (y = 1) AS r1 FROM r)
SELECT n1, n0, r1 - n1 * (n1 + 1) / 2 AS u1, CAST(tie AS DOUBLE) AS tie_term, round((r1 - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS effect, round(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) - 1, 6) AS rank_biserial FROM g, t"""
)
def mann_whitney_u(spark, sf_dir):
    return rounded(stats.mann_whitney(scored(spark, sf_dir), "score", "y"), "effect", "rank_biserial")


_CUM = "v AS (SELECT score, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM s GROUP BY 1)"


@query(
    f"""WITH {SCORED}, {_CUM}, c AS (SELECT sum(n1) OVER (ORDER BY score) / (SELECT sum(n1) FROM v) AS a, sum(n0) OVER (ORDER BY score) / (SELECT sum(n0) FROM v) AS b FROM v)
SELECT (SELECT CAST(sum(n1) AS BIGINT) FROM v) AS n1, (SELECT CAST(sum(n0) AS BIGINT) FROM v) AS n0, round(max(abs(a - b)), 6) AS ks FROM c"""
)
def ks_statistic(spark, sf_dir):
    return rounded(stats.ks(scored(spark, sf_dir), "score", "y"), "ks")


def _chi_sql(src: str, a: str, b: str) -> str:
    return f"""n AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT a, sum(n) AS ra FROM n GROUP BY 1), cb AS (SELECT b, sum(n) AS cb FROM n GROUP BY 1), t AS (SELECT sum(n) AS t, count(DISTINCT a) AS na, count(DISTINCT b) AS nb FROM n),
e AS (SELECT coalesce(n.n, 0) AS n, ra * cb / t AS e, t, na, nb FROM ra CROSS JOIN cb CROSS JOIN t LEFT JOIN n ON n.a = ra.a AND n.b = cb.b),
o AS (SELECT *, CASE WHEN na = 2 AND nb = 2 THEN abs(n - e) - least(0.5, abs(n - e)) ELSE abs(n - e) END AS o FROM e), x AS (SELECT sum(o * o / e) AS chi2, any_value(t) AS t, any_value(na) AS na, any_value(nb) AS nb FROM o)
SELECT round(chi2, 6) AS chi2, (na - 1) * (nb - 1) AS dof, CAST(t AS BIGINT) AS n, round(sqrt(chi2 / (t * (least(na, nb) - 1))), 6) AS cramers_v FROM x"""


@query(f"WITH {ACCOUNTS_T}, " + _chi_sql("acct", "is_mule", "kyc_compliant"))
def chi_square(spark, sf_dir):
    """Two by two, with Yates' correction."""
    return rounded(stats.chi_square(accounts_t(spark, sf_dir), "is_mule", "kyc_compliant"), "chi2", "cramers_v")


@query(f"WITH {ACCOUNTS_T}, " + _chi_sql("acct", "is_mule", "product_family"))
def cramers_v(spark, sf_dir):
    return rounded(stats.chi_square(accounts_t(spark, sf_dir), "is_mule", "product_family"), "chi2", "cramers_v")


@query(
    f"""WITH {ACCOUNTS_T}, n AS (SELECT is_mule AS a, product_family AS b, count(*) AS n FROM acct WHERE product_family IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT a, sum(n) AS ra FROM n GROUP BY 1), cb AS (SELECT b, sum(n) AS cb FROM n GROUP BY 1)
SELECT ra.a, cb.b, coalesce(n.n, 0) AS n, round(ra * cb / (SELECT sum(n) FROM n), 6) AS expected FROM ra CROSS JOIN cb LEFT JOIN n ON n.a = ra.a AND n.b = cb.b"""
)
def chi_square_expected(spark, sf_dir):
    """Observed and expected counts of every cell of a contingency table."""
    return rounded(stats.expected_counts(accounts_t(spark, sf_dir), "is_mule", "product_family"), "expected")


@query()
def test_p_values(spark, sf_dir):
    """p-values of three tests with stars and Bonferroni's adjustment; each statistic is one row."""
    s, a = scored(spark, sf_dir), accounts_t(spark, sf_dir)
    u, d, c = stats.mann_whitney(s, "score", "y").first(), stats.ks(s, "score", "y").first(), stats.chi_square(a, "is_mule", "product_family").first()
    rows = [
        ("mann_whitney", float(u.u1), stats.mann_whitney_p(u.n1, u.n0, u.u1, u.tie_term)), ("ks", float(d.ks), stats.ks_p(d.n1, d.n0, d.ks)),
        ("chi_square", float(c.chi2), stats.chi_square_p(c.chi2, c.dof)),
    ]
    out = spark.createDataFrame(rows, "test string, statistic double, p_value double")
    return out.withColumns({"stars": stats.stars(F.col("p_value")), "adjusted": stats.bonferroni(F.col("p_value"), 3)})


@query(
    f"""WITH {SCORED}, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM s), g AS (SELECT count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, sum(rk) FILTER (y = 1) AS r1 FROM r)
SELECT n1, n0, round((r1 - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS auc FROM g"""
)
def roc_auc(spark, sf_dir):
    return rounded(stats.roc_auc(scored(spark, sf_dir), "score", "y"), "auc")


@query(
    f"""WITH {SCORED}, {_CUM}, c AS (SELECT score, CAST(sum(n1) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(n0) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM v)
SELECT round(score, 6) AS threshold, tp, fp, round(tp / (SELECT sum(n1) FROM v), 6) AS tpr, round(fp / (SELECT sum(n0) FROM v), 6) AS fpr FROM c"""
)
def roc_curve(spark, sf_dir):
    return rounded(stats.roc_curve(scored(spark, sf_dir), "score", "y"), "threshold", "tpr", "fpr")


@query(
    f"""WITH {SCORED}, {_CUM}, c AS (SELECT score, CAST(sum(n1) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(n0) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM v)
SELECT round(score, 6) AS threshold, tp, fp, round(tp / (tp + fp), 6) AS precision, round(tp / (SELECT sum(n1) FROM v), 6) AS recall FROM c"""
)
def pr_curve(spark, sf_dir):
    return rounded(stats.pr_curve(scored(spark, sf_dir), "score", "y"), "threshold", "precision", "recall")


@query(
    f"""WITH {SCORED}, {_CUM}, c AS (SELECT n1, sum(n1) OVER (ORDER BY score DESC) AS tp, sum(n0) OVER (ORDER BY score DESC) AS fp FROM v)
SELECT CAST((SELECT sum(n1) FROM v) AS BIGINT) AS n1, round(sum(n1 / (SELECT sum(n1) FROM v) * (tp / (tp + fp))), 6) AS ap FROM c"""
)
def pr_average_precision(spark, sf_dir):
    return rounded(stats.average_precision(scored(spark, sf_dir), "score", "y"), "ap")


_TH = (0.1, 0.3, 0.5, 0.7, 0.9)


@query(f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT {t} :: DOUBLE AS threshold, count(*) FILTER (score > {t} :: DOUBLE) AS n_above FROM s" for t in _TH))
def threshold_counts(spark, sf_dir):
    return stats.threshold_counts(scored(spark, sf_dir), "score", list(_TH))


def _sweep(t: float) -> str:
    return f"""SELECT {t} :: DOUBLE AS threshold, count(*) FILTER (score >= {t} :: DOUBLE AND y = 1) AS tp, count(*) FILTER (score >= {t} :: DOUBLE AND y = 0) AS fp, count(*) FILTER (score < {t} :: DOUBLE AND y = 1) AS fn, count(*) FILTER (score < {t} :: DOUBLE AND y = 0) AS tn FROM s"""


@query(
    f"WITH {SCORED}, c AS ({' UNION ALL '.join(_sweep(t) for t in _TH)}) SELECT *, fn * 1000000 + fp * 50000 - tp * 500000 AS cost, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS fpr, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c"
)
def cost_sweep(spark, sf_dir):
    return rounded(models.cost_sweep(scored(spark, sf_dir), "score", "y", list(_TH)), "precision", "recall", "fpr", "f1")


@query(
    f"WITH {SCORED}, c AS ({' UNION ALL '.join(_sweep(t) for t in _TH)}), m AS (SELECT threshold, fn * 1000000 + fp * 50000 - tp * 500000 AS cost, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c), "
    "r AS (SELECT 'cost' AS criterion, threshold, cost, f1, row_number() OVER (ORDER BY cost, threshold) AS k FROM m UNION ALL SELECT 'f1', threshold, cost, f1, row_number() OVER (ORDER BY f1 DESC NULLS LAST, threshold) FROM m) "
    "SELECT criterion, threshold, cost, round(f1, 6) AS f1 FROM r WHERE k = 1"
)
def threshold_optimum(spark, sf_dir):
    """The thresholds of least cost and of best F1."""
    return rounded(models.optimal_thresholds(models.cost_sweep(scored(spark, sf_dir), "score", "y", list(_TH))), "f1")


@query(f"WITH {SCORED} SELECT CASE WHEN score >= 0.8 :: DOUBLE THEN 'high' WHEN score >= 0.4 :: DOUBLE THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM s GROUP BY 1")
def risk_tiers(spark, sf_dir):
    return models.tier_counts(patterns.routing(scored(spark, sf_dir), "score", 0.4, 0.8))


@query(
    f"""WITH {SCORED} SELECT seg, count(*) AS n, count(*) FILTER (score >= 0.8 :: DOUBLE) AS n_flagged, count(*) FILTER (score >= 0.8 :: DOUBLE) / count(*) AS flag_rate,
  count(*) FILTER (score >= 0.8 :: DOUBLE AND y = 0) / nullif(count(*) FILTER (y = 0), 0) AS fp_rate FROM s GROUP BY ROLLUP (seg)"""
)
def fairness_by_segment(spark, sf_dir):
    return models.fairness(scored(spark, sf_dir), "score", "y", "seg", 0.8)


@query(
    f"""WITH {SCORED}, b AS (SELECT account_id, score, c_acctbal FROM s JOIN customer ON c_custkey = account_id WHERE y = 0)
SELECT account_id, score, round(c_acctbal / (SELECT avg(c_acctbal) FROM b), 6) AS c_acctbal_vs_mean FROM b ORDER BY score DESC, account_id LIMIT 10"""
)
def false_positive_profile(spark, sf_dir):
    return rounded(models.false_positive_profile(scored(spark, sf_dir), "score", "y", ["c_acctbal"]), "c_acctbal_vs_mean")


# --- graph, models, text ------------------------------------------------------------------------

_GRAPH = "part_txn AS (SELECT user_id AS account_id, CAST(json_extract_string(props, '$.k') AS INT) AS counterparty_id FROM events)"


@query(
    f"""WITH {_GRAPH}, ac AS (SELECT DISTINCT account_id, counterparty_id FROM part_txn), lab AS (SELECT c_custkey AS account_id, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS y FROM customer WHERE c_custkey % 5 <> 0),
p AS (SELECT DISTINCT a.account_id, b.account_id AS peer, y FROM ac a JOIN ac b ON a.counterparty_id = b.counterparty_id AND a.account_id <> b.account_id JOIN lab ON lab.account_id = b.account_id)
SELECT account_id, count(*) AS n_peers, CAST(sum(y) AS BIGINT) AS n_bad, sum(y) / count(*) AS exposure FROM p GROUP BY 1"""
)
def two_hop_exposure(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    lab = c.select(F.col("c_custkey").alias("account_id"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("is_mule"), (F.col("c_custkey") % 5).alias("fold"))
    return graph.two_hop_exposure(txn_e(spark, sf_dir), lab, fold="fold", held_out=0)


_EDGES = f"""{TXN_T}, e AS (SELECT account_id + 1 AS src, -counterparty_id - 1 AS dst, CAST(sum(CAST(coalesce(amount, 0) AS DECIMAL(18,2))) AS DOUBLE) AS w FROM txn GROUP BY 1, 2)"""


def _pagerank_sql(rounds: int = 10) -> str:
    out = f"""WITH {_EDGES}, t AS (SELECT src, sum(w) AS t FROM e WHERE w > 0 GROUP BY 1), flow AS MATERIALIZED (SELECT e.src, dst, w / t AS p FROM e JOIN t ON e.src = t.src WHERE w > 0),
nodes AS MATERIALIZED (SELECT src AS node FROM flow UNION SELECT dst FROM flow), r0 AS (SELECT node, 1.0 :: DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"""
    for i in range(rounds):
        out += f""", g{i} AS MATERIALIZED (SELECT node, coalesce(got, 0) AS got FROM nodes LEFT JOIN (SELECT dst, sum(p * rank) AS got FROM flow JOIN r{i} ON src = node GROUP BY 1) ON dst = node),
r{i + 1} AS MATERIALIZED (SELECT node, (1 - 0.85 :: DOUBLE) / (SELECT count(*) FROM nodes) + 0.85 :: DOUBLE * (got + (1 - (SELECT sum(got) FROM g{i})) / (SELECT count(*) FROM nodes)) AS rank FROM g{i})"""
    return out + f" SELECT node, round(rank, 9) AS rank FROM r{rounds}"


def _labels_sql(rounds: int = 8) -> str:
    """The least label of a node and its neighbours, again and again; enough rounds for these tables' short paths."""
    out = f"WITH {_EDGES}, both_ways AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e), l0 AS (SELECT DISTINCT src AS node, src AS label FROM both_ways)"
    for i in range(rounds):
        out += f", l{i + 1} AS MATERIALIZED (SELECT node, least(label, m) AS label FROM l{i} JOIN (SELECT src, min(label) AS m FROM both_ways JOIN l{i} ON dst = node GROUP BY 1) ON src = node)"
    return out + f" SELECT node, label FROM l{rounds}"


@query(_pagerank_sql())
def pagerank(spark, sf_dir):
    return graph.pagerank(graph.edges(txn_t(spark, sf_dir))).withColumn("rank", F.round("rank", 9))


@query(_labels_sql())
def label_propagation(spark, sf_dir):
    return graph.label_propagation(graph.edges(txn_t(spark, sf_dir)))


@query()
def communities(spark, sf_dir):
    """Communities of accounts and counterparties by modularity, and the modularity of the division."""
    e = Tables(spark).keep(graph.edges(txn_t(spark, sf_dir)), "edges")  # read for the moves and for the modularity
    found = graph.communities(e, patience=2, gain=1e-3)
    return found.crossJoin(F.broadcast(graph.modularity(e, found).select("modularity")))  # one row


@query()
def betweenness(spark, sf_dir):
    return graph.betweenness(graph.edges(txn_t(spark, sf_dir)), epsilon=0.1)


@query(f"WITH {SCORED} SELECT account_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY md5(CAST(account_id AS VARCHAR) || ':42')) - 1) % 5 AS INT) AS fold FROM s")
def stratified_folds(spark, sf_dir):
    return models.stratified_folds(scored(spark, sf_dir).select("account_id", "y"), "account_id", "y")


_FEATURES = [
    "txn_count", "total_amount", "mean_amount", "std_amount", "max_amount", "min_amount", "credit_count", "credit_total", "debit_count", "debit_total", "passthrough_ratio", "net_flow",
    "credit_debit_ratio", "salary_window_rate", "weekend_rate", "near_10k_rate", "round_1k_rate", "n_counterparties", "in_degree", "out_degree",
]


def _numeric(spark, sf_dir):
    """Twenty features of every account with a transaction, and its label; written once, as fits and folds read it many times."""
    t = features.gathered(txn_t(spark, sf_dir).drop("channel"))  # no feature of the twenty reads it
    y = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("is_mule"))
    g = features.plain(t).join(features.degrees(t), "account_id").join(y, "account_id")
    return Tables(spark).keep(features.matrix(g, _FEATURES).join(y, "account_id"), "numeric")


@query()
def kmeans_distance(spark, sf_dir):
    return models.kmeans_distance(_numeric(spark, sf_dir), "account_id", _FEATURES)


@query()
def kmeans_profile(spark, sf_dir):
    """Size and share of positives of each cluster."""
    df = _numeric(spark, sf_dir)
    return models.cluster_shares(models.kmeans_distance(df, "account_id", _FEATURES), df, "account_id", "is_mule")


@query()
def pca_error(spark, sf_dir):
    return models.pca_error(_numeric(spark, sf_dir), "account_id", _FEATURES)


@query()
def isolation_score(spark, sf_dir):
    return models.isolation_scores(_numeric(spark, sf_dir), "account_id", _FEATURES)


@query()
def gbt_scores(spark, sf_dir):
    """Out-of-fold scores of boosted trees, a forest and their mean."""
    scores, _ = models.cross_validated(_numeric(spark, sf_dir), "account_id", "is_mule", _FEATURES)
    return scores


@query()
def mule_predictions(spark, sf_dir):
    """Accounts without a label (here every fifth): means over the folds' models, and the best of the three by AUC."""
    df = _numeric(spark, sf_dir).withColumn("is_mule", F.when(F.col("account_id") % 5 != 0, F.col("is_mule")))
    scores, _ = models.cross_validated(df, "account_id", "is_mule", _FEATURES)
    return scores.filter("is_mule is null").drop("is_mule", "fold")


@query(
    """SELECT doc_id, len(regexp_extract_all(text, '(?m)^[^\\n]*[0-9]+\\.[0-9]+[^\\n]*$')) AS n_numbered, length(regexp_replace(text, '[ \\t]+', ' ', 'g')) :: BIGINT AS squeezed_chars,
  replace(upper(lang), 'EN', 'English') AS language FROM documents"""
)
def regex_captions(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.size(F.regexp_extract_all("text", F.lit(r"(?m)^[^\n]*[0-9]+\.[0-9]+[^\n]*$"), 0)).cast("long").alias("n_numbered"), F.length(F.regexp_replace("text", "[ \\t]+", " ")).cast("long").alias("squeezed_chars"),
        F.replace(F.upper("lang"), F.lit("EN"), F.lit("English")).alias("language"),
    )


_MADE_MD = "'# A' || chr(10) || '*Table 1.' || page_id || ': old*' || chr(10) || 'x' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || url || chr(10) || '---' || chr(10) || 'end'"
_MADE_HTML = (
    "'<h2 id=\"table-of-contents\">Contents</h2>' || chr(10) || CASE WHEN page_id % 2 = 0 THEN '<ol><li>a</li></ol>' ELSE '<ul><li>a</li></ul>' END || '<p><img src=\"' || url || '\"/></p>' || chr(10) || "
    "'<p><em>Figure 2.' || page_id || ': a picture</em></p><p><img alt=\"b\"/></p><p><em>Table 3.' || page_id || ': numbers</em></p>' || html"
)


@query(
    f"""WITH m AS (SELECT page_id, {_MADE_MD} AS md, {_MADE_HTML} AS h FROM pages),
l AS (SELECT page_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS k FROM m),
n AS (SELECT *, lag(line) OVER w AS one, lag(line, 2) OVER w AS two FROM l WINDOW w AS (PARTITION BY page_id ORDER BY k)),
t AS (SELECT page_id, string_agg(line, chr(10) ORDER BY k) AS markdown FROM n
  WHERE line <> '---' AND NOT regexp_full_match(line, '[*]Table [0-9]+[.][0-9]+:.*[*]') AND NOT coalesce(one = '---' AND trim(line) = '' AND trim(two) = '', false) GROUP BY page_id),
f AS (SELECT page_id, regexp_replace(regexp_replace(h,
    '<p(?: [^<>]*)?>\\s*(<img [^<>]*>)\\s*</p>\\s*<p(?: [^<>]*)?>\\s*<em[^<>]*>\\s*(Figure\\s+[0-9]+[.][0-9]+\\s*:[^<>]*)</em>\\s*</p>', '<figure>\\1<figcaption>\\2</figcaption></figure>', 'g'),
    '<p(?: [^<>]*)?>\\s*(<img [^<>]*>)\\s*</p>', '<figure>\\1</figure>', 'g') AS h FROM m)
SELECT page_id, markdown, regexp_replace(regexp_replace(h, '<p(?: [^<>]*)?>\\s*<em[^<>]*>\\s*(Table\\s+[0-9]+[.][0-9]+\\s*:[^<>]*)</em>\\s*</p>', '<p class="table-caption">\\1</p>', 'g'),
    '(?s)(<h2 [^<>]*id="table-of-contents"[^<>]*>[^<>]*</h2>\\s*<[ou]l>.*?</[ou]l>)', '<div class="toc-page">\\1</div>') AS page FROM f JOIN t USING (page_id)"""
)
def report_rewrites(spark, sf_dir):
    """Markdown and HTML rewriting of reports: captions, rules, figures, contents."""
    made = read(spark, sf_dir, "pages").select("page_id", F.expr(_MADE_MD).alias("md"), F.expr(_MADE_HTML).alias("h"))
    return made.select("page_id", text.drop_rules(F.col("md")).alias("markdown"), text.wrap_contents(text.captioned(F.col("h"))).alias("page"))


@query(
    """WITH w AS (SELECT DISTINCT event_type || '_flag' AS name FROM events UNION SELECT DISTINCT lower(replace(p_type, ' ', '_')) FROM part)
SELECT name, array_to_string(list_transform(string_split(replace(replace(name, '_flag', ''), '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title FROM w"""
)
def column_titles(spark, sf_dir):
    """Column names as titles of a plot."""
    e = read(spark, sf_dir, "events").select(F.concat("event_type", F.lit("_flag")).alias("name"))
    names = e.unionByName(read(spark, sf_dir, "part").select(F.lower(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("name"))).distinct()
    return names.select("name", text.column_title(F.col("name")).alias("title"))


@query("""SELECT page_id, base64(encode(url)) AS url64, CASE lower(list_last(string_split(url, '.'))) WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'gif' THEN 'image/gif' WHEN 'svg' THEN 'image/svg+xml' ELSE 'application/octet-stream' END AS mime FROM pages""")
def base64_mime(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.base64_text(F.col("url")).alias("url64"), text.mime_type(F.col("url")).alias("mime"))


# --- further variants ---------------------------------------------------------------------------


@query(
    f"""WITH {ACCOUNTS_T} SELECT branch_code, count(*) AS n, CAST(sum(is_mule) AS BIGINT) AS n_positive, sum(is_mule) / count(*) AS rate, CAST(sum(is_mule) / count(*) > 0.1 AS INT) AS high_risk FROM acct GROUP BY 1 HAVING count(*) >= 3"""
)
def branch_scatter(spark, sf_dir):
    """Branch size against rate, with the overlay of risky ones: the data of a scatter plot."""
    return profile.rate_by_group(accounts_t(spark, sf_dir), "branch_code", "is_mule", 3, "branch_code").withColumn("high_risk", (F.col("rate") > 0.1).cast("int"))


@query(
    f"""WITH {SCORED}, b AS (SELECT y, CAST(least(floor((score - (SELECT min(score) FROM s)) / (((SELECT max(score) FROM s) - (SELECT min(score) FROM s)) / 16)), 15) AS INT) AS bin FROM s),
c AS (SELECT y, bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT y, bin, n, round(n / (sum(n) OVER (PARTITION BY y) * (((SELECT max(score) FROM s) - (SELECT min(score) FROM s)) / 16)), 6) AS density FROM c"""
)
def score_histogram(spark, sf_dir):
    return rounded(profile.histogram(scored(spark, sf_dir), "score", 16, "y"), "density")


@query(
    f"""WITH {SCORED}, f AS (SELECT *, account_id % 5 AS fold FROM s), r AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2 AS rk FROM f),
g AS (SELECT fold, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, sum(rk) FILTER (y = 1) AS r1 FROM r GROUP BY 1), a AS (SELECT (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc FROM g)
SELECT round(avg(auc), 6) AS mean, round(stddev_pop(auc), 6) AS std FROM a"""
)
def fold_auc_summary(spark, sf_dir):
    """Mean and population deviation of the folds' AUCs."""
    out = stats.auc_by(scored(spark, sf_dir).withColumn("fold", F.col("account_id") % 5), "score", "y", "fold")
    return rounded(stats.fold_summary(out, "auc"), "mean", "std")


@query("SELECT b, corr FROM (" + " UNION ALL ".join(f"SELECT '{b}' AS b, round(corr(l_extendedprice, {b}), 6) AS corr FROM lineitem" for b in ("l_quantity", "l_discount", "l_tax")) + ") ORDER BY abs(corr) DESC LIMIT 2")
def target_correlation(spark, sf_dir):
    """Correlations with one column, strongest first."""
    c = profile.correlations(read(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount", "l_tax"])
    own = c.filter("a = 'l_extendedprice' and b <> 'l_extendedprice'").select("b", X.r6(F.col("corr")).alias("corr"))
    return own.orderBy(F.abs("corr").desc(), "b").limit(2)


@query(
    """WITH k AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), b AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT count(*) AS n, sum(q) AS quantity FROM b JOIN k USING (l_orderkey, l_suppkey)"""
)
def dedup_join(spark, sf_dir):
    """A join on two keys to a side without repeats."""
    li = read(spark, sf_dir, "lineitem")
    b = li.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return b.join(li.select("l_orderkey", "l_suppkey").dropDuplicates(), ["l_orderkey", "l_suppkey"]).agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("quantity"))


@query(
    """SELECT o_custkey AS account_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3"""
)
def top_orders(spark, sf_dir):
    """The three largest per account; the rank limit is applied before the shuffle too."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = read(spark, sf_dir, "orders").withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
    return o.select(F.col("o_custkey").alias("account_id"), "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), X.exact_sum(F.col("l_extendedprice")).alias("total"))


@query()
def feature_importance(spark, sf_dir):
    _, importance = models.cross_validated(_numeric(spark, sf_dir), "account_id", "is_mule", _FEATURES, kinds=("boosted",))
    return spark.createDataFrame(importance, "feature string, importance double")


@query()
def tree_attributions(spark, sf_dir):
    """What each feature adds to every account's boosted score, as means over all accounts."""
    df = _numeric(spark, sf_dir)
    model = models.boosted(df, "is_mule", _FEATURES)
    return models.mean_attributions(models.attributions(model, df, "account_id", _FEATURES), _FEATURES)


@query()
def permutation_importance(spark, sf_dir):
    """Loss of AUC of a fitted model (8 rounds of leaf-wise boosting on twenty features) when one feature is shuffled."""
    df = Tables(spark).keep(_numeric(spark, sf_dir).withColumn("fold", F.lit(0)), "rows")
    model = boosting.train(df, "account_id", "is_mule", _FEATURES, k=1, params=boosting.Params(rounds=8, patience=8))[0]
    return boosting.permutation_importance(df, "account_id", "is_mule", model)


@query()
def noise_sensitivity(spark, sf_dir):
    """AUC with all positive labels, and without those of one kind (here every third positive)."""
    df, rows = _numeric(spark, sf_dir), []
    for name, part in (("all", df), ("without", df.filter("is_mule = 0 or account_id % 3 <> 0"))):
        scores, _ = models.cross_validated(part, "account_id", "is_mule", _FEATURES, kinds=("boosted",))
        rows.append((name, float(stats.roc_auc(scores, "score_boosted", "is_mule").first().auc)))
    return spark.createDataFrame(rows, "labels string, auc double")


@query()
def stacked_scores(spark, sf_dir):
    """Trees with the isolation forest's score as one more feature."""
    df = _numeric(spark, sf_dir)
    iso = models.isolation_scores(df, "account_id", _FEATURES).withColumnRenamed("score", "isolation")
    scores, _ = models.cross_validated(df.join(iso, "account_id"), "account_id", "is_mule", [*_FEATURES, "isolation"], kinds=("boosted",))
    return scores


@query(
    """WITH l AS (SELECT doc_id, unnest(range(0, len(p))) AS line_no, unnest(p) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
x AS (SELECT doc_id, line_no, CASE WHEN contains(raw, ' | ') THEN '| ' || raw ELSE raw END AS line FROM l),
f AS (SELECT *, (sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no)) % 2 = 0 AS open FROM x),
t AS (SELECT *, open AND starts_with(ltrim(line, ' '), '|') AS tab, CASE WHEN open AND regexp_matches(line, '^##\\s+\\d+') THEN CAST(regexp_extract(line, '^##\\s+(\\d+)', 1) AS INT) END AS s FROM f),
g AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 0) AS section, coalesce(lag(tab) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS before FROM t)
SELECT doc_id, CAST(line_no AS INT) AS line_no, section, CAST(row_number() OVER (PARTITION BY doc_id, section ORDER BY line_no) AS INT) AS table_no FROM g WHERE tab AND NOT before"""
)
def numbered_tables(spark, sf_dir):
    """Tables of Markdown-like texts, numbered within their sections."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return text.numbered_tables(lines.withColumn("line", F.when(F.col("line").contains(" | "), F.concat(F.lit("| "), "line")).otherwise(F.col("line"))))


# --- the full feature table ---------------------------------------------------------------------

_CHANNELS, _MCCS = ["AF", "NF", "NO", "RF", "UPC", "UPD", "IPM", "NTD", "FTD", "ATW"], [1, 7, 13, 25, 50]


def _full_sql() -> str:
    of_t = lambda name: SQL[name].replace(TXN_E, TXN_T)
    channels = f"WITH {TXN_T} SELECT account_id, " + ", ".join(
        f"coalesce(round(CAST(sum(CASE WHEN channel = '{k}' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(channel), 0), 6), 0) AS ch_{k}_rate" for k in _CHANNELS
    ) + " FROM txn GROUP BY 1"
    groups = [of_t(n) for n in ("txn_basic_stats", "flow_credit_debit", "channel_entropy")] + [channels] + [of_t(n) for n in ("temporal_rates", "hour_entropy", "velocity_gaps", "structuring_rates", "daily_bursts", "mcc_rates", "mcc_entropy")]
    ref, code = f"TIMESTAMP '{REF}'", lambda c: f"CAST(dense_rank() OVER (ORDER BY coalesce(CAST({c} AS VARCHAR), 'MISSING')) - 1 AS INT) AS {c}_enc"
    account = f"""WITH {BANK_T}, b AS (SELECT *, list_filter([avg_balance, monthly_avg_balance, quarterly_avg_balance, daily_avg_balance], lambda x: x IS NOT NULL) AS l FROM accounts)
SELECT account_id, {', '.join(f'round({x}, 6) AS {x}' for x in features.BALANCES)}, num_chequebooks, {days(ref, 'account_opening_date')} AS acct_age_days, round({days(ref, 'account_opening_date')} / 30.44, 6) AS acct_age_months,
  CAST(freeze_date IS NOT NULL AS INT) AS was_frozen, CAST(unfreeze_date IS NOT NULL AS INT) AS was_unfrozen, CAST(last_mobile_update_date IS NOT NULL AS INT) AS had_mobile_update,
  {days(ref, 'last_mobile_update_date')} AS days_since_mobile_update, {days(ref, 'last_kyc_date')} AS days_since_kyc, {days('unfreeze_date', 'freeze_date')} AS frozen_duration,
  {', '.join(code(c) for c in features.ENCODED_ACCOUNT)}, round(list_max(l) - list_min(l), 6) AS balance_range, round(CASE WHEN len(l) > 1 THEN list_aggregate(l, 'stddev_samp') END, 6) AS balance_std, product_code, currency_code FROM b"""
    score = lambda cols: " + ".join(f"CAST(coalesce({c} = 'Y', false) AS INT)" for c in cols)
    held = [f"{p}_{x}" for p in features.PRODUCTS for x in ("sum", "count")]
    customer = f"""WITH {BANK_T}, c AS (SELECT customer_id, round({days(ref, 'date_of_birth')} / 365.25, 6) AS age, round({days(ref, 'relationship_start_date')} / 365.25, 6) AS rel_years,
  CAST(coalesce(customer_pin <> permanent_pin, true) AS INT) AS pin_mismatch, {', '.join(code(c) for c in features.KYC + features.DIGITAL)}, {score(features.KYC)} AS kyc_score, {score(features.DIGITAL)} AS digital_score FROM customers)
SELECT account_id, c.* EXCLUDE (customer_id), n.n_accounts_customer, {', '.join(f'products.{h}' for h in held)} FROM linkage LEFT JOIN c USING (customer_id)
  LEFT JOIN (SELECT customer_id, count(*) AS n_accounts_customer FROM linkage GROUP BY 1) n USING (customer_id) LEFT JOIN products USING (customer_id)"""
    out = f"SELECT * FROM ({groups[0]}) g0"
    for i, g in enumerate([*groups[1:], account, customer, SQL["derived_ratios"]], 1):
        out += f" LEFT JOIN ({g}) g{i} USING (account_id)"
    return f"SELECT * REPLACE (coalesce(channel_entropy, 0) AS channel_entropy, coalesce(n_channels_used, 0) AS n_channels_used, coalesce(mcc_entropy, 0) AS mcc_entropy, coalesce(hour_entropy, 0) AS hour_entropy) FROM ({out})"


@query(_full_sql())
def feature_table(spark, sf_dir):
    """All 122 features of every account with a transaction."""
    t = bank_t(spark, sf_dir)
    out = features.build(t["transactions"], t["accounts"], t["customers"], t["products"], t["linkage"], REF, channels=_CHANNELS, mccs=_MCCS)
    return rounded(out, *[f.name for f in out.schema.fields if f.dataType.simpleString() == "double" and f.name not in ("total_amount", "mean_amount", "max_amount", "min_amount", "credit_mean", "debit_mean")])


@query()
def leakage_comparison(spark, sf_dir):
    """AUC out of fold with the features that a freeze gives away, and without them."""
    base = _numeric(spark, sf_dir)
    a = features.account_attributes(accounts_t(spark, sf_dir), REF).select("account_id", "was_frozen", "was_unfrozen", "frozen_duration")
    df = base.join(features.matrix(a, ["was_frozen", "was_unfrozen", "frozen_duration"]), "account_id")
    rows = []
    for name, cols in (("all", [*_FEATURES, "was_frozen", "was_unfrozen", "frozen_duration"]), ("leakage_free", _FEATURES)):
        scores, _ = models.cross_validated(df, "account_id", "is_mule", cols, kinds=("boosted",))
        rows.append((name, len(cols), float(stats.roc_auc(scores, "score_boosted", "is_mule").first().auc)))
    return spark.createDataFrame(rows, "features string, n_features int, auc double")


# --- leaf-wise boosting on all features, and its attributions -------------------------------------

#: As in the account-risk model but for the end of boosting: 5 rounds without a better AUC instead of 50.
_BOOSTING = boosting.Params(patience=5)


def _all_features(spark, sf_dir):
    """(table, names): the 122 features as numbers, label and fold of every account with a transaction, written once."""
    t = bank_t(spark, sf_dir)
    wide = features.build(t["transactions"], t["accounts"], t["customers"], t["products"], t["linkage"], REF, channels=_CHANNELS, mccs=_MCCS)
    names = [c for c in wide.columns if c != "account_id"]
    y = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("is_mule"))
    tables = Tables(spark)
    rows = tables.keep(features.matrix(wide, names).join(y, "account_id"), "features")
    return models.stratified_folds(rows, "account_id", "is_mule"), names


@query()
def leafwise_scores(spark, sf_dir):
    """Out-of-fold scores of leaf-wise boosting on the 122 features, five folds in the same passes."""
    df, names = _all_features(spark, sf_dir)
    df = Tables(spark).keep(df, "folds")
    return boosting.score(df, "account_id", boosting.train(df, "account_id", "is_mule", names, params=_BOOSTING))


@query()
def leafwise_importance(spark, sf_dir):
    """Summed split gain of every feature, mean over the models of all folds."""
    df, names = _all_features(spark, sf_dir)
    gains = boosting.importance(boosting.train(Tables(spark).keep(df, "folds"), "account_id", "is_mule", names, params=_BOOSTING))
    return spark.createDataFrame(sorted(gains.items()), "feature string, gain double")


@query()
def shapley_values(spark, sf_dir):
    """Exact Shapley values of every account's margin: 12 rounds on all labelled rows, explained row by row."""
    df, names = _all_features(spark, sf_dir)
    df = Tables(spark).keep(df.withColumn("fold", F.lit(0)), "rows")
    model = boosting.train(df, "account_id", "is_mule", names, k=1, params=boosting.Params(rounds=12, patience=12))[0]
    return boosting.attributions(df, "account_id", model)


# --- what was known at each row's own time --------------------------------------------------------


@query(
    """WITH r AS (SELECT user_id, ts, event_id, value, count(*) OVER w AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS total FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT l.event_id, l.user_id, CAST(r.ts AS VARCHAR) AS last_ts, r.event_id AS last_event, r.value AS last_value, coalesce(r.n, 0) AS n_before, r.total AS total_before, round((epoch_us(l.ts) - epoch_us(r.ts)) / 3.6e9, 6) AS hours_since
FROM (SELECT * FROM events WHERE event_type = 'purchase') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts"""
)
def asof_features(spark, sf_dir):
    """Each purchase with the user's last click, and the clicks so far, as they were at its own time."""
    e = read(spark, sf_dir, "events")
    clicks = e.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("last_event"), F.col("value").alias("last_value"), "value")
    bought = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    got = ordered.as_of(bought, clicks, "user_id", "ts", ["last_event", "last_value"], {"total_before": "value"})
    hours = F.round(X.hours_between(F.col("ts"), F.col("last_ts")), 6)
    return got.withColumn("hours_since", hours).withColumn("last_ts", F.regexp_replace(F.col("last_ts").cast("string"), r"(\\.\\d*?)0+$", "$1")).drop("ts")


@query(
    """SELECT a.o_orderkey, CAST(CAST(max(b.o_orderdate) AS DATE) AS VARCHAR) AS last_day, count(b.o_orderkey) AS n_before, CAST(sum(CAST(b.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_before
FROM orders a LEFT JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderdate < a.o_orderdate GROUP BY a.o_orderkey"""
)
def asof_order_history(spark, sf_dir):
    """Each order with its customer's orders strictly before it."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    got = ordered.as_of(o.drop("o_totalprice"), o, "o_custkey", "o_orderdate", [], {"total_before": "o_totalprice"}, strictly=True)
    return dated(got.withColumnRenamed("last_ts", "last_day"), "last_day").select("o_orderkey", "last_day", "n_before", "total_before")


# --- state that merges ----------------------------------------------------------------------------


@query(f"WITH {TXN_T} SELECT account_id, count(*) AS n, {_SUM} AS total, true AS partners_within, true AS median_within FROM txn GROUP BY 1")
def mergeable_state(spark, sf_dir):
    """States of ten parts of the transactions, merged: exact counts and totals, and whether the sketches keep their
    stated errors (four standard errors of the distinct count; twice the rank error of the median)."""
    t = txn_t(spark, sf_dir)
    part = F.pmod(F.xxhash64("transaction_id"), F.lit(10))
    state = sketches.state(t.filter(part == 0))
    for i in range(1, 10):
        state = state.unionByName(sketches.state(t.filter(part == i)))
    got = sketches.features(sketches.merged(state))
    partners = t.select("account_id", "counterparty_id").filter("counterparty_id is not null").distinct().groupBy("account_id").agg(F.count(F.lit(1)).alias("exact"))
    below = t.join(got.select("account_id", "median_amount"), "account_id").groupBy("account_id").agg(
        F.count("amount").alias("m"), F.count_if(F.col("amount") < F.col("median_amount")).alias("lo"), F.count_if(F.col("amount") <= F.col("median_amount")).alias("hi")
    )
    off = 2 * sketches.rank_error() * F.col("m") + 1
    return got.join(partners, "account_id", "left").join(below, "account_id").select(
        "account_id", "n", "total", (F.abs(F.col("n_partners") - F.coalesce("exact", F.lit(0))) <= 4 * sketches.distinct_error() * F.coalesce("exact", F.lit(0)) + 0.5).alias("partners_within"),
        ((F.col("lo") <= F.col("m") / 2 + off) & (F.col("hi") >= F.col("m") / 2 - off)).alias("median_within"),
    )


# --- files with bad rows --------------------------------------------------------------------------


@query(
    """WITH o AS (SELECT *, CASE o_orderkey % 11 WHEN 3 THEN 'columns' WHEN 5 THEN 'columns' WHEN 7 THEN 'time' ELSE 'good' END AS reason FROM orders)
SELECT reason, count(*) AS n, CASE WHEN reason = 'good' THEN CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) END AS total, CASE WHEN reason = 'good' THEN CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) END AS last_day FROM o GROUP BY 1"""
)
def csv_quarantine(spark, sf_dir):
    """Orders written as CSV, some with a price that is no number, a column too many or a date that is none, and read back."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey") % 11
    fields = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
    texts = [F.col(c).cast("string") for c in fields]
    texts[2] = F.when(k == 3, "n/a").otherwise(texts[2])
    texts[3] = F.when(k == 7, "soon").when(k == 5, F.concat(texts[3], F.lit(",x"))).otherwise(texts[3])
    base = Tables(spark).folder("orders-csv")
    o.select(F.concat_ws(",", *texts)).write.text(f"{base}/in")
    schema = T.StructType([T.StructField(f, o.schema[f].dataType) for f in fields])
    good, bad = io.checked_csv(spark, f"{base}/in", schema, f"{base}/bad", header=False)
    sums = good.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.max("o_orderdate").cast("date").cast("string").alias("last_day"))
    rest = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return sums.select(F.lit("good").alias("reason"), "n", "total", "last_day").unionByName(rest, allowMissingColumns=True)


@query(
    f"""WITH w AS ({_full_sql()}), d AS (SELECT account_id, CAST(COLUMNS(* EXCLUDE (account_id)) AS DOUBLE) FROM w),
l AS (UNPIVOT d ON COLUMNS(* EXCLUDE (account_id)) INTO NAME f VALUE v)
SELECT a.f AS a, b.f AS b, round(CASE WHEN min(a.v) < max(a.v) AND min(b.v) < max(b.v) THEN corr(a.v, b.v) END, 6) AS corr FROM l a JOIN l b ON a.account_id = b.account_id AND a.f <= b.f GROUP BY 1, 2"""
)
def feature_correlations(spark, sf_dir):
    """All 7,503 pairs of the 122 features."""
    df = Tables(spark).keep(feature_table(spark, sf_dir), "features")
    return rounded(profile.wide_correlations(df, [c for c in df.columns if c != "account_id"]), "corr")
