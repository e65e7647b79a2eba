"""Daily series per account, trailing sums, peaks, and the window of suspicious activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

KEY, TS, AMT = "account_id", "transaction_timestamp", "amount"


def daily(txn: DataFrame) -> DataFrame:
    """(account, day, n, amount) of active days."""
    return txn.groupBy(KEY, F.to_date(TS).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(X.money(F.col(AMT))), F.lit(0).cast("decimal(28,2)")).cast("decimal(28,2)").alias("amount"))


def dense_daily(txn: DataFrame) -> DataFrame:
    """The same with a zero row for every day between an account's first and last one."""
    d = daily(txn)
    days = d.groupBy(KEY).agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(KEY, F.explode(F.sequence("lo", "hi")).alias("day"))
    return days.join(d, [KEY, "day"], "left").select(KEY, "day", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("amount", F.lit(0).cast("decimal(28,2)")).alias("amount"))


def rolling(series: DataFrame, days: int, names: dict[str, str]) -> DataFrame:
    """Trailing sums over ``days`` calendar days of a daily series, dense or not."""
    span = Window.partitionBy(KEY).orderBy(F.unix_date("day")).rangeBetween(-(days - 1), 0)
    return series.withColumns({new: F.sum(src).over(span) for new, src in names.items()})


def peak_day(series: DataFrame, value: str) -> DataFrame:
    """(account, peak, peak_value): the first day of the largest value."""
    best = F.max(F.struct(F.col(value).alias("v"), (-F.unix_date("day")).alias("d")))
    return series.groupBy(KEY).agg(best.alias("b")).select(KEY, F.date_from_unix_date(-F.col("b.d")).alias("peak"), F.col("b.v").alias("peak_value"))


def suspicious_windows(txn: DataFrame, scores: DataFrame | None = None, *, threshold: float = 0.3, roll: int = 30, reach: int = 90, min_txns: int = 5, min_days: int = 3) -> DataFrame:
    """(account, suspicious_start, suspicious_end, peak) for all accounts in one plan.

    The peak is the first day of the largest trailing ``roll``-day count; the window runs from the first to
    the last active day within ``reach`` days of it.  Accounts with fewer than ``min_txns`` transactions or
    ``min_days`` active days get none; with ``scores``, only those scored above ``threshold``.

    A trailing sum first reaches its maximum on an active day, so active days suffice: no calendar is made.
    """
    if scores is not None:
        txn = txn.join(scores.filter(F.col("score") > threshold).select(KEY), KEY, "left_semi")
    own = Window.partitionBy(KEY)
    d = daily(txn).withColumns({"all_n": F.sum("n").over(own), "all_days": F.count(F.lit(1)).over(own)})
    d = d.filter((F.col("all_n") >= min_txns) & (F.col("all_days") >= min_days))
    r = rolling(d, roll, {"r": "n"})
    day = F.unix_date("day")
    r = r.withColumn("best", F.max(F.struct("r", (-day).alias("d"))).over(own)).withColumn("peak", -F.col("best.d"))
    return r.groupBy(KEY, "peak").agg(
        F.min(F.when((day >= F.col("peak") - reach) & (day <= F.col("peak")), F.col("day"))).cast("timestamp_ntz").alias("suspicious_start"),
        F.max(F.when((day >= F.col("peak")) & (day <= F.col("peak") + reach), F.col("day"))).cast("timestamp_ntz").alias("suspicious_end"),
    ).withColumn("peak", F.date_from_unix_date("peak"))


def multi_window(txn: DataFrame, spans: list[int]) -> DataFrame:
    """Counts and totals of the last 30, 90, ... days at each active day."""
    out = daily(txn)
    for s in spans:
        out = rolling(out, s, {f"n_{s}d": "n", f"amount_{s}d": "amount"})
    return out.withColumns({f"amount_{s}d": F.col(f"amount_{s}d").cast("double") for s in spans}).drop("n", "amount")


def point_in_time(txn: DataFrame, as_of: str) -> DataFrame:
    """Features from what was known strictly before ``as_of``, with the last transaction then."""
    known = txn.filter(F.col(TS) < F.lit(as_of).cast("timestamp_ntz"))
    last = F.max(F.struct(F.col(TS).alias("ts"), F.col("transaction_id").alias("id"), F.col("channel").alias("channel")))
    g = known.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_before"), F.coalesce(X.exact_sum(F.col(AMT)), F.lit(0.0)).alias("total_before"), last.alias("l"))
    return g.select(KEY, "n_before", "total_before", F.col("l.ts").alias("last_ts"), F.col("l.channel").alias("last_channel"))


def cusum(series: DataFrame, value: str = "n") -> DataFrame:
    """(account, change_day, cusum): where the running sum of deviations from the mean is largest in size.

    Scaled by the number of days to stay in whole numbers: sum(N * x) - k * total.
    """
    own = Window.partitionBy(KEY)
    up = own.orderBy("day")
    n, total, k = F.count(F.lit(1)).over(own), F.sum(value).over(own), F.row_number().over(up)
    s = series.select(KEY, "day", (F.sum(value).over(up) * n - k * total).alias("s"), n.alias("n"))
    best = F.max(F.struct(F.abs("s").alias("a"), (-F.unix_date("day")).alias("d"), F.col("n").alias("n")))
    g = s.groupBy(KEY).agg(best.alias("b"))
    return g.select(KEY, F.date_from_unix_date(-F.col("b.d")).alias("change_day"), (F.col("b.a") / F.col("b.n")).alias("cusum"))


def after_event(txn: DataFrame, events: DataFrame, days: int = 30) -> DataFrame:
    """(account, n_after, amount_after): activity in the days 0 to ``days`` after each account's event."""
    gap = X.floor_days(F.col(TS), F.col("event_ts"))
    near = txn.join(events, KEY).filter((gap >= 0) & (gap <= days))
    g = near.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_after"), F.coalesce(X.exact_sum(F.col(AMT)), F.lit(0.0)).alias("amount_after"))
    return events.select(KEY).join(g, KEY, "left").select(KEY, F.coalesce("n_after", F.lit(0).cast("long")).alias("n_after"), F.coalesce("amount_after", F.lit(0.0)).alias("amount_after"))
