"""Orders within a key when one key may hold most rows: split by time range, with what earlier ranges leave carried on.

A key of more than ``hot`` rows is dealt into ranges of time, the same for all such keys; any other key is one range.
A range works for itself, and takes up from the ranges before it their last row and their totals: one row per
key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import stats

PART = "__part"


def dealt(df: DataFrame, key: str, ts: str, hot: int = stats.HOT, parts: int | None = None) -> tuple[DataFrame, bool]:
    """(``df`` with the number of each row's range in ``PART``, is any key split?).

    Equal times share a range.  Rows without a key are never split.
    """
    large = df.groupBy(F.col(key).alias("__hot_key")).count().filter((F.col("count") > hot) & F.col("__hot_key").isNotNull()).select("__hot_key")
    if large.isEmpty():
        return df.withColumn(PART, F.lit(0)), False
    since = X.between_us(F.col(ts), F.lit("1970-01-01").cast("timestamp_ntz"))
    rows = df.join(large, F.col(key) == F.col("__hot_key"), "left").withColumn("__us", since)
    at = stats.ranges(rows.filter(F.col("__hot_key").isNotNull()), "__us", parts)
    return rows.withColumn(PART, F.when(F.col("__hot_key").isNotNull(), at).otherwise(0)).drop("__hot_key", "__us"), True


def with_previous_time(df: DataFrame, key: str, ts: str, out: str, hot: int = stats.HOT, parts: int | None = None) -> tuple[DataFrame, bool]:
    """(``df`` with ``out``: the time of the key's row before, null for its first, is any key split?)."""
    rows, split = dealt(df, key, ts, hot, parts)
    before = F.lag(ts).over(Window.partitionBy(key, PART).orderBy(ts))
    if split:
        ends = rows.groupBy(F.col(key).alias("__k"), F.col(PART).alias("__p")).agg(F.max(ts).alias("__last"))
        up = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select("__k", "__p", F.max("__last").over(up).alias("__carried"))
        rows = rows.withColumn(out, before).join(carried, (F.col(key) == F.col("__k")) & (F.col(PART) == F.col("__p")), "left")
        return rows.withColumn(out, F.coalesce(out, "__carried")).drop("__k", "__p", "__carried", PART), True
    return rows.withColumn(out, before).drop(PART), False


def as_of(
    left: DataFrame, right: DataFrame, key: str, ts: str, last: list[str], sums: dict[str, str] | None = None, *,
    right_ts: str | None = None, strictly: bool = False, count: str = "n_before", at: str = "last_ts", hot: int = stats.HOT, parts: int | None = None,
) -> DataFrame:
    """``left`` with what the other table held for its key at each row's own time.

    For every row of ``left``: ``at``, the time of the last row of ``right`` with the same key not after it (with ``strictly``:
    before it), that row's columns ``last``, the ``count`` of such rows and their running totals ``sums`` = {new: column},
    exact to two places.  Keys without such a row get nulls, a count of 0 and null totals.  Of rows of ``right``
    at one time the one with the greatest columns ``last`` is the last.  Rows of ``right`` without a key or
    time are none's; rows of ``left`` without one get nothing.  Repeated rows stay repeated.

    Both tables are put in one order, so each is shuffled once, and nothing is paired; a key with most of the rows
    is split by time.
    """
    sums, right_ts = sums or {}, right_ts or ts
    mine = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    theirs = F.struct(F.col(right_ts).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(last)])
    numbers = [F.col(c).cast("decimal(18,2)").alias(f"s{i}") for i, c in enumerate(sums.values())]
    kept = right.filter(F.col(key).isNotNull() & F.col(right_ts).isNotNull())
    r = kept.select(F.col(key).alias("k"), F.col(right_ts).alias("t"), F.lit(1 if strictly else 0).alias("side"), theirs.alias("r"), *numbers)
    own = left.select(F.col(key).alias("k"), F.col(ts).alias("t"), F.lit(0 if strictly else 1).alias("side"), mine.alias("l"))
    rows, split = dealt(own.unionByName(r, allowMissingColumns=True), "k", "t", hot, parts)
    upto = Window.partitionBy("k", PART).orderBy("t", "side", "r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen: dict[str, Column] = {"__r": F.last("r", ignorenulls=True), "__n": F.count("r"), **{f"__s{i}": F.sum(f"s{i}") for i in range(len(sums))}}
    out = rows.withColumns({c: agg.over(upto) for c, agg in seen.items()}).filter(F.col("l").isNotNull())
    if split:
        whole = rows.groupBy(F.col("k").alias("__k"), F.col(PART).alias("__p")).agg(F.max("r").alias("r"), F.count("r").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(sums))])
        before = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        carried = whole.select("__k", "__p", F.max("r").over(before).alias("__cr"), F.sum("n").over(before).alias("__cn"), *[F.sum(f"s{i}").over(before).alias(f"__c{i}") for i in range(len(sums))])
        out = out.join(carried, (F.col("k") == F.col("__k")) & (F.col(PART) == F.col("__p")), "left")
        both = lambda a, b: F.coalesce(F.col(a) + F.col(b), F.col(a), F.col(b))
        out = out.withColumns({"__r": F.coalesce("__r", "__cr"), "__n": F.col("__n") + F.coalesce("__cn", F.lit(0)), **{f"__s{i}": both(f"__s{i}", f"__c{i}") for i in range(len(sums))}})
    known = F.col("k").isNotNull() & F.col("t").isNotNull()
    new = {at: F.col("__r.t"), **{c: F.col(f"__r.c{i}") for i, c in enumerate(last)}, count: F.col("__n"), **{c: F.col(f"__s{i}").cast("double") for i, c in enumerate(sums)}}
    fallback = {count: F.lit(0).cast("long")}
    return out.select(*[F.col(f"l.`{c}`") for c in left.columns], *[F.when(known, c).otherwise(fallback.get(n, F.lit(None))).alias(n) for n, c in new.items()])
