"""Column helpers.  They keep the null rules that a dataframe library with NaN has and SQL has not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def clip_lower(x: Column, low: float) -> Column:
    """max(x, low), null staying null (bare ``greatest`` would turn null into ``low``)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def guarded_ratio(a: Column, b: Column, low: float) -> Column:
    """a / max(b, low); null where either is null."""
    return F.try_divide(a.cast("double"), clip_lower(b.cast("double"), low))


def flag(cond: Column) -> Column:
    """1 where cond holds, 0 where it does not or is null."""
    return F.when(cond, 1).otherwise(0)


def share(cond: Column) -> Column:
    """Share of rows where cond holds; null counts as not holding and stays in the denominator."""
    return F.try_divide(F.sum(flag(cond)).cast("double"), F.count(F.lit(1)))


def equals(a: Column, value) -> Column:
    return F.coalesce(a == value, F.lit(False))


def differs(a: Column, b: Column) -> Column:
    """a != b, true where either is null."""
    return F.coalesce(a != b, F.lit(True))


def money(x: Column) -> Column:
    """Exact cents: sums do not depend on the order of rows."""
    return x.cast("decimal(18,2)")


def exact_sum(x: Column) -> Column:
    return F.sum(money(x)).cast("double")


def exact_mean(x: Column) -> Column:
    return F.try_divide(exact_sum(x), F.count(x))


def between_us(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later)


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days, rounded down also below zero (-2 hours is -1 day)."""
    return F.floor(between_us(later, earlier) / F.lit(float(DAY_US))).cast("long")


def hours_between(later: Column, earlier: Column) -> Column:
    return between_us(later, earlier) / F.lit(float(HOUR_US))


def years_between(later: Column, earlier: Column) -> Column:
    return floor_days(later, earlier) / F.lit(365.25)


def months_between(later: Column, earlier: Column) -> Column:
    return floor_days(later, earlier) / F.lit(30.44)


def row_std(*cols: Column) -> Column:
    """Sample deviation over the non-null values of a row; null for fewer than two."""
    x = F.filter(F.array(*[c.cast("double") for c in cols]), lambda v: v.isNotNull() & ~F.isnan(v))
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
    return F.when(n > 1, F.sqrt(F.aggregate(F.transform(x, lambda v: v - mean), F.lit(0.0), lambda a, d: a + d * d) / (n - 1)))


def widest(*cols: Column) -> Column:
    """Largest less smallest of a row's non-null values."""
    clean = [F.nanvl(c.cast("double"), F.lit(None).cast("double")) for c in cols]
    return F.greatest(*clean) - F.least(*clean)


def in_band(x: Column, low: float, high: float) -> Column:
    """low <= x < high"""
    return (x >= low) & (x < high)


def multiple_of(x: Column, k: int) -> Column:
    return x % k == 0


def r6(x: Column) -> Column:
    return F.round(x.cast("double"), 6)
