"""Tests and ranking metrics.  Statistics are exact; only p-values are computed on the driver.

Rank statistics start from counts per distinct value, so windows never run over raw rows.  Their running
sums need one order over all distinct values; ``running`` splits it by ranges whose bounds are read once, so that
no task holds them all and every plan deals alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SAMPLE = 4096  # texts that range bounds are chosen from


def ranges(df: DataFrame, column: str, parts: int | None = None) -> Column:
    """The number, from 0, of the range of values that a row's ``column`` is in; about equally many rows in each.

    The bounds are approximate quantiles, for texts those of the ``SAMPLE`` values of least hash.  They are
    read once (``parts`` values at most; default: one for each shuffle partition, 64 at most) and written into
    the expression, so every plan that uses it deals rows alike, however often it is evaluated.
    """
    parts = parts or max(2, min(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if isinstance(df.schema[column].dataType, StringType):
        least = df.select(column).filter(F.col(column).isNotNull()).orderBy(F.xxhash64(column), column).limit(SAMPLE)
        some = sorted(r[0] for r in least.collect())
        found = [some[i * len(some) // parts] for i in range(1, parts)] if some else []
    else:
        found = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], max(1000, 8 * parts))).first()[0] or []
    bounds = sorted({b for b in found if b == b})  # NaN is above all bounds

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) <= F.lit(bounds[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))

    return place(0, len(bounds))


def running(
    df: DataFrame, by: str, sums: dict[str, str], within: list[str] | None = None, descending: bool = False, parts: int | None = None, whole: dict[str, str] | None = None, at: Column | None = None
) -> DataFrame:
    """Running totals ``sums`` = {new: source} in the order of ``by``, for each group of ``within``.

    ``by`` is not null and has one row per value and group.  Rows are dealt by ranges of it; each range
    sums for itself and adds the total of the ranges before it (``parts`` rows a group at most), so no
    group's order is one task's work.  ``whole`` = {new: source} adds the group's totals.  ``at``: ready
    ranges instead of those of ``df``'s own values.
    """
    keys, whole = within or [], whole or {}
    at = ranges(df, by, parts) if at is None else at
    dealt = df.withColumn("__p", -at if descending else at)
    totals = dealt.groupBy(*keys, "__p").agg(*[F.sum(src).alias(f"__t_{src}") for src in dict.fromkeys([*sums.values(), *whole.values()])])
    group = Window.partitionBy(*keys)
    before = group.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in [*keys, "__p"]], *[F.coalesce(F.sum(f"__t_{src}").over(before), F.lit(0)).alias(f"__o_{new}") for new, src in sums.items()],
        *[F.sum(f"__t_{src}").over(group).alias(new) for new, src in whole.items()],
    )
    up = Window.partitionBy(*keys, "__p").orderBy(F.col(by).desc() if descending else F.col(by))
    same = F.col("__p") == F.col("__k___p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = dealt.withColumns({new: F.sum(src).over(up) for new, src in sums.items()}).join(offs if keys else F.broadcast(offs), same)
    return out.withColumns({new: F.col(new) + F.col(f"__o_{new}") for new in sums}).drop("__p", "__k___p", *[f"__k_{k}" for k in keys], *[f"__o_{new}" for new in sums])


HOT = 1_000_000  # rows of a group from which its quantiles are spread over all tasks


def quantiles(df: DataFrame, value: str, probs: dict[str, float], within: list[str], hot: int = HOT) -> DataFrame:
    """(within..., a column per name of ``probs``): exact, linearly interpolated quantiles of each group.

    A group of ``hot`` rows or fewer is sorted in one buffer of that size at most; larger ones, of which there
    are few (the table's rows / ``hot``), go through counts per distinct value and running sums by range, so
    that a group with most of the rows is no single task's.  Both ways are exact.  Nulls do not count; a group
    of nulls alone gives no row.
    """
    rows = df.select(*within, F.col(value).alias("v")).filter(F.col("v").isNotNull())
    large = rows.groupBy(*[F.col(k).alias(f"__w_{k}") for k in within]).count().filter(F.col("count") > hot)
    n = large.agg(F.sum("count")).first()[0]
    large = F.broadcast(large.drop("count"))  # rows / hot rows; by a shuffle each large group would be one task's
    small, parts = rows, []
    if n:
        same = F.lit(True)
        for k in within:
            same &= F.col(k).eqNullSafe(F.col(f"__w_{k}"))
        parts.append(_spread_quantiles(rows.join(large, same, "left_semi"), probs, within, n))
        small = rows.join(large, same, "left_anti")
    q = small.groupBy(*within).agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in probs.values()])).alias("q"))
    out = q.select(*within, *[F.get("q", F.lit(i)).alias(k) for i, k in enumerate(probs)])
    return out.unionByName(parts[0]) if parts else out


RANGE = 1 << 20  # rows of a range of values, up to RANGES of them
RANGES = 512


def _spread_quantiles(rows: DataFrame, probs: dict[str, float], within: list[str], n: int) -> DataFrame:
    """``n``: how many rows there are; ranges grow in number with them, not in size."""
    counts = rows.groupBy(*within, "v").agg(F.count(F.lit(1)).alias("__c"))
    parts = min(RANGES, -(-n // RANGE))
    at = ranges(rows, "v", parts if parts > 64 else None)
    cum = running(counts, "v", {"__upto": "__c"}, within, whole={"__n": "__c"}, at=at)
    place = {k: F.lit(p) * (F.col("__n") - 1) for k, p in probs.items()}
    least = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col("v")))  # noqa: E731 - the value at a rank from 0
    g = cum.groupBy(*within).agg(F.first("__n").alias("__n"), *[least(f(x)).alias(f"__{side}_{k}") for k, x in place.items() for side, f in (("lo", F.floor), ("hi", F.ceil))])
    part = {k: x - F.floor(x) for k, x in place.items()}
    mixed = {k: F.when(part[k] == 0, F.col(f"__lo_{k}")).otherwise((1 - part[k]) * F.col(f"__lo_{k}") + part[k] * F.col(f"__hi_{k}")) for k in probs}
    return g.select(*within, *[c.cast("double").alias(k) for k, c in mixed.items()])


def class_counts(df: DataFrame, value: str, label: str) -> DataFrame:
    """(v, n1, n0) per distinct non-null value."""
    v, y = F.col(value), F.col(label)
    return df.filter(v.isNotNull()).groupBy(v.alias("v")).agg(F.count_if(y == 1).alias("n1"), F.count_if(y == 0).alias("n0"))


def mann_whitney(df: DataFrame, value: str, label: str) -> DataFrame:
    """(n1, n0, u1, tie_term, effect, rank_biserial): U of class 1, average ranks.

    ``effect`` is U / (n1 n0), the chance that a positive outranks a negative; rank-biserial is 2 effect - 1.
    """
    c = running(class_counts(df, value, label), "v", {"below": "n0", "upto": "n1"})  # both counts, so that the totals read the same exchange
    n = F.col("n1") + F.col("n0")
    g = c.agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"),
        F.sum(F.col("n1") * (2 * F.col("below") - F.col("n0"))).alias("twice_u"), F.sum((n * n * n - n).cast("decimal(38,0)")).cast("double").alias("tie_term"),
    )
    u = F.col("twice_u") / 2
    effect = F.try_divide(u, (F.col("n1") * F.col("n0")).cast("double"))
    return g.select("n1", "n0", u.alias("u1"), "tie_term", effect.alias("effect"), (2 * effect - 1).alias("rank_biserial"))


def mann_whitney_p(n1: int, n0: int, u: float, tie_term: float) -> float:
    """Two-sided normal p-value with tie and continuity corrections."""
    n = n1 + n0
    var = n1 * n0 / 12 * (n + 1 - tie_term / (n * (n - 1))) if n > 1 else 0.0
    if var <= 0:
        return 1.0
    z = (abs(u - n1 * n0 / 2) - 0.5) / math.sqrt(var)
    return min(1.0, math.erfc(max(z, 0.0) / math.sqrt(2)))


def ks(df: DataFrame, value: str, label: str) -> DataFrame:
    """(n1, n0, ks): largest distance of the classes' distribution functions."""
    c = running(class_counts(df, value, label), "v", {"c1": "n1", "c0": "n0"}, whole={"t1": "n1", "t0": "n0"})
    d = F.abs(F.try_divide(F.col("c1"), F.col("t1")) - F.try_divide(F.col("c0"), F.col("t0")))
    return c.agg(F.first("t1").alias("n1"), F.first("t0").alias("n0"), F.max(d).alias("ks"))


def ks_p(n1: int, n0: int, d: float) -> float:
    """Asymptotic two-sided p-value."""
    x = d * math.sqrt(n1 * n0 / (n1 + n0))
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def _contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _margins(cells: DataFrame) -> DataFrame:
    """The occupied cells with their row's and column's totals and the table's size."""
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    size = F.broadcast(rows.agg(F.sum("ra").alias("t"), F.count(F.lit(1)).alias("na")).crossJoin(cols.agg(F.count(F.lit(1)).alias("nb"))))  # one row
    return cells.join(rows, "a").join(cols, "b").crossJoin(size)


def chi_square(df: DataFrame, a: str, b: str, total: int | None = None) -> DataFrame:
    """(chi2, dof, n, cramers_v) of a contingency table without nulls; Yates' correction for 2 x 2.

    From occupied cells alone: chi2 = t (sum of n^2 / (row total * column total) - 1).  A 2 x 2 table's four
    cells all lie equally far from their expected counts, so |n - e| of one cell gives the correction.
    ``total``: divide V by this instead of the table's total.
    """
    n, e, d = F.col("n"), F.col("ra").cast("double") * F.col("cb") / F.col("t"), lambda c: F.col(c).cast("double")
    off = F.max(F.abs(n - e))
    g = _margins(_contingency(df, a, b)).agg(
        F.sum((n - e) * (n - e) / e).alias("seen"), F.sum(e).alias("covered"), off.alias("off"), F.first("t").alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"),
        F.first(d("ra") * (d("t") - d("ra")) / d("t") * d("cb") * (d("t") - d("cb"))).alias("spread"),
    )
    # An empty cell adds its expected count; all expected counts sum to the table's size.
    plain = F.col("seen") + (F.col("n") - F.col("covered"))
    corrected = F.col("off") - F.least(F.lit(0.5), F.col("off"))
    # 2 x 2: sum of off^2 / e over the four cells is off^2 t^3 / (r1 r2 c1 c2).
    yates = F.try_divide(corrected * corrected * d("n") * d("n"), F.col("spread"))
    chi2 = F.when((F.col("na") == 2) & (F.col("nb") == 2), yates).otherwise(F.greatest(plain, F.lit(0.0)))
    g = g.select(chi2.alias("chi2"), "n", "na", "nb")
    least = F.least(F.col("na"), F.col("nb")) - 1
    base = F.lit(total) if total else F.col("n")
    v = F.when(least > 0, F.sqrt(F.col("chi2") / (base * least)))
    return g.select("chi2", ((F.col("na") - 1) * (F.col("nb") - 1)).alias("dof"), "n", v.alias("cramers_v"))


def expected_counts(df: DataFrame, a: str, b: str, block: int = 1024) -> DataFrame:
    """(a, b, n, expected) for every row value with every column value, empty cells too.

    The table is as large as its result, row values times column values.  Column values are dealt into blocks of about
    ``block``, and each row value is sent once to every block, so no list of all of them is in one row or task.
    """
    cells = _contingency(df, a, b)
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("ra")), cells.groupBy("b").agg(F.sum("n").alias("cb"))
    blocks = -(-cols.count() // block) or 1
    total = cells.agg(F.sum("n")).first()[0] or 0
    dealt = cols.groupBy(F.pmod(F.xxhash64("b"), F.lit(blocks)).alias("k")).agg(F.collect_list(F.struct("b", "cb")).alias("l"))
    sent = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    grid = sent.join(dealt, "k").select("a", "ra", F.explode("l").alias("c")).select("a", "ra", F.col("c.b").alias("b"), F.col("c.cb").alias("cb"))
    out = grid.join(cells, ["a", "b"], "left")
    return out.select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), (F.col("ra").cast("double") * F.col("cb") / F.lit(total)).alias("expected"))


def chi_square_p(chi2: float, dof: int) -> float:
    """Upper tail of chi-squared: the regularised upper incomplete gamma function."""
    a, x = dof / 2, chi2 / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def bonferroni(p: Column, m) -> Column:
    return F.least(F.lit(1.0), p * m)


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(n1, n0, auc) = U / (n1 n0)"""
    return mann_whitney(df, score, label).select("n1", "n0", F.col("effect").alias("auc"))


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr): calling positive what scores at least ``threshold``."""
    c = running(class_counts(df, score, label), "v", {"tp": "n1", "fp": "n0"}, descending=True, whole={"t1": "n1", "t0": "n0"})
    return c.select(F.col("v").alias("threshold"), "tp", "fp", F.try_divide(F.col("tp"), F.col("t1")).alias("tpr"), F.try_divide(F.col("fp"), F.col("t0")).alias("fpr"))


def pr_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, tp, fp, precision, recall): calling positive what scores at least ``threshold``."""
    c = running(class_counts(df, score, label), "v", {"tp": "n1", "fp": "n0"}, descending=True, whole={"t1": "n1"})
    return c.select(F.col("v").alias("threshold"), "tp", "fp", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), F.try_divide(F.col("tp"), F.col("t1")).alias("recall"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """(n1, ap): sum of precision weighted by the recall it adds."""
    c = running(class_counts(df, score, label), "v", {"tp": "n1", "fp": "n0"}, descending=True, whole={"t1": "n1"})
    return c.agg(F.first("t1").alias("n1"), F.sum(F.try_divide(F.col("n1"), F.col("t1")) * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).alias("ap"))


def threshold_counts(df: DataFrame, score: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n_above): one pass."""
    g = df.agg(*[F.count_if(F.col(score) > t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("n_above")) for i, t in enumerate(thresholds)])
    return g.select(F.explode(rows).alias("p")).select("p.*")


def auc_by(df: DataFrame, score: str, label: str, group: str) -> DataFrame:
    """(group, auc) of every group in one pass: pairs of a positive and a negative ranked right, ties half; null without one."""
    v, y = F.col(score), F.col(label)
    counts = df.filter(v.isNotNull() & y.isNotNull()).groupBy(group, v.alias("v")).agg(F.count_if(y == 1).alias("n1"), F.count_if(y == 0).alias("n0"))
    below = running(counts, "v", {"upto": "n0"}, [group])
    g = below.groupBy(group).agg(F.sum(F.col("n1") * (2 * F.col("upto") - F.col("n0"))).alias("u"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    return g.select(group, F.try_divide(F.col("u"), 2 * F.col("n1") * F.col("n0")).alias("auc"))


def fold_summary(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
