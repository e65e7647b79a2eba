"""Distributions, contingency tables, class-conditional summaries and the data behind plots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.shared import Tables, importable
from . import stats


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """(value, n, share) including nulls."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("__t"))
    return n.crossJoin(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("__t")).alias("share"))  # one row


def crosstab(df: DataFrame, label: str, category: str) -> DataFrame:
    """(label, category, n, share of the label's rows); null categories do not count."""
    n = df.filter(F.col(category).isNotNull()).groupBy(label, category).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(label)))


QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def class_summary(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label, n, mean, std, min, max, p25, median, p75, p95).

    Two or three classes hold all rows: moments are partial sums, and large classes' quantiles come from ranges of values.
    The two columns are written once, so that what makes ``df`` is not done again, nor held beside the sums, in each pass.
    """
    df = Tables(df.sparkSession).keep(df.select(label, value), "values")
    v = F.col(value)
    g = df.groupBy(label).agg(F.count(v).alias("n"), X.exact_mean(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = stats.quantiles(df, value, QUARTILES, [label]).withColumnRenamed(label, "__label")
    return g.join(q, g[label].eqNullSafe(q["__label"]), "left").drop("__label")


def rate_by_group(df: DataFrame, group: str | Column, label: str, min_support: int = 0, name: str = "grp") -> DataFrame:
    """(grp, n, n_positive, rate) of groups with at least ``min_support`` rows."""
    g = F.col(group) if isinstance(group, str) else group
    out = df.filter(g.isNotNull()).groupBy(g.alias(name)).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("n_positive"))
    return out.filter(F.col("n") >= min_support).withColumn("rate", F.try_divide(F.col("n_positive"), F.col("n")))


def cut(x: Column, edges: list[float]) -> Column:
    """Number of the bin (lo, hi] that x is in, from 0; null outside all."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((x > edges[i]) & (x <= edges[i + 1]), i).otherwise(out)
    return out


def _span(df: DataFrame, value: str) -> DataFrame:
    return F.broadcast(df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")))  # one row


def equal_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``df`` with ``bin``: equal-width bins, closed on the right, the least value in the first one."""
    v = F.col(value)
    at = F.ceil((v - F.col("__lo")) / ((F.col("__hi") - F.col("__lo")) / bins)).cast("int") - 1
    inside = df.crossJoin(_span(df, value))
    return inside.withColumn("bin", F.when(v.isNotNull(), F.when(F.col("__hi") == F.col("__lo"), 0).otherwise(F.greatest(F.lit(0), F.least(at, F.lit(bins - 1)))))).drop("__lo", "__hi")


def histogram(df: DataFrame, value: str, bins: int, label: str | None = None) -> DataFrame:
    """([label,] bin, n, density): bins over the whole range, closed on the left, the last one on both sides."""
    v = F.col(value)
    rows = df.filter(v.isNotNull()).crossJoin(_span(df, value)).withColumn("__w", (F.col("__hi") - F.col("__lo")) / bins)
    rows = rows.withColumn("bin", F.when(F.col("__w") == 0, 0).otherwise(F.least(F.floor((v - F.col("__lo")) / F.col("__w")).cast("int"), F.lit(bins - 1))))
    keys = [label] if label else []
    n = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.first("__w").alias("__w"))
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else F.sum("n").over(Window.partitionBy())
    return n.withColumn("density", F.try_divide(F.col("n"), total * F.col("__w"))).drop("__w")


SALTS = 16


def box_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, and the furthest values within 1.5 interquartile ranges of them."""
    v = F.col("v")
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("__c"))
    q = stats.quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [group])
    r = 1.5 * (F.col("q3") - F.col("q1"))
    # A group's distinct values meet its quartiles in SALTS tasks, as one group may hold most of the rows.
    q = q.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    j = counts.withColumn("__salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(q, [group, "__salt"])
    return j.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(v >= F.col("q1") - r, v)).alias("low_whisker"), F.max(F.when(v <= F.col("q3") + r, v)).alias("high_whisker"),
        F.coalesce(F.sum(F.when((v < F.col("q1") - r) | (v > F.col("q3") + r), F.col("__c"))), F.lit(0)).alias("n_outliers"),
    )


def empirical_cdf(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, value, cdf): share of a group's values at most this one, per distinct value.

    Counts per value come first, and running sums go range by range, so no group is one task's work.
    """
    n = df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = stats.running(n, "v", {"__c": "n"}, [group], whole={"__t": "n"})
    return upto.select(group, F.col("v").alias(value), (F.col("__c") / F.col("__t")).alias("cdf"))


def period_volume(df: DataFrame, ts: str, unit: str, label: str) -> DataFrame:
    """(period, label, n, relative): counts per period, and relative to the label's busiest one."""
    n = df.groupBy(F.date_trunc(unit, F.col(ts)).cast("date").alias("period"), label).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("relative", F.col("n") / F.max("n").over(Window.partitionBy(label)))


def share_difference(df: DataFrame, category: str, label: str, top: int | None = None) -> DataFrame:
    """(category, share_1, share_0, diff) by descending difference of the classes' shares."""
    known = df.filter(F.col(category).isNotNull())
    n = known.groupBy(category).agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
    t = F.broadcast(n.agg(F.sum("n1").alias("t1"), F.sum("n0").alias("t0")))
    out = n.crossJoin(t).select(category, F.try_divide(F.col("n1"), F.col("t1")).alias("share_1"), F.try_divide(F.col("n0"), F.col("t0")).alias("share_0"))
    out = out.withColumn("diff", F.col("share_1") - F.col("share_0"))
    return out.orderBy(F.round("diff", 9).desc(), category).limit(top) if top else out


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for every pair, pairwise complete, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double"))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("p")).select("p.*")


def wide_correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) for every pair of many columns, pairwise complete, by blocked cross products.

    Tasks multiply matrices of their rows: values less the column's mean, 0 where there is none, and where there is one.
    Sums meet by pair, so a plan has four products and no expression per pair.  NaN counts as missing; a constant column
    has null correlations.  Pairs are ordered by name; each column also stands with itself.  The driver gets the
    means only.
    """
    importable(df.sparkSession)
    columns, d = sorted(columns), len(columns)
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    x = df.select(F.array(*[value(c) for c in columns]).alias("x"))
    mean = np.array([m or 0.0 for m in df.agg(*[F.avg(value(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()])

    def run(batches):
        sums = np.zeros((5, d, d))
        for rb in batches:
            m = rb.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d) - mean
            here = ~np.isnan(m)
            m, here = np.where(here, m, 0.0), here.astype(np.float64)
            one, square = m.T @ here, (m * m).T @ here
            sums += [here.T @ here, one, one.T, m.T @ m, square]
        both = np.stack([*sums, sums[4].T], axis=2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), *(pa.array(both[:, :, k].tolist(), pa.list_(pa.float64())) for k in range(6))], names=["i", "n", "sx", "sy", "sxy", "sxx", "syy"]
        )

    names = ["n", "sx", "sy", "sxy", "sxx", "syy"]
    parts = x.mapInArrow(run, "i int, " + ", ".join(f"{k} array<double>" for k in names))
    pairs = parts.select("i", F.posexplode(F.arrays_zip(*names)).alias("j", "s")).filter("i <= j").groupBy("i", "j").agg(*[F.sum(f"s.{k}").alias(k) for k in names])
    n, sx, sy, sxy, sxx, syy = (F.col(k) for k in names)
    spread = lambda s2, s1: F.when(n * s2 - s1 * s1 > 1e-12 * n * s2, n * s2 - s1 * s1)
    name = F.array(*[F.lit(c) for c in columns])
    return pairs.select(F.get(name, F.col("i")).alias("a"), F.get(name, F.col("j")).alias("b"), ((n * sxy - sx * sy) / F.sqrt(spread(sxx, sx)) / F.sqrt(spread(syy, sy))).alias("corr"))


def strongest_pair(pairs: DataFrame, limit: float = 0.7) -> DataFrame:
    """(a, b, corr, too_close): of ``correlations``, the pair of different columns with the largest one."""
    own = pairs.filter("a <> b").orderBy(F.abs("corr").desc(), "a", "b").limit(1)
    return own.withColumn("too_close", (F.abs("corr") >= limit).cast("int"))


def flag_prevalence(df: DataFrame, flags: list[str], label: str) -> DataFrame:
    """(flag, rate_1, rate_0, diff): how often each Y/N flag is Y by class; null is not Y."""
    g = df.agg(*[F.struct(*[F.try_divide(F.sum(X.flag((F.col(label) == y) & X.equals(F.col(f), "Y"))).cast("double"), F.count_if(F.col(label) == y)).alias(f"r{y}") for y in (1, 0)]).alias(f) for f in flags])
    rows = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"{f}.r1").alias("rate_1"), F.col(f"{f}.r0").alias("rate_0")) for f in flags])
    return g.select(F.explode(rows).alias("p")).select("p.*").withColumn("diff", F.col("rate_1") - F.col("rate_0"))
