"""Integrity and quality checks, each a small DataFrame of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X


def shape(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows, n_cols)"""
    parts = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows", F.lit(len(t.columns)).cast("long").alias("n_cols")) for n, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _unpivot(df: DataFrame, names: list[str], label: str, value: str, keep: list[str] | None = None) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), F.col(f"`{n}`").alias("v")) for n in names])
    return df.select(*(keep or []), F.explode(pairs).alias("__p")).select(*(keep or []), F.col("__p.k").alias(label), F.col("__p.v").alias(value))


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, n_null, pct_null) in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return _unpivot(counts, df.columns, "column_name", "n_null", ["__n"]).select("column_name", "n_null", (100.0 * F.try_divide(F.col("n_null"), F.col("__n"))).alias("pct_null"))


def missing_by_class(df: DataFrame, label: str) -> DataFrame:
    """(label, column_name, missing_rate): every other column, one pass."""
    cols = [c for c in df.columns if c != label]
    rates = df.groupBy(label).agg(*[X.share(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    return _unpivot(rates, cols, "column_name", "missing_rate", [label])


def leakage_audit(df: DataFrame, label: str) -> DataFrame:
    """(column_name, n_positive, n_negative, leaks): columns filled in for positives only."""
    cols = [c for c in df.columns if c != label]
    pos = df.agg(*[F.struct(F.count_if(F.col(f"`{c}`").isNotNull() & (F.col(label) == 1)).alias("p"), F.count_if(F.col(f"`{c}`").isNotNull() & (F.col(label) == 0)).alias("n")).alias(c) for c in cols])
    out = _unpivot(pos, cols, "column_name", "v")
    return out.select("column_name", F.col("v.p").alias("n_positive"), F.col("v.n").alias("n_negative"), ((F.col("v.p") > 0) & (F.col("v.n") == 0)).cast("int").alias("leaks"))


def dtype_histogram(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(dtype, n_columns), from the schema alone."""
    kinds = [t for _, t in df.dtypes]
    return spark.createDataFrame(sorted((k, kinds.count(k)) for k in set(kinds)), "dtype string, n_columns long")


def duplicate_count(df: DataFrame, *keys: str) -> DataFrame:
    """(n_rows, n_distinct, n_duplicates) of a key, by two plain aggregations."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_distinct"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Keys of ``child`` that ``parent`` lacks."""
    return child.join(parent.select(F.col(parent_key).alias("__p")), F.col(child_key) == F.col("__p"), "left_anti").select(child_key).distinct()


def all_members(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """(n_missing, all_present)"""
    return orphans(child, parent, child_key, parent_key).agg(F.count(F.lit(1)).alias("n_missing")).withColumn("all_present", (F.col("n_missing") == 0).cast("int"))


def sign_profile(df: DataFrame, amount: str) -> DataFrame:
    a = F.col(amount)
    g = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(a < 0).alias("n_negative"), F.count_if(a == 0).alias("n_zero"), F.coalesce(X.exact_sum(F.when(a < 0, -a)), F.lit(0.0)).alias("reversed_amount"), F.coalesce(X.exact_sum(F.when(a > 0, a)), F.lit(0.0)).alias("positive_amount"))
    return g.withColumns({"negative_share": F.try_divide(F.col("n_negative"), F.col("n_rows")), "reversal_amount_ratio": F.try_divide(F.col("reversed_amount"), F.col("positive_amount"))})


def coverage(left: DataFrame, right: DataFrame, key: str, present: str) -> DataFrame:
    """(n_rows, n_matched, coverage) of a left join."""
    j = left.join(right, key, "left")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count(present).alias("n_matched")).withColumn("coverage", F.try_divide(F.col("n_matched"), F.col("n_rows")))


def pin_checks(df: DataFrame) -> DataFrame:
    """Mismatch of state (2 digits) and district (3 digits) between a customer's, its permanent and its branch's code.

    The composite is the mean of the four comparisons that can be made; null where none can.
    """
    c = F.col
    lead = lambda x, n: F.floor(c(x) / n).cast("long")
    pairs = {
        "state_branch": (lead("customer_pin", 10000), lead("branch_pin", 10000)), "district_branch": (lead("customer_pin", 1000), lead("branch_pin", 1000)),
        "state_permanent": (lead("customer_pin", 10000), lead("permanent_pin", 10000)), "district_permanent": (lead("customer_pin", 1000), lead("permanent_pin", 1000)),
    }
    out = df.withColumns({f"{k}_mismatch": (a != b).cast("int") for k, (a, b) in pairs.items()})
    vals: list[Column] = [c(f"{k}_mismatch") for k in pairs]
    n = sum(v.isNotNull().cast("int") for v in vals)
    return out.withColumn("geo_mismatch_score", F.try_divide(sum(F.coalesce(v, F.lit(0)) for v in vals).cast("double"), n))
