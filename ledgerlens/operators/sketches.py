"""Feature state that merges: what a new batch of transactions adds to an account without its old ones.

Counts, totals and ends merge exactly.  Distinct partners are a HyperLogLog sketch and amounts a KLL sketch, so a
state's size does not grow with its rows, and merging parts in any order is within the same error as one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import shared

KEY, TS, AMT, OTHER = "account_id", "transaction_timestamp", "amount", "counterparty_id"
LG, K = 12, 400  # 2**LG registers; KLL's size


def distinct_error(lg: int = LG) -> float:
    """Relative standard error of the number of partners."""
    return 1.04 / 2 ** (lg / 2)


def rank_error(k: int = K) -> float:
    """How far, as a share of all, a quantile's rank is off at most, in 99 of 100 cases."""
    return 2.296 / k**0.9723


def state(txn: DataFrame, lg: int = LG, k: int = K) -> DataFrame:
    """(account_id, n, total, first_ts, last_ts, partners, amounts) of a batch; sketches are null without a value.

    Null accounts have a state too.  Partial aggregation sketches before the shuffle, so a hot account is one row a task.
    """
    return txn.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(AMT).cast("decimal(18,2)")).cast("decimal(38,2)").alias("total"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"),
        F.when(F.count(OTHER) > 0, F.hll_sketch_agg(F.col(OTHER).cast("long"), lg)).alias("partners"), F.when(F.count(AMT) > 0, F.kll_sketch_agg_double(F.col(AMT).cast("double"), k)).alias("amounts"),
    )


def merged(states: DataFrame) -> DataFrame:
    """One state per account from any number of them."""
    return states.groupBy(KEY).agg(
        F.sum("n").alias("n"), F.sum("total").cast("decimal(38,2)").alias("total"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        F.when(F.count("partners") > 0, F.hll_union_agg("partners")).alias("partners"), F.when(F.count("amounts") > 0, F.kll_merge_agg_double("amounts")).alias("amounts"),
    )


def features(states: DataFrame, quantiles: dict[str, float] | None = None) -> DataFrame:
    """The features of a state: n, total, first_ts, last_ts, n_partners (0 without any) and quantiles of the amounts (null)."""
    named = quantiles or {"p25_amount": 0.25, "median_amount": 0.5, "p95_amount": 0.95}
    estimate = F.when(F.col("partners").isNotNull(), F.hll_sketch_estimate("partners")).otherwise(0)
    q = {c: F.when(F.col("amounts").isNotNull(), F.kll_sketch_get_quantile_double("amounts", F.lit(float(p)))) for c, p in named.items()}
    return states.select(KEY, "n", F.col("total").cast("double").alias("total"), "first_ts", "last_ts", estimate.cast("long").alias("n_partners"), *[v.alias(c) for c, v in q.items()])


def keeper(target: str, lg: int = LG, k: int = K):
    """A foreachBatch function that merges each batch into the states kept at ``target``, a new version per batch.

    Version b is made of version b - 1 and batch b alone, so a batch that is run again gives the same; version
    b - 2 is deleted.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        new = state(batch, lg, k)
        if batch_id > 0:
            new = merged(batch.sparkSession.read.parquet(f"{target}/v{batch_id - 1}").unionByName(new))
        new.write.mode("overwrite").parquet(f"{target}/v{batch_id}")
        if batch_id > 1:
            shared._remove(batch.sparkSession, f"{target}/v{batch_id - 2}")

    return run
