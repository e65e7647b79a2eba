"""Hot keys are told apart without a join, so no row of a table goes through one to learn its number of tasks."""

from pyspark.sql import functions as F

from ledgerlens.llm.common import HOT_SHARE, Scratch, hot_keys, salted, spread


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_hot_rows_meet_once_and_without_a_join_on_the_key(spark):
    # Key 7 holds half of the rows, the others one each.
    rows = spark.range(4000).select(F.when(F.col("id") < 2000, F.lit(7)).otherwise(F.col("id")).cast("long").alias("key"), "id")
    counts = rows.groupBy("key").agg(F.count("*").alias("c"))
    hot = hot_keys(Scratch(spark), counts, ["key"])
    dealt, copies = salted(rows, hot, ["key"], F.col("id")), spread(counts, hot, ["key"])
    assert "Join" not in _plan(dealt) and "Join" not in _plan(copies)
    assert copies.filter("key = 7").count() == HOT_SHARE // 2
    assert dealt.filter("key = 7").select("salt").distinct().count() > HOT_SHARE // 2 * 0.9
    assert copies.filter("key <> 7").agg(F.max("salt")).first()[0] == 0
    met = dealt.join(copies, ["key", "salt"])
    assert met.count() == 4000 and met.select("id").distinct().count() == 4000


def test_two_column_keys_and_none_that_is_hot(spark):
    rows = spark.range(3000).select((F.col("id") % 3000).alias("a"), F.lit("x").alias("b"))
    even = rows.groupBy("a", "b").agg(F.count("*").alias("c"))
    assert spread(even, hot_keys(Scratch(spark), even, ["a", "b"]), ["a", "b"]).count() == 3000
    one = rows.select(F.lit(1).alias("a"), "b", F.col("a").alias("id"))
    n = one.groupBy("a", "b").agg(F.count("*").alias("c"))
    hot = hot_keys(Scratch(spark), n, ["a", "b"])
    assert salted(one, hot, ["a", "b"], F.col("id")).join(spread(n, hot, ["a", "b"]), ["a", "b", "salt"]).count() == 3000
