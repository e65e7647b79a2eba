"""Operators that were mended: by blocks, by distinct keys, by one pass."""

import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import boosting, features, models, profile, stats, text
from ledgerlens.plans import catalog
from ledgerlens.sources import binding


def test_expected_counts_by_blocks(spark):
    df = spark.createDataFrame([(i % 3, f"v{i * i % 17}") for i in range(200)], "a int, b string")
    whole = sorted(map(tuple, stats.expected_counts(df, "a", "b").collect()))
    assert sorted(map(tuple, stats.expected_counts(df, "a", "b", block=2).collect())) == whole
    assert len(whole) == 3 * df.select("b").distinct().count() and sum(r[2] for r in whole) == 200
    assert stats.expected_counts(df.limit(0), "a", "b").count() == 0


def test_wide_correlations_are_pairwise_complete(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) * [1, 1000, 1, 0] + [0, 1e7, 5, 3]
    x[:, 2] += x[:, 0]
    rows = [tuple(None if rng.random() < 0.2 else float(v) for v in r) for r in x] + [(float("nan"), 1.0, None, 3.0)]
    df = spark.createDataFrame(rows, "d double, c double, b double, a double").repartition(5)
    got = {(r.a, r.b): r.corr for r in profile.wide_correlations(df, list("dcba")).collect()}
    cols = {n: np.array([np.nan if r[i] is None else r[i] for r in rows]) for i, n in enumerate("dcba")}
    assert len(got) == 10
    for (p, q), c in got.items():
        here = ~np.isnan(cols[p]) & ~np.isnan(cols[q])
        assert c is None if "a" in (p, q) else c == pytest.approx(np.corrcoef(cols[p][here], cols[q][here])[0, 1], abs=1e-9)


def test_isolation_pool_is_of_distinct_keys(spark):
    rows = [(7, 0.0, 0.0)] * 3000 + [(i, float(i % 13), float(i % 7)) for i in range(100, 400)] + [(9999, 500.0, 500.0)]
    df = spark.createDataFrame(rows, "account_id long, a double, b double")
    got = models.isolation_scores(df, "account_id", ["a", "b"], trees=40, sample=32)
    assert got.count() == len(rows)
    by = {r.account_id: r.score for r in got.dropDuplicates(["account_id"]).collect()}
    assert max(by, key=by.get) == 9999 and by[7] > np.median(list(by.values()))  # rare among keys, however often it is repeated


def test_auc_by_group_and_permutation(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(rng.normal()), float(rng.normal()), i % 2) for i in range(600)]
    df = spark.createDataFrame([(i, a, b, int(a + 0.3 * b > 0), g) for i, a, b, g in rows], "id long, a double, b double, y int, g int").withColumn("fold", F.lit(0)).withColumn("c", F.lit(1.0))
    for r in stats.auc_by(df, "b", "y", "g").collect():
        assert r.auc == pytest.approx(stats.roc_auc(df.filter(F.col("g") == r.g), "b", "y").first().auc, abs=1e-12)
    model = boosting.train(df, "id", "y", ["a", "b", "c"], k=1, params=boosting.Params(leaves=8, rounds=4, rate=0.3, patience=9))[0]
    got = {r.feature: r for r in boosting.permutation_importance(df, "id", "y", model).collect()}
    assert got["c"].auc_loss == 0 and got["a"].auc_loss > got["b"].auc_loss > 0
    margin = model.margin(np.array([[r[1], r[2], 1.0] for r in rows]))
    pos, neg = [[m for m, (_, a, b, _) in zip(margin, rows) if int(a + 0.3 * b > 0) == v] for v in (1, 0)]
    base = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    assert got["a"].auc + got["a"].auc_loss == pytest.approx(base, abs=1e-9)


def test_base64_of_long_text_is_one_line(spark):
    rows = [(n, "x" * n + ".PNG") for n in (0, 50, 53, 54, 300)]
    df = spark.createDataFrame(rows, "n int, url string")
    for r in df.select("url", text.base64_text(F.col("url")).alias("b"), text.data_uri(F.col("url"), F.col("url")).alias("u")).collect():
        want = base64.b64encode(r.url.encode()).decode()
        assert r.b == want and r.u == f"data:image/png;base64,{want}"


def test_transactions_and_numbers_are_read_from_one_written_table(spark, sf):
    """Each pass joined lines and orders anew before, and each fit and fold made all features anew."""
    numeric = catalog._numeric(spark, sf)
    assert numeric.inputFiles() and not [f for f in numeric.inputFiles() if "lineitem" in f or "orders" in f]
    txn = binding.txn_t(spark, sf, mcc=True)
    basic = features.basic_stats(txn)
    assert basic.inputFiles() and not [f for f in basic.inputFiles() if "lineitem" in f or "orders" in f]
    assert basic.agg(F.sum("txn_count")).first()[0] == txn.count()


def test_class_summary_reads_two_written_columns(spark, sf):
    """Each pass joined lines, orders and customers anew before, and every line was sorted again for its label."""
    labelled = catalog.labelled_t(spark, sf)
    got = profile.class_summary(labelled, "is_mule", "amount")
    assert got.inputFiles() and not [f for f in got.inputFiles() if any(t in f for t in ("lineitem", "orders", "customer"))]
    assert {r.is_mule: r.n for r in got.collect()} == {r.is_mule: r.n for r in labelled.groupBy("is_mule").agg(F.count("amount").alias("n")).collect()}


def test_labels_meet_orders_not_lines(spark, sf):
    labels = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("account_id"), F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("is_mule"))
    want = binding.txn_t(spark, sf, True).join(labels, "account_id", "left")
    got = catalog.labelled_t(spark, sf, True)
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    before, now = (df._jdf.queryExecution().optimizedPlan().toString() for df in (want, got))
    line = lambda plan: [x for x in plan.splitlines() if "Join" in x][0]  # noqa: E731 - the join that is made last
    assert "account_id" in line(before) and "l_partkey" in line(now)


def test_ids_of_transactions_are_counted_not_shuffled(spark):
    rows = [(None if i % 5 == 0 else i, i % 3, float(i)) for i in range(60)]
    txn = spark.createDataFrame(rows, "transaction_id long, account_id long, amount double")
    got = features.gathered(txn)
    assert {r[0] for r in got.select("transaction_id").distinct().collect()} == {None, 1}
    count = lambda df: sorted(map(tuple, df.groupBy("account_id").agg(F.count("transaction_id"), F.count("*"), F.sum("amount")).collect()))
    assert count(got) == count(txn)
