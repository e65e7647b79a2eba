"""Rank statistics and quantiles over many distinct values, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import graph, profile, stats


def scored(spark, n):
    """n distinct scores in a scrambled order, the label leaning on them."""
    k = F.col("id")
    score = F.pmod(k * 48271, F.lit(2_147_483_647)).cast("double")
    y = (F.pmod(F.xxhash64(k), F.lit(100)) < F.when(score > 1e9, 60).otherwise(40)).cast("int")
    return spark.range(n).select(score.alias("score"), y.alias("y"))


@pytest.mark.parametrize("n", [1_000_000])
def test_ranks_equal_numpy(spark, n):
    df = scored(spark, n)
    got = df.toPandas()
    s, y = got.score.to_numpy(), got.y.to_numpy()
    order = np.argsort(s)
    ranks = np.empty(n)
    ranks[order] = np.arange(1, n + 1)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    u = ranks[y == 1].sum() - n1 * (n1 + 1) / 2
    r = stats.mann_whitney(df, "score", "y").first()
    assert (r.n1, r.n0, r.u1) == (n1, n0, u)
    assert stats.roc_auc(df, "score", "y").first().auc == pytest.approx(u / (n1 * n0), abs=1e-12)
    up = y[order]
    d = np.abs(np.cumsum(up) / n1 - np.cumsum(1 - up) / n0).max()
    assert stats.ks(df, "score", "y").first().ks == pytest.approx(d, abs=1e-12)
    down = up[::-1]
    tp = np.cumsum(down)
    precision = tp / np.arange(1, n + 1)
    assert stats.average_precision(df, "score", "y").first().ap == pytest.approx((precision * down).sum() / n1, abs=1e-9)
    curve = stats.pr_curve(df, "score", "y").agg(F.sum("tp").alias("a"), F.sum("fp").alias("b"), F.sum("precision").alias("c")).first()
    assert (curve.a, curve.b) == (int(tp.sum()), int((np.arange(1, n + 1) - tp).sum()))
    assert curve.c == pytest.approx(precision.sum(), rel=1e-9)


def test_quantiles_of_a_hot_group(spark):
    df = spark.range(300_000).select(F.when(F.col("id") % 10 < 9, "hot").when(F.col("id") % 20 == 9, None).otherwise("cold").alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("v"))
    pdf = df.toPandas()
    ways = [{r.g: r for r in stats.quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 1.0}, ["g"], hot=hot).collect()} for hot in (0, 20_000, 10**9)]
    assert ways[1].keys() == ways[0].keys() == ways[2].keys()
    got = ways[1]
    for g, rows in pdf.groupby("g", dropna=False):
        g = g if isinstance(g, str) else None
        for way in ways:
            assert [way[g].a, way[g].b, way[g].c] == pytest.approx(list(np.quantile(rows.v, [0.1, 0.5, 1.0])), rel=1e-12)
    summary = {r.g: r for r in profile.class_summary(df, "g", "v").collect()}
    assert summary[None].n == (pdf.g.isna()).sum() and summary["hot"].median == got["hot"].b


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "score double, y int, g string")
    assert stats.quantiles(none, "score", {"m": 0.5}, ["g"]).collect() == []
    assert stats.roc_curve(none, "score", "y").collect() == []
    one = spark.createDataFrame([(2.0, 1, "a"), (None, 1, "a"), (float("nan"), 0, "a")], "score double, y int, g string")
    assert [r.threshold for r in stats.pr_curve(one.filter("score is not null and not isnan(score)"), "score", "y").collect()] == [2.0]
    assert stats.mann_whitney(one, "score", "y").first().u1 == 0.0


def test_label_codes_of_many_texts(spark):
    from ledgerlens.operators import features

    rows = spark.range(20_000).select(F.concat(F.lit("ACCT_"), F.lpad(F.pmod("id", F.lit(9000)).cast("string"), 6, "0")).alias("c"))
    df = rows.unionByName(spark.createDataFrame([(None,), ("",), ("zz",), ("é",)], "c string"))
    got = {r.value: r.code for r in features.label_codes(df, "c").collect()}
    assert got == {v: i for i, v in enumerate(sorted({*(f"ACCT_{k:06d}" for k in range(9000)), "", "zz", "é", "MISSING"}))}


@pytest.mark.parametrize("many", [0, 3, 64])
def test_exposure_by_brute_force(spark, many):
    import random

    from ledgerlens.operators import graph

    rng = random.Random(many)
    txn = [(rng.randrange(60), rng.randrange(4) if rng.random() < 0.5 else rng.randrange(200)) for _ in range(260)] + [(None, 1), (70, None), (71, 999), (72, 999)]
    labels = [(a, int(rng.random() < 0.3), a % 5) for a in range(75) if a % 7] + [(200, 1, 1)]
    got = graph.two_hop_exposure(
        spark.createDataFrame(txn, "account_id long, counterparty_id long"), spark.createDataFrame(labels, "account_id long, is_mule int, fold long"), fold="fold", held_out=0, many=many
    )
    known = {a: y for a, y, f in labels if f != 0}
    pairs = {(a, c) for a, c in txn if a is not None and c is not None}
    want = {}
    for a in {a for a, _ in pairs}:
        peers = {b for x, c in pairs if x == a for b, d in pairs if d == c and b != a and b in known}
        if peers:
            want[a] = (len(peers), sum(known[b] for b in peers))
    assert {r.account_id: (r.n_peers, r.n_bad) for r in got.collect()} == want


def test_folds_are_even(spark):
    from ledgerlens.operators import models

    df = spark.range(5003).select(F.col("id").alias("k"), F.when(F.col("id") % 100 == 0, 1).when(F.col("id") % 999 == 1, None).otherwise(0).alias("y"))
    got = models.stratified_folds(df, "k", "y")
    n = {(r.y, r.fold): r["count"] for r in got.groupBy("y", "fold").count().collect()}
    assert sum(n.values()) == 5003
    for y in (0, 1, None):
        sizes = [n.get((y, f), 0) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_two_hop_unions_are_counted_where_sets_meet(spark, capsys):
    rng = np.random.default_rng(4)
    pairs = sorted({(int(a), int(c)) for a, c in zip(rng.integers(0, 400, 3000), rng.integers(0, 12, 3000) ** 2)} | {(a, 1000 + a // 3) for a in range(400)} | {(500, 2000), (501, 2000)})
    y = {a: int(a % 7 == 0) for a in range(0, 502) if a % 5}
    txn, lab = spark.createDataFrame(pairs, "account_id long, counterparty_id int"), spark.createDataFrame(sorted(y.items()), "account_id long, is_mule int")
    by_cp, want = {}, {}
    for a, c in pairs:
        by_cp.setdefault(c, set()).add(a)
    for a in {a for a, _ in pairs}:
        peers = {p for b, c in pairs if b == a for p in by_cp[c]} - {a}
        known = [y[p] for p in peers if p in y]
        if known:
            want[a] = (len(known), sum(known))
    for many in (0, 5, 64, 10**6):
        found = graph.two_hop_exposure(txn, lab, many=many)
        assert {r.account_id: (r.n_peers, r.n_bad) for r in found.collect()} == want
        # Unions of 4 KB for each account and block were shuffled and sorted before.
        found.explain()
        assert "bitmap_or_agg" not in capsys.readouterr().out


def test_large_groups_meet_in_many_tasks(spark):
    """Without Spark's own broadcasts, rows of large groups are told from others where they are, not by a shuffle on the group."""
    df = spark.range(400).select((F.col("id") % 2).alias("g"), (F.col("id") * 7 % 400).cast("double").alias("v"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = stats.quantiles(df, "v", {"m": 0.5}, ["g"], hot=50)
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.split("\n") if "SortMergeJoin" in x and ("LeftSemi" in x or "LeftAnti" in x)]
        assert [r.m for r in q.orderBy("g").collect()] == [199.0, 200.0]
        box = profile.box_stats(df, "g", "v")
        assert "__salt" in [x for x in box._jdf.queryExecution().executedPlan().toString().split("\n") if "SortMergeJoin" in x][0]
        assert [(r.low_whisker, r.high_whisker, r.n_outliers) for r in box.orderBy("g").collect()] == [(0.0, 398.0, 0), (1.0, 399.0, 0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
