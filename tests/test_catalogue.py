"""Every catalogue query against its SQL, and invariants of the statistics."""

import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerlens.operators import features, graph, models, stats
from ledgerlens.plans.catalog import QUERIES, SQL
from ledgerlens.sources import binding

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def canon(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in df.columns]
    want = sorted(tuple(canon(r[i]) for i in order) for r in rel.fetchall())
    assert sorted(tuple(map(canon, r)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_auc_of_reversed_scores(spark, sf):
    from ledgerlens.plans.catalog import scored

    s = scored(spark, sf)
    both = stats.roc_auc(s, "score", "y").first().auc + stats.roc_auc(s.withColumn("score", -F.col("score")), "score", "y").first().auc
    assert both == pytest.approx(1.0)


def test_invariants(spark, sf):
    t = binding.txn_e(spark, sf)
    assert features.category_shares(t, "channel").groupBy("account_id").agg(F.abs(F.sum("share") - 1).alias("d")).filter("d > 1e-9").count() == 0
    e = features.entropy(t, "channel", "e", "k")
    assert e.filter("e < 0 or e > ln(k) + 1e-9").count() == 0
    b = features.basic_stats(t).filter("txn_count > 0")
    assert b.filter("not (min_amount <= p25_amount and p25_amount <= median_amount and median_amount <= p75_amount and p75_amount <= p95_amount and p95_amount <= max_amount)").count() == 0


def test_pagerank_sums_to_one_and_components(spark):
    e = spark.createDataFrame([(1, -1, 1.0), (2, -1, 1.0), (3, -2, 2.0), (-1, 1, 1.0)], "src long, dst long, w double")
    assert graph.pagerank(e).agg(F.sum("rank")).first()[0] == pytest.approx(1.0)
    assert {r.node: r.label for r in graph.label_propagation(e).collect()} == {1: -1, 2: -1, -1: -1, 3: -2, -2: -2}
    line = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "src long, dst long, w double")
    got = {r.node: r.betweenness for r in graph.betweenness(line).collect()}
    assert max(got, key=got.get) == 3 and got[0] == 0


def test_labels_are_never_left_unsettled(spark):
    line = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9)], "src long, dst long, w double")
    with pytest.raises(RuntimeError):
        graph.label_propagation(line, max_rounds=1)
    assert {r.label for r in graph.label_propagation(line).collect()} == {0}


def test_betweenness_of_the_whole_graph(spark):
    heavy = [(0, -i, 9.0) for i in range(1, 2101)]  # more edges than were once kept, all heavier than the rest
    light = [(0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)]
    got = {r.node: r.betweenness for r in graph.betweenness(spark.createDataFrame(heavy + light, "src long, dst long, w double")).collect()}
    assert got.keys() == {x for e in heavy + light for x in e[:2]} and got[0] > got[1] > got[2] > 0 == got[3]
    pairs = [(1, 2), (2, 3), (3, 4), (4, 1), (4, 5), (5, 6), (6, 7), (5, 7), (10, 11), (11, 12), (13, 13)] + [(20 + i, 21 + i) for i in range(3)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for u in near[v]:
                if u not in dist:
                    dist[u], paths[u] = dist[v] + 1, 0
                    order.append(u)
                paths[u] += paths[v] * (dist[u] == dist[v] + 1)
        owed = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            owed[v] = sum(paths[v] / paths[u] * (1 + owed[u]) for u in near[v] if dist[u] == dist[v] + 1)
            want[v] += owed[v] * (v != s)
    df = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double")
    assert {r.node: r.betweenness for r in graph.betweenness(df).collect()} == pytest.approx(want)
    assert graph.betweenness(df.filter("false")).count() == 0


def test_folds_cover_and_models_score(spark, monkeypatch):
    monkeypatch.setattr(models, "TREES", 30)
    rows = [(i, i % 4 == 0, float(i % 4 == 0) + (i % 7) / 10, float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "account_id long, y boolean, a double, b double").withColumn("is_mule", F.col("y").cast("int"))
    scores, importance = models.cross_validated(df, "account_id", "is_mule", ["a", "b"], k=2)
    assert scores.count() == 400 and scores.select("account_id").distinct().count() == 400
    assert stats.roc_auc(scores, "score_ensemble", "is_mule").first().auc > 0.95
    assert importance[0][0] == "a"
    out = models.isolation_scores(df.unionByName(df.limit(1).withColumn("account_id", F.lit(9999).cast("long")).withColumn("a", F.lit(50.0))), "account_id", ["a", "b"], trees=50)
    assert out.orderBy(F.desc("score")).first().account_id == 9999


def test_unlabelled_rows_get_the_mean_over_folds_and_the_best_score(spark, monkeypatch):
    monkeypatch.setattr(models, "TREES", 30)
    rows = [(i, None if i % 5 == 0 else int(i % 4 == 0), float(i % 4 == 0) + (i % 7) / 10, float(i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "account_id long, is_mule int, a double, b double")
    scores, _ = models.cross_validated(df, "account_id", "is_mule", ["a", "b"], k=2)
    got, known = {r.account_id: r for r in scores.collect()}, df.filter("is_mule is not null")
    assert len(got) == 400
    without = models.cross_validated(known, "account_id", "is_mule", ["a", "b"], k=2)[0].collect()
    assert len(without) == 320 and all(got[r.account_id] == r for r in without)  # unlabelled rows change no model
    auc = {x: stats.roc_auc(scores.filter("is_mule is not null"), f"score_{x}", "is_mule").first().auc for x in ("ensemble", "boosted", "forest")}
    for r in got.values():
        assert r.chosen == max(auc, key=auc.get) and r.score == r[f"score_{r.chosen}"]
        assert (r.fold is None) == (r.account_id % 5 == 0)
    data = models.assemble(models.stratified_folds(known, "account_id", "is_mule", 2), ["a", "b"])
    parts = [models._scored(models._fit("forest", data.filter(F.col("fold") != i), "is_mule", 42 + i), models.assemble(df, ["a", "b"]), "p") for i in range(2)]
    mean = {r.account_id: r.p for r in parts[0].unionByName(parts[1]).filter("is_mule is null").groupBy("account_id").agg(F.avg("p").alias("p")).collect()}
    assert mean.keys() == {i for i in got if i % 5 == 0} and all(got[i].score_forest == pytest.approx(p) for i, p in mean.items())
    flip = scores.withColumn("bad", -F.col("score_boosted"))
    assert models.best_score(flip, "is_mule", ["bad", "score_boosted"]) == "score_boosted"


def test_attributions_sum_to_the_margin(spark):
    rows = [(i, int(i % 4 == 0), float(i % 4 == 0) + (i % 7) / 10, float(i % 5), float(i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "account_id long, is_mule int, a double, b double, c double")
    model = models.boosted(df, "is_mule", ["a", "b", "c"])
    got = {r.account_id: r for r in models.attributions(model, df, "account_id", ["a", "b", "c"]).collect()}
    margin = {r.account_id: r.rawPrediction[1] for r in model.transform(models.assemble(df, ["a", "b", "c"])).collect()}
    assert got.keys() == margin.keys()
    for i, r in got.items():
        assert r.bias + r.a + r.b + r.c == pytest.approx(margin[i], abs=1e-9)
    top = models.mean_attributions(models.attributions(model, df, "account_id", ["a", "b", "c"]), ["a", "b", "c"]).orderBy(F.desc("mean_abs")).first()
    assert top.feature == "a"
    assert models.attributions(model, df.filter("false"), "account_id", ["a", "b", "c"]).count() == 0


def test_library_runs_without_the_training_data_part(tmp_path):
    """The entry module imports, and lists its other queries, when the llm folder and the pipeline are gone."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run(["cp", "-r", f"{root}/ledgerlens", f"{root}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/ledgerlens/llm"], check=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not [k for k in e.queries() if k.startswith('op')]"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env)
