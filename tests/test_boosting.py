"""Leaf-wise boosting against a plain numpy version that takes one leaf at a time, and Shapley values by enumeration."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import boosting


def plain(x, y, h, part, m, cuts, p):
    """One fold's model: the definition, a leaf at a time."""
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    known = part != m
    pos = y[known].sum()
    weight = (known.sum() - pos) / pos
    aside = boosting._uniform(h, p.seed, 1) < 0.1
    margin, margins, trees = np.zeros(len(x)), [np.zeros(len(x))], []
    for r in range(p.rounds):
        use = np.flatnonzero(known & ~aside & (boosting._uniform(h, p.seed, 2 + m, r // p.redraw) < p.rows))
        chosen = boosting.chosen_features(x.shape[1], p.features, p.seed, m, r)
        prob = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, weight, 1.0)
        g, hess = w * (prob - y), w * prob * (1 - prob)

        def best(rows):
            out = (0.0, None)
            for f in chosen:
                for cut in range(len(cuts[f])):
                    left = rows[bins[rows, f] <= cut]
                    right = rows[bins[rows, f] > cut]
                    if min(len(left), len(right)) < p.least_rows or min(hess[left].sum(), hess[right].sum()) < p.least_hessian:
                        continue
                    gain = g[left].sum() ** 2 / hess[left].sum() + g[right].sum() ** 2 / hess[right].sum() - g[rows].sum() ** 2 / hess[rows].sum()
                    if gain > out[0] + 1e-10:
                        out = (gain, (f, cut))
            return out

        leaves, splits = [(use, best(use), ())], []
        while len(leaves) < p.leaves:
            k = max(range(len(leaves)), key=lambda i: leaves[i][1][0])
            rows, (gain, cut), path = leaves[k]
            if cut is None:
                break
            f, c = cut
            splits.append((path, f, cuts[f][c]))
            left, right = rows[bins[rows, f] <= c], rows[bins[rows, f] > c]
            leaves[k : k + 1] = [(left, best(left), path + ((f, c, 0),)), (right, best(right), path + ((f, c, 1),))]
        value = np.zeros(len(x))
        for rows, _, path in leaves:
            at = np.ones(len(x), bool)
            for f, c, side in path:
                at &= (bins[:, f] > c) == bool(side)
            value[at] = -p.rate * g[rows].sum() / hess[rows].sum()
        margin = margin + value
        margins.append(margin)
        trees.append((len(leaves), sorted((f, round(float(v), 9)) for _, f, v in splits)))
    return margins, trees


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(900, 3)), rng.integers(0, 6, size=(900, 2))], axis=1).round(3)
    y = ((x[:, 0] + (x[:, 3] > 2) * x[:, 1] + rng.normal(scale=0.5, size=900)) > 0.8).astype(int)
    rows = [(i, int(y[i]), i % 3, *map(float, x[i])) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, y int, fold int, a double, b double, c double, d double, e double").repartition(3)
    return x, y, df


def test_trees_equal_plain_leafwise_growth(spark, data):
    x, y, df = data
    p = boosting.Params(leaves=12, rate=0.2, rounds=4, patience=99, bins=16, redraw=2)
    columns = list("abcde")
    models = boosting.train(df, "id", "y", columns, k=3, params=p)
    cuts = boosting.bounds(df, columns, p.bins)
    h = np.array([r.h for r in df.select("id", F.xxhash64("id").alias("h")).orderBy("id").collect()])
    for m in range(3):
        margins, trees = plain(x, y, h, np.arange(900) % 3, m, cuts, p)
        # The best round stays, so a model may be shorter than what was grown.
        own = [(int((t.feature < 0).sum()), sorted((int(f), round(float(v), 9)) for f, v in zip(t.feature, t.threshold) if f >= 0)) for t in models[m].trees]
        assert own == trees[: len(own)] and len(own) == int(np.argmax(models[m].aucs)) >= 1
        assert np.allclose(models[m].margin(x), margins[len(own)], atol=1e-9)
    assert sum(len(m.trees) for m in models) >= 5


def test_scores_are_out_of_fold_and_learn(spark, data):
    x, y, df = data
    both = df.unionByName(df.filter("id < 30").withColumns({"id": F.col("id") + 10_000, "y": F.lit(None).cast("int"), "fold": F.lit(None).cast("int")}))
    p = boosting.Params(leaves=8, rate=0.3, rounds=12, patience=4, bins=32)
    models = boosting.train(both, "id", "y", list("abcde"), k=3, params=p)
    got = {r.id: r for r in boosting.score(both, "id", models).collect()}
    assert len(got) == 930
    probs = np.stack([boosting.sigmoid(m.margin(x)) for m in models], axis=1)
    assert all(abs(got[i].score - probs[i, i % 3]) < 1e-12 for i in range(900))
    assert all(abs(got[10_000 + i].score - probs[i].mean()) < 1e-12 for i in range(30))
    pos, neg = [[got[i].score for i in range(900) if y[i] == v] for v in (1, 0)]
    assert np.mean([a > b for a in pos[::3] for b in neg[::3]]) > 0.8
    gains = boosting.importance(models)
    assert max(gains, key=gains.get) == "a" and all(v >= 0 for v in gains.values())


def test_odd_training_tables(spark, data):
    _, _, df = data
    p = boosting.Params(leaves=4, rounds=2, bins=8)
    one = boosting.train(df.filter("y = 1"), "id", "y", ["a"], k=3, params=p)
    assert all(not m.trees for m in one) and all(r.score > 0.99 for r in boosting.score(df.limit(5), "id", one).collect())
    none = boosting.train(df.limit(0), "id", "y", ["a", "b"], k=2, params=p)
    assert boosting.score(df.limit(0), "id", none).count() == 0 and all(not m.trees for m in none)
    gaps = df.withColumns({"a": F.when(F.col("id") % 4 != 0, F.col("a")).otherwise(float("nan")), "b": F.lit(1.0), "c": F.when(F.col("id") % 2 == 0, F.col("c"))})
    model = boosting.train(gaps.withColumn("fold", F.lit(0)), "id", "y", list("abcde"), k=1, params=boosting.Params(leaves=6, rounds=3, rate=0.5, patience=9))[0]
    assert model.trees and all((t.feature != 1).all() for t in model.trees)  # a constant column is never cut
    assert boosting.attributions(gaps, "id", model).filter(F.abs(F.col("bias") + sum(F.col(c) for c in "abcde") - F.col("margin")) > 1e-9).count() == 0


def value_of(tree, row, present):
    """Expected tree value when only ``present`` features are known: absent ones follow the covers."""

    def walk(k):
        f = tree.feature[k]
        if f < 0:
            return tree.value[k]
        left, right = tree.left[k], tree.right[k]
        if f in present:
            return walk(right if row[f] > tree.threshold[k] else left)
        return (tree.cover[left] * walk(left) + tree.cover[right] * walk(right)) / tree.cover[k]

    return walk(0)


def grown(rng, depth, n_features):
    rows = []

    def make(d, cover):
        at = len(rows)
        rows.append([-1, 0.0, 0, -1, -1, float(rng.normal()), cover, 0.0])
        if d < depth and (d < 2 or rng.random() < 0.8):
            share = rng.uniform(0.1, 0.9)
            rows[at][0], rows[at][1] = int(rng.integers(n_features)), float(rng.normal())
            rows[at][3] = make(d + 1, cover * share)
            rows[at][4] = make(d + 1, cover * (1 - share))
        return at

    make(0, 1000.0)
    return boosting.Tree(*[np.array(c) for c in zip(*rows)])


@pytest.mark.parametrize("seed, depth, n", [(1, 3, 3), (2, 6, 10), (3, 7, 2), (4, 6, 10)])
def test_shapley_by_enumeration(seed, depth, n):
    rng = np.random.default_rng(seed)
    tree, x = grown(rng, depth, n), rng.normal(size=(4, n))
    x[0, 0] = float("nan")
    expected, got = boosting.shapley(tree, x)
    assert expected == pytest.approx(value_of(tree, x[0], set()), abs=1e-12)
    for r, row in enumerate(x):
        worth = {s: value_of(tree, row, set(s)) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
        for i in range(n):
            others = [j for j in range(n) if j != i]
            want = sum(
                math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (worth[tuple(sorted((*s, i)))] - worth[s])
                for k in range(n) for s in itertools.combinations(others, k)
            )
            assert got[r, i] == pytest.approx(want, abs=1e-11)
        assert expected + got[r].sum() == pytest.approx(value_of(tree, row, set(range(n))), abs=1e-11)


def test_written_tables_are_deleted(spark, data, monkeypatch):
    from ledgerlens.sources import shared

    made = []
    keep = shared.Tables.keep
    monkeypatch.setattr(shared.Tables, "keep", lambda self, df, name: (made.append(f"{self.base}/{name}-{self.n + 1}"), keep(self, df, name))[1])
    boosting.train(data[2], "id", "y", list("abc"), k=3, params=boosting.Params(leaves=3, rounds=9, patience=99, bins=4))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    there = [p for p in made if path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path(p))]
    assert len(made) == 2 and not there


def test_models_do_not_depend_on_how_rows_lie_in_files(spark):
    """Sums are made in the order of the key's hash by tasks of a number that the rows give, so each is the same to the last bit."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1200, 3))
    rows = [(i, int(v[0] + v[1] * v[2] > 0.3), i % 2, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, y int, fold int, a double, b double, c double")
    p = boosting.Params(rounds=3, patience=3, leaves=8)
    one, many = (boosting.train(d, "id", "y", ["a", "b", "c"], k=2, params=p) for d in (df.repartition(1), df.repartition(7)))
    for m, n in zip(one, many):
        assert len(m.trees) == len(n.trees) > 0
        assert all(np.array_equal(s.value, t.value) and np.array_equal(s.feature, t.feature) for s, t in zip(m.trees, n.trees))
