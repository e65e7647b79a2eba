"""Folds, boosted trees and their average, importance, decision costs, and unsupervised scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept
from . import stats


ROUNDS = 2000  # of boosting, at most: the validation rows end it
TREES = 100


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``fold``: each class is dealt in turn over k folds, in the order of a hash of key and seed.

    Classes' shares in the folds differ by one row at most.  A class is ordered range by range, so none has
    to meet in one task.  One row per key.
    """
    order = df.select(key, F.col(label).alias("__y"), F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")).alias("__h")).withColumn("__one", F.lit(1))
    place = stats.running(order, "__h", {"__k": "__one"}, ["__y"]).select(key, ((F.col("__k") - 1) % k).cast("int").alias("fold"))
    return df.join(place, key)


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="keep").transform(df)


def _fit(kind: str, train: DataFrame, label: str, seed: int):
    """A learner on class-weighted rows; a tenth of the training rows, never the scored fold, stops boosting."""
    n1, n = train.agg(F.sum(F.col(label).cast("double")), F.count(F.lit(1))).first()
    weight = (n - (n1 or 0)) / max(n1 or 0, 1)
    rows = train.withColumn("__w", F.when(F.col(label) == 1, float(weight)).otherwise(1.0)).withColumn("__y", F.col(label).cast("double"))
    if kind == "boosted":
        rows = rows.withColumn("__v", F.pmod(F.xxhash64("features", F.lit(seed)), F.lit(10)) == 0)
        return GBTClassifier(
            featuresCol="features", labelCol="__y", weightCol="__w", maxIter=ROUNDS, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, validationIndicatorCol="__v"
        ).fit(rows)
    return RandomForestClassifier(featuresCol="features", labelCol="__y", weightCol="__w", numTrees=TREES, maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed).fit(rows)


def boosted(df: DataFrame, label: str, columns: list[str], seed: int = 42):
    """Boosted trees fitted on all labelled rows."""
    return _fit("boosted", kept(assemble(df.filter(F.col(label).isNotNull()), columns)), label, seed)


def _scored(model, df: DataFrame, name: str) -> DataFrame:
    return model.transform(df).withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("rawPrediction", "probability", "prediction")


def best_score(scores: DataFrame, label: str, names: list[str]) -> str:
    """The column of the highest AUC over the labelled rows; the first of equals."""
    known = scores.filter(F.col(label).isNotNull())
    auc = {c: stats.roc_auc(known, c, label).first().auc or 0.0 for c in names}
    return max(names, key=auc.get)


def cross_validated(df: DataFrame, key: str, label: str, columns: list[str], k: int = 5, seed: int = 42, kinds: tuple[str, ...] = ("boosted", "forest")):
    """((key, label, fold, score per kind, score_ensemble, chosen, score), importances of the first fold's first model).

    Labelled rows are scored out of fold.  Rows with a null label are in no fold and train no model; each of
    their scores is the mean over the models of all folds.  ``score`` is, for all rows, the column named in
    ``chosen``: the mean of the kinds, unless one kind alone has the better AUC out of fold.
    """
    known = F.col(label).isNotNull()
    dealt = stratified_folds(df, key, label, k, seed).withColumn("fold", F.when(known, F.col("fold")))
    # Written to the shared folder once: every fold's models read it, and nothing stays cached.
    data = kept(assemble(dealt, columns).select(key, label, "fold", "features"))
    out, rest, importance = None, data.filter(~known), None
    for i in range(k):
        scored = data.filter(F.col("fold") == i)
        for kind in kinds:
            model = _fit(kind, data.filter(F.col("fold") != i), label, seed + i)
            if importance is None:
                importance = sorted(zip(columns, model.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))
            scored, rest = _scored(model, scored, f"score_{kind}"), _scored(model, rest, f"__{kind}_{i}")
        out = scored if out is None else out.unionByName(scored)
    rest = rest.select(key, label, "fold", "features", *[(sum((F.col(f"__{x}_{i}") for i in range(k)), F.lit(0.0)) / k).alias(f"score_{x}") for x in kinds])
    mean = sum((F.col(f"score_{x}") for x in kinds), F.lit(0.0)) / len(kinds)
    out = out.unionByName(rest).withColumn("score_ensemble", mean).drop("features")
    chosen = "score_ensemble"
    if len(kinds) > 1:
        out = kept(out)
        chosen = best_score(out, label, ["score_ensemble", *[f"score_{x}" for x in kinds]])
    return out.withColumns({"chosen": F.lit(chosen.removeprefix("score_")), "score": F.col(chosen)}), importance


def _tree(model) -> dict[str, np.ndarray]:
    """A fitted tree's nodes in arrays: feature (-1: leaf), threshold, left, right, value."""
    rows: list[list[float]] = []

    def walk(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, -1, -1, node.prediction()])
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            rows[at][0], rows[at][1] = split.featureIndex(), split.threshold()
            rows[at][2], rows[at][3] = walk(node.leftChild()), walk(node.rightChild())
        return at

    walk(model._call_java("rootNode"))
    cols = list(zip(*rows))
    return {k: np.array(c, dtype=t) for k, c, t in zip(("feature", "threshold", "left", "right", "value"), cols, (int, float, int, int, float))}


def attributions(model, df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, bias, one column per feature): what each feature adds to a row's margin, by paths through the trees.

    On a row's path, the change of the node's mean from parent to child goes to the feature that was split
    on; bias is the mean of the roots.  Bias and contributions sum to the weighted sum of the trees.  For
    models of continuous splits.  Rows are scored in batches on the executors; the trees are sent with the code.
    """
    trees, weights = [_tree(t) for t in model.trees], [float(w) for w in model.treeWeights]
    x = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns])

    def run(batches):
        for pdf in batches:
            rows = pdf[columns].to_numpy(dtype=np.float64)
            out, bias = np.zeros((len(rows), len(columns))), 0.0
            for t, w in zip(trees, weights):
                bias += w * t["value"][0]
                at = np.zeros(len(rows), dtype=int)
                while len(live := np.flatnonzero(t["feature"][at] >= 0)):
                    here = at[live]
                    f = t["feature"][here]
                    new = np.where(rows[live, f] <= t["threshold"][here], t["left"][here], t["right"][here])
                    out[live, f] += w * (t["value"][new] - t["value"][here])
                    at[live] = new
            yield pd.DataFrame({key: pdf[key], "bias": bias} | {c: out[:, i] for i, c in enumerate(columns)})

    kind = df.schema[key].dataType.simpleString()
    return x.mapInPandas(run, f"{key} {kind}, bias double, " + ", ".join(f"`{c}` double" for c in columns))


def mean_attributions(contributions: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean_abs, mean): how much each feature moves the margin, over all rows."""
    g = contributions.agg(*[F.struct(F.avg(F.abs(c)).alias("mean_abs"), F.avg(c).alias("mean")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in columns])
    return g.select(F.explode(rows).alias("x")).select("x.feature", "x.r.mean_abs", "x.r.mean")


def cost_sweep(df: DataFrame, score: str, label: str, thresholds: list[float], fn: int = 1_000_000, fp: int = 50_000, tp: int = -500_000, tn: int = 0) -> DataFrame:
    """(threshold, tp, fp, fn, tn, cost, precision, recall, fpr, f1) for scores of at least the threshold; one pass."""
    s, y = F.col(score), F.col(label)
    aggs = []
    for i, t in enumerate(thresholds):
        aggs += [F.count_if((s >= t) & (y == 1)).alias(f"tp{i}"), F.count_if((s >= t) & (y == 0)).alias(f"fp{i}")]
    g = df.agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"), (F.col("p") - F.col(f"tp{i}")).alias("fn"), (F.col("n") - F.col(f"fp{i}")).alias("tn")) for i, t in enumerate(thresholds)])
    c = F.col
    out = g.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumns(
        {
            "cost": c("fn") * fn + c("fp") * fp + c("tp") * tp + c("tn") * tn,
            "precision": F.try_divide(c("tp"), c("tp") + c("fp")),
            "recall": F.try_divide(c("tp"), c("tp") + c("fn")),
            "fpr": F.try_divide(c("fp"), c("fp") + c("tn")),
            "f1": F.try_divide(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")),
        }
    )


def optimal_thresholds(sweep: DataFrame) -> DataFrame:
    """(criterion, threshold, cost, f1): the row of least cost and that of best F1; the lower threshold of equals."""
    row = F.struct("threshold", "cost", "f1")
    best = sweep.agg(F.min_by(row, F.struct("cost", "threshold")).alias("cost"), F.max_by(row, F.struct(F.coalesce("f1", F.lit(-1.0)), -F.col("threshold"))).alias("f1"))
    rows = F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(c).alias("r")) for c in ("cost", "f1")])
    return best.select(F.explode(rows).alias("x")).select("x.criterion", "x.r.threshold", "x.r.cost", "x.r.f1")


def fairness(df: DataFrame, score: str, label: str, segment: str, threshold: float) -> DataFrame:
    """(segment, n, n_flagged, flag_rate, fp_rate), with a row for all segments (null segment)."""
    s, y = F.col(score), F.col(label)
    g = df.rollup(segment).agg(F.count(F.lit(1)).alias("n"), F.count_if(s >= threshold).alias("n_flagged"), F.count_if((s >= threshold) & (y == 0)).alias("f"), F.count_if(y == 0).alias("neg"))
    return g.select(segment, "n", "n_flagged", F.try_divide(F.col("n_flagged"), F.col("n")).alias("flag_rate"), F.try_divide(F.col("f"), F.col("neg")).alias("fp_rate"))


def false_positive_profile(df: DataFrame, score: str, label: str, columns: list[str], top: int = 10) -> DataFrame:
    """The ``top`` best-scored negatives, each column as a multiple of the negatives' mean."""
    neg = df.filter(F.col(label) == 0)
    mean = F.broadcast(neg.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns]))  # one row
    best = neg.orderBy(F.desc(score), "account_id").limit(top)
    return best.crossJoin(mean).select("account_id", score, *[F.try_divide(F.col(c), F.col(f"__m_{c}")).alias(f"{c}_vs_mean") for c in columns])


def kmeans_distance(df: DataFrame, key: str, columns: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """(key, cluster, distance to its own centre), on standardised columns."""
    v = assemble(df, columns, "raw")
    v = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v)
    model = KMeans(k=k, seed=seed).fit(v)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    own = F.get(centres, F.col("prediction"))
    d2 = F.aggregate(F.zip_with(vector_to_array("features"), own, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return model.transform(v).select(key, F.col("prediction").alias("cluster"), F.sqrt(d2).alias("distance"))


def cluster_shares(clusters: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(cluster, n, n_positive, share, mean_distance) of clusters made by ``kmeans_distance``."""
    j = clusters.join(labels.select(key, label), key)
    return j.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_positive"), F.avg((F.col(label) == 1).cast("double")).alias("share"), F.avg("distance").alias("mean_distance")
    )


def pca_error(df: DataFrame, key: str, columns: list[str], k: int = 5) -> DataFrame:
    """(key, error): norm of what ``k`` principal components leave of a standardised row."""
    v = assemble(df, columns, "raw")
    v = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(v).transform(v)
    model = PCA(k=min(k, len(columns)), inputCol="features", outputCol="p").fit(v)
    dot = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, x: a + x * x)  # noqa: E731 - components are orthonormal
    return model.transform(v).select(key, F.sqrt(F.greatest(F.lit(0.0), dot("features") - dot("p"))).alias("error"))


def isolation_scores(df: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(key, score): isolation forest; trees are grown on ``trees`` samples of ``sample`` rows, then applied everywhere.

    The rows grown on are at most trees * sample / 4, one for each of the keys of least hash (of a repeated key the
    least row), which bounds what the driver gets.
    """
    x = df.select(key, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x"))
    most = max(sample, trees * sample // 4)
    h = F.xxhash64(F.col(key), F.lit(seed))
    keys = x.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    near = x
    if keys > 2 * most:  # leaves about twice the bound in all, however many partitions send their least ones
        near = x.filter(F.pmod(h, F.lit(1 << 40)) < F.lit(int(2 * most / keys * (1 << 40))))
    near = near.groupBy(key).agg(F.min("x").alias("x"))
    pool = np.array([r[0] for r in near.orderBy(h, key).limit(most).select("x").collect()])
    if not len(pool):
        return df.select(key, F.lit(0.0).alias("score"))
    rng = np.random.default_rng(seed)
    deepest = max(1, math.ceil(math.log2(min(sample, max(2, len(pool))))))

    def path(n: float) -> float:
        return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def grow(rows: np.ndarray, depth: int) -> list:
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        free = np.flatnonzero(hi > lo)
        if depth >= deepest or len(rows) <= 1 or not len(free):
            return [depth + path(len(rows))]
        f = int(rng.choice(free))
        cut = float(rng.uniform(lo[f], hi[f]))
        left = rows[:, f] < cut
        return [f, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1)]

    forest = [grow(pool[rng.choice(len(pool), min(sample, len(pool)), replace=False)], 0) for _ in range(trees)]
    norm = path(min(sample, len(pool))) or 1.0

    def apply(node, rows, where, out):
        if len(node) == 1:
            out[where] += node[0]
            return
        left = rows[where, node[0]] < node[1]
        apply(node[2], rows, where[left], out)
        apply(node[3], rows, where[~left], out)

    def score(batches):
        for pdf in batches:
            rows, out = np.stack(pdf["x"]) if len(pdf) else np.empty((0, len(columns))), np.zeros(len(pdf))
            for tree in forest:
                apply(tree, rows, np.arange(len(rows)), out)
            yield pd.DataFrame({key: pdf[key], "score": 2.0 ** (-out / len(forest) / norm)})

    return x.mapInPandas(score, f"{key} {df.schema[key].dataType.simpleString()}, score double")


def tier_counts(df: DataFrame, tier: str = "tier") -> DataFrame:
    return df.groupBy(tier).agg(F.count(F.lit(1)).alias("n"))


