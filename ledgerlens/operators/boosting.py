"""Leaf-wise histogram boosting over Spark tables, for all folds at once, and exact Shapley values of its trees.

Rows are cut into quantile bins once and written.  A pass over them sums gradients per (model, leaf, feature, bin) in the
tasks; the sums meet by (model, feature), where the best cut of each leaf is found, and the driver gets one
candidate per leaf and task.  All folds' models grow in the same passes, since a row belongs to several
training sets.

A tree grows best leaf first.  So that a pass can serve many leaves, every leaf that best-first growth would split
by what is known so far is split ahead; the tree is final when the order of splits needs no leaf that has not been
looked at, so it is the same as if leaves had been taken one by one.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import Tables, importable
from . import stats

AUC_BINS = 10_000  # equal score bins in which validation rows are counted
REWRITE = 8  # rounds after which margins are written, so that no row walks more trees than that
TASK_ROWS = 1 << 14  # rows of a task, at least: each sends its sums of all leaves, so tasks beyond the cores only add to them
TOGETHER = 4_000_000  # bytes of sums that leave a task at once


@dataclass
class Params:
    """Defaults are those of the account-risk model: 63 leaves, rate 0.05, 0.8 of features and of rows (drawn anew every
    5 rounds), at most 2000 rounds, ended by 50 rounds without a better AUC."""

    leaves: int = 63
    rate: float = 0.05
    features: float = 0.8
    rows: float = 0.8
    redraw: int = 5
    rounds: int = 2000
    patience: int = 50
    least_rows: int = 20
    least_hessian: float = 1e-3
    bins: int = 255
    l2: float = 0.0
    seed: int = 42


@dataclass
class Node:
    total: tuple[float, float, float]  # gradients, hessians, rows
    gain: float | None = None  # of its best cut; None: not looked at; 0: there is none
    cut: tuple[int, int] | None = None  # feature, last bin on the left
    best_left: tuple[float, float, float] = (0.0, 0.0, 0.0)  # sums left of that cut
    left: int = -1
    right: int = -1


@dataclass
class Tree:
    """Nodes in arrays; feature -1: leaf.  A row goes left if its value is at most the threshold or is NaN."""

    feature: np.ndarray
    threshold: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def leaf_of(self, x: np.ndarray, by: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row of ``x``: raw values, or bins with ``by`` = ``self.bin``."""
        cuts = self.threshold if by is None else by
        at = np.zeros(len(x), dtype=np.int64)
        while len(live := np.flatnonzero(self.feature[at] >= 0)):
            here = at[live]
            right = x[live, self.feature[here]] > cuts[here]
            at[live] = np.where(right, self.right[here], self.left[here])
        return at


@dataclass
class Model:
    base: float
    trees: list[Tree] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    aucs: list[float] = field(default_factory=list)  # of the validation rows, with 0, 1, 2, ... trees

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.value[t.leaf_of(x)]
        return out


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(m / 2))


# --- bins ---------------------------------------------------------------------------------------------------------


def bounds(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """For each column the upper bounds of its bins but the last: approximate quantiles, distinct.

    One pass; the driver gets ``bins`` numbers a column.  NaN and null take part in no bound.
    """
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    fine = lambda c: F.when(~F.isnan(c), F.col(c))
    found = df.agg(*[F.percentile_approx(fine(c), probs, F.lit(10 * bins)).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array([v + 0.0 for v in (q or [])], dtype=np.float64)) for q in found]


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: how many bounds lie below the value; NaN is in the first bin."""
    out = np.empty(x.shape, dtype=np.uint8)
    for f, c in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), 0, np.searchsorted(c, x[:, f], side="left"))
    return out


def _matrix(col: pa.Array, width: int, dtype) -> np.ndarray:
    if dtype == np.uint8:
        return np.frombuffer(b"".join(v.as_py() for v in col), dtype=np.uint8).reshape(len(col), width)
    return col.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(col), width)


# --- growing ------------------------------------------------------------------------------------------------------


def split_gain(left, total, p: Params):
    """Gain of the cuts with ``left`` sums (..., 3) of nodes with ``total`` sums; not positive where a side is too small."""
    right = total - left
    score = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + p.l2, 1e-300)
    gain = score(left) + score(right) - score(total)
    small = (np.minimum(left[..., 2], right[..., 2]) < p.least_rows) | (np.minimum(left[..., 1], right[..., 1]) < p.least_hessian)
    return np.where(small, 0.0, gain)


class Growth:
    """One tree in the making."""

    def __init__(self, total, chosen: np.ndarray, p: Params):
        self.p, self.chosen, self.nodes, self.order = p, chosen, [Node(tuple(total))], []

    def offer(self, node: int, gain: float, feature: int, cut: int, left: tuple) -> None:
        n = self.nodes[node]
        if n.gain is None or (gain, -feature, -cut) > (n.gain, *(-v for v in n.cut or (1 << 30, 0))):
            n.gain, n.cut, n.best_left = gain, (feature, cut), left

    def open(self) -> list[int]:
        """Leaves to look at next.  Splits ahead what best-first growth takes by what is known; empty when it needs no more."""
        heap, unknown, self.order = [], [], []

        def push(k):
            n = self.nodes[k]
            if n.gain is None:
                unknown.append(k)
            elif n.gain > 1e-12:
                heapq.heappush(heap, (-n.gain, k))

        push(0)
        while heap and len(self.order) + 1 < self.p.leaves:
            _, k = heapq.heappop(heap)
            n = self.nodes[k]
            self.order.append(k)
            if n.left < 0:
                rest = tuple(a - b for a, b in zip(n.total, n.best_left))
                n.left, n.right = len(self.nodes), len(self.nodes) + 1
                self.nodes += [Node(n.best_left), Node(rest)]
            if len(self.order) + 1 < self.p.leaves:
                push(n.left)
                push(n.right)
        return unknown

    def arrays(self) -> tuple[np.ndarray, ...]:
        """(feature, bin, left, right) of all nodes, those split ahead included."""
        cut = [n.cut if n.left >= 0 else (-1, 0) for n in self.nodes]
        return tuple(np.array(v, dtype=np.int64) for v in ([c[0] for c in cut], [c[1] for c in cut], [n.left for n in self.nodes], [n.right for n in self.nodes]))

    def tree(self, cuts: list[np.ndarray]) -> Tree:
        """The nodes that were chosen, with leaf values."""
        split, new, rows = set(self.order), {}, []

        def walk(k: int) -> int:
            n = self.nodes[k]
            at = new[k] = len(rows)
            g, h, c = n.total
            rows.append([-1, 0.0, 0, -1, -1, -self.p.rate * g / max(h + self.p.l2, 1e-300), c, 0.0])
            if k in split:
                f, b = n.cut
                rows[at][:5] = [f, float(cuts[f][b]), b, walk(n.left), walk(n.right)]
                rows[at][7] = n.gain
            return at

        walk(0)
        kinds = (int, float, int, int, int, float, float, float)
        return Tree(*[np.array(c, dtype=t) for c, t in zip(zip(*rows), kinds)])


def _uniform(h: np.ndarray, *parts: int) -> np.ndarray:
    """Numbers in [0, 1) that a row's hash and ``parts`` determine."""
    x = h.astype(np.uint64)
    for p in parts:
        x = (x ^ np.uint64((p + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def chosen_features(n: int, share: float, *parts: int) -> np.ndarray:
    """A tree's features: the share of least hash, one at least."""
    u = _uniform(np.arange(n, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1), *parts)
    return np.sort(np.argsort(u, kind="stable")[: max(1, round(share * n))])


class _Pass:
    """What the tasks of one pass need: plain arrays, sent with the code."""

    def __init__(self, p, round_, weights, done, growths, wanted, width, cuts, n_models):
        self.p, self.round, self.weights, self.done, self.width, self.n_models = p, round_, weights, done, width, n_models
        self.arrays = {m: g.arrays() for m, g in growths.items()}
        self.chosen = {m: g.chosen for m, g in growths.items()}
        self.wanted = wanted
        self.sizes = [len(c) + 1 for c in cuts]

    def margins(self, start: np.ndarray, x: np.ndarray, m: int) -> np.ndarray:
        out = start[:, m].copy()
        for t in self.done[m]:
            out += t.value[t.leaf_of(x, t.bin)]
        return out

    def own_rows(self, part, h, m: int):
        """(training rows of this round, validation rows) of model ``m``; a row's part is its own fold, -1 if none."""
        known = (part >= 0) & (part != m)
        aside = _uniform(h, self.p.seed, 1) < 0.1
        bag = _uniform(h, self.p.seed, 2 + m, self.round // self.p.redraw) < self.p.rows
        return known & ~aside & bag, known & aside

    def nodes(self, x: np.ndarray, m: int) -> np.ndarray:
        feature, cut, left, right = self.arrays[m]
        at = np.zeros(len(x), dtype=np.int64)
        while len(live := np.flatnonzero(feature[at] >= 0)):
            here = at[live]
            at[live] = np.where(x[live, feature[here]] > cut[here], right[here], left[here])
        return at


def _totals(batches, plan: _Pass):
    """First pass of a round: per model the sums at the root, and counts of validation scores by label."""
    sums = np.zeros((plan.n_models, 3))
    counts = np.zeros((plan.n_models, 2, AUC_BINS))
    for rb in batches:
        y, part, h = rb.column(1).to_numpy(zero_copy_only=False), rb.column(2).to_numpy(), rb.column(3).to_numpy()
        x, start = _matrix(rb.column(4), plan.width, np.uint8), _matrix(rb.column(5), plan.n_models, np.float64)
        for m in plan.done:
            margin = plan.margins(start, x, m)
            train, aside = plan.own_rows(part, h, m)
            prob = sigmoid(margin)
            w = np.where(y == 1, plan.weights[m], 1.0)
            sums[m] += [(w * (prob - y))[train].sum(), (w * prob * (1 - prob))[train].sum(), train.sum()]
            place = np.minimum((prob[aside] * AUC_BINS).astype(np.int64), AUC_BINS - 1)
            counts[m] += np.bincount(place + AUC_BINS * (y[aside] == 1), minlength=2 * AUC_BINS).reshape(2, AUC_BINS)
    for m in plan.done:
        held = np.flatnonzero(counts[m].sum(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([m], pa.int32()), pa.array([sums[m].tolist()]), pa.array([held.tolist()], pa.list_(pa.int32())), pa.array([counts[m][0][held].tolist()]), pa.array([counts[m][1][held].tolist()])],
            names=["m", "s", "place", "negative", "positive"],
        )


def _histograms(batches, plan: _Pass):
    """(m, f, part, at, sums): per model and feature the sums of each wanted leaf and bin, over this task's rows.

    ``at``: the places that have rows where that is shorter, else empty and ``sums`` has all places.
    """
    from pyspark import TaskContext

    made: dict[tuple[int, int], np.ndarray] = {}
    for rb in batches:
        y, part, h = rb.column(1).to_numpy(zero_copy_only=False), rb.column(2).to_numpy(), rb.column(3).to_numpy()
        x, start = _matrix(rb.column(4), plan.width, np.uint8), _matrix(rb.column(5), plan.n_models, np.float64)
        for m, wanted in plan.wanted.items():
            local = np.full(len(plan.arrays[m][0]), -1, dtype=np.int64)
            local[wanted] = np.arange(len(wanted))
            at = local[plan.nodes(x, m)]
            rows = np.flatnonzero((at >= 0) & plan.own_rows(part, h, m)[0])
            if not len(rows):
                continue
            prob = sigmoid(plan.margins(start[rows], x[rows], m))
            w = np.where(y[rows] == 1, plan.weights[m], 1.0)
            g, hess, at = w * (prob - y[rows]), w * prob * (1 - prob), at[rows]
            for f in plan.chosen[m].tolist():
                size = plan.sizes[f]
                if size < 2:
                    continue
                place, n = at * size + x[rows, f], len(wanted) * size
                own = np.stack([np.bincount(place, weights=g, minlength=n), np.bincount(place, weights=hess, minlength=n), np.bincount(place, minlength=n).astype(np.float64)])
                key = (m, f)
                made[key] = own if key not in made else made[key] + own
    task = TaskContext.get().partitionId()
    rows, size = [], 0

    def batch():
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["m", "f", "part", "at", "sums"])

    for (m, f), sums in made.items():
        at = np.flatnonzero(sums[2])
        rows.append((m, f, task, at.astype(np.int32).tobytes(), sums[:, at].tobytes()) if 2 * len(at) < sums.shape[1] else (m, f, task, b"", sums.tobytes()))
        size += len(rows[-1][4])
        if size > TOGETHER:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


def _best(batches, plan: _Pass):
    """Rows sorted by (m, f, part): sums of a feature meet here in one order, and its best cut per leaf is found."""
    best: dict[tuple[int, int], tuple] = {}

    def settle(m, f, sums):
        size = plan.sizes[f]
        below = sums.reshape(3, -1, size).cumsum(2)  # each kind of sum side by side: many times faster than three in turn
        left, total = np.moveaxis(below[:, :, :-1], 0, -1), np.moveaxis(below[:, :, -1:], 0, -1)
        gain = split_gain(left, total, plan.p)
        at = gain.argmax(1)
        for k, node in enumerate(plan.wanted[m]):
            g = float(gain[k, at[k]])
            if g > 0 and ((m, node) not in best or (g, -f) > (best[m, node][0], -best[m, node][1])):
                best[m, node] = (g, f, int(at[k]), left[k, at[k]].tolist())

    now, held = None, None
    for rb in batches:
        for m, f, at, sums in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(3), rb.column(4)):
            at, own = np.frombuffer(at.as_py(), dtype=np.int32), np.frombuffer(sums.as_py(), dtype=np.float64).reshape(3, -1)
            if (m, f) != now:
                if now:
                    settle(*now, held)
                now, held = (m, f), np.zeros((3, len(plan.wanted[m]) * plan.sizes[f]))
            held[:, at if len(at) else slice(None)] += own
    if now:
        settle(*now, held)
    if best:
        rows = [(m, node, *v) for (m, node), v in best.items()]
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["m", "node", "gain", "f", "cut", "left"])


def _auc(counts: np.ndarray) -> float:
    """From counts (negatives, positives) by rising score; ties count half.  NaN where a class is missing."""
    neg, pos = counts
    below = np.cumsum(neg) - neg
    pairs = neg.sum() * pos.sum()
    return float((pos * (below + neg / 2)).sum() / pairs) if pairs else math.nan


def train(df: DataFrame, key: str, label: str, columns: list[str], fold: str = "fold", k: int = 5, params: Params | None = None) -> list[Model]:
    """A model per fold, fitted on the labelled rows of the other folds; with ``k`` = 1 one model on all of them.

    ``fold`` runs from 0 to k - 1; rows whose label or fold is null train nothing.  Of each training set a tenth, by the
    hash of the key, is kept aside to end the boosting by its AUC; the trees up to the best round stay.  Positives weigh
    as much as negatives in all.  Values must be numbers; NaN goes left.  A fold whose training rows have one class gives a
    model without trees.
    """
    p = params or Params()
    spark = df.sparkSession
    importable(spark)
    tables = Tables(spark)
    known = df.filter(F.col(label).isNotNull() & F.col(fold).isNotNull())
    cuts = bounds(known, columns, p.bins)
    part = F.col(fold).cast("int") if k > 1 else F.lit(1)
    src = known.select(F.lit(0).alias("k"), (F.col(label) == 1).cast("double").alias("y"), part.alias("part"), F.xxhash64(key).alias("h"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))

    classes = {r[0]: (r[1] or 0.0, r[2]) for r in src.groupBy("part").agg(F.sum("y"), F.count(F.lit(1))).collect()}  # a row a fold
    models, weights = [], []
    for m in range(k):
        pos = sum(v[0] for f, v in classes.items() if f != m)
        n = sum(v[1] for f, v in classes.items() if f != m)
        weights.append((n - pos) / max(pos, 1.0))
        models.append(Model(0.0 if 0 < pos < n else (-30.0 if pos == 0 else 30.0), columns=columns))
    base = [m.base for m in models]

    def binned(batches):
        for rb in batches:
            x = to_bins(_matrix(rb.column(4), len(columns), np.float64), cuts)
            rows = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([*rb.columns[:4], rows, pa.array([base] * len(x), pa.list_(pa.float64()))], names=["k", "y", "part", "h", "x", "margin"])

    schema = "k int, y double, part int, h long, x binary, margin array<double>"
    cores = spark.sparkContext.defaultParallelism  # the search for cuts is far more work than its bytes tell
    tasks = max(1, min(cores, sum(n for _, n in classes.values()) // TASK_ROWS))
    # In the order of the hash, so that sums are made in one order whatever the files were.
    rows = tables.keep(src.mapInArrow(binned, schema).repartition(tasks, "h").sortWithinPartitions("h"), "binned")
    live = {m for m in range(k) if abs(base[m]) < 1}
    since: dict[int, list[Tree]] = {m: [] for m in range(k)}  # trees that the written margins lack
    best = {m: (-1.0, 0) for m in range(k)}
    for round_ in range(p.rounds + 1):
        plan = _Pass(p, round_, weights, {m: since[m] for m in sorted(live)}, {}, {}, len(columns), cuts, k)
        sums, counts = np.zeros((k, 3)), np.zeros((k, 2, AUC_BINS))
        for m, s, place, negative, positive in sorted(rows.mapInArrow(lambda it: _totals(it, plan), "m int, s array<double>, place array<int>, negative array<double>, positive array<double>").collect()):
            sums[m] += s
            np.add.at(counts[m][0], place, negative)
            np.add.at(counts[m][1], place, positive)
        for m in sorted(live):
            auc = _auc(counts[m])
            models[m].aucs.append(auc)
            if math.isnan(auc) or auc > best[m][0] + 1e-12:  # without both classes aside nothing can end the boosting
                best[m] = (-1.0 if math.isnan(auc) else auc, round_)
            if round_ - best[m][1] >= p.patience:
                live.discard(m)
        if not live or round_ == p.rounds:
            break
        growths = {m: Growth(sums[m], chosen_features(len(columns), p.features, p.seed, m, round_), p) for m in sorted(live)}
        while wanted := {m: opened for m, g in growths.items() if (opened := g.open())}:
            plan = _Pass(p, round_, weights, {m: since[m] for m in sorted(live)}, growths, wanted, len(columns), cuts, k)
            met = rows.mapInArrow(lambda it: _histograms(it, plan), "m int, f int, part int, at binary, sums binary").repartition(cores, "m", "f").sortWithinPartitions("m", "f", "part")
            found = met.mapInArrow(lambda it: _best(it, plan), "m int, node int, gain double, f int, cut int, left array<double>").collect()
            for m, node, gain, f, cut, left in found:
                growths[m].offer(node, gain, f, cut, tuple(left))
            for m, opened in wanted.items():
                for node in opened:
                    if growths[m].nodes[node].gain is None:
                        growths[m].nodes[node].gain = 0.0
        for m, g in growths.items():
            tree = g.tree(cuts)
            models[m].trees.append(tree)
            since[m].append(tree)
            if len(tree.feature) == 1 and tree.value[0] == 0:
                live.discard(m)
        if (round_ + 1) % REWRITE == 0:
            rows, since = _rewritten(tables, rows, since, len(columns), schema), {m: [] for m in range(k)}
    for m, model in enumerate(models):
        model.trees = model.trees[: best[m][1]]
    tables.drop_all()
    return models


def _rewritten(tables, rows, since, width, schema):
    def run(batches):
        for rb in batches:
            x, margin = _matrix(rb.column(4), width, np.uint8), _matrix(rb.column(5), len(since), np.float64).copy()
            for m, trees in since.items():
                for t in trees:
                    margin[:, m] += t.value[t.leaf_of(x, t.bin)]
            yield pa.RecordBatch.from_arrays([*rb.columns[:5], pa.array(margin.tolist(), pa.list_(pa.float64()))], names=rb.schema.names)

    out = tables.keep(rows.mapInArrow(run, schema), "margins")
    tables.drop(rows)
    return out


# --- scores, importance, Shapley values ---------------------------------------------------------------------------


def _inputs(df: DataFrame, key: str, columns: list[str], *more: Column) -> DataFrame:
    importable(df.sparkSession)
    return df.select(F.col(key).alias("key"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), *more)


def score(df: DataFrame, key: str, models: list[Model], fold: str = "fold") -> DataFrame:
    """(key, fold, score): rows of a fold by its own model, which has not seen them; rows without one by the mean of all."""
    columns = models[0].columns

    def run(batches):
        for rb in batches:
            x, part = _matrix(rb.column(1), len(columns), np.float64), rb.column(2).to_pylist()
            probs = np.stack([sigmoid(m.margin(x)) for m in models], axis=1) if len(x) else np.zeros((0, len(models)))
            out = [float(probs[i].mean() if f is None else probs[i, f]) for i, f in enumerate(part)]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(2), pa.array(out, pa.float64())], names=["key", "fold", "score"])

    kind = df.schema[key].dataType.simpleString()
    return _inputs(df, key, columns, F.col(fold).cast("int").alias("fold")).mapInArrow(run, f"key {kind}, fold int, score double").withColumnRenamed("key", key)


def importance(models: list[Model]) -> dict[str, float]:
    """Summed gain of the splits on each feature, mean over the models."""
    out = dict.fromkeys(models[0].columns, 0.0)
    for m in models:
        for t in m.trees:
            for f, g in zip(t.feature.tolist(), t.gain.tolist()):
                if f >= 0:
                    out[m.columns[f]] += g / len(models)
    return out


def permutation_importance(df: DataFrame, key: str, label: str, model: Model, columns: list[str] | None = None, seed: int = 1, buckets: int = 64) -> DataFrame:
    """(feature, auc, auc_loss): what the model's AUC loses when one feature is shuffled, for each of ``columns`` at once.

    A feature is shuffled by giving each row the value of the row before it in the order of a hash, within buckets, so that
    no task orders all rows; a bucket's first row takes its last one's.  A row is then scored once as it is and
    once for each feature, and all AUCs come from one pass.  Rows with a null label do not count.
    """
    importable(df.sparkSession)
    names = columns or model.columns
    order = F.xxhash64(F.col(key), F.lit(seed))
    rows = df.filter(F.col(label).isNotNull()).withColumns({"__b": F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(buckets)), "__h": order})
    up = Window.partitionBy("__b").orderBy("__h", key)
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = F.when(F.row_number().over(up) > 1, F.lag("z").over(up)).otherwise(F.last("z").over(whole))
    rows = rows.select("__b", "__h", key, F.col(label).cast("int").alias("y"), F.array(*[F.col(c).cast("double") for c in model.columns]).alias("x"), F.array(*[F.col(c).cast("double") for c in names]).alias("z"))
    src = rows.select("y", "x", moved.alias("z"))
    at = [model.columns.index(c) for c in names]

    def run(batches):
        for rb in batches:
            x, z = _matrix(rb.column(1), len(model.columns), np.float64), _matrix(rb.column(2), len(at), np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(["" for _ in range(len(x))]), rb.column(0), pa.array(model.margin(x))], names=["feature", "y", "score"])
            for j, f in enumerate(at):
                own = x.copy()
                own[:, f] = z[:, j]
                yield pa.RecordBatch.from_arrays([pa.array([names[j]] * len(x)), rb.column(0), pa.array(model.margin(own))], names=["feature", "y", "score"])

    aucs = stats.auc_by(src.mapInArrow(run, "feature string, y int, score double"), "score", "y", "feature")
    base = F.max(F.when(F.col("feature") == "", F.col("auc"))).over(Window.partitionBy())  # one row a feature
    return aucs.withColumn("auc_loss", base - F.col("auc")).filter("feature <> ''")


def _paths(tree: Tree) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """For each leaf its value and, per feature on its path, (feature, low, high, share): values in (low, high] stay on
    the path, and ``share`` is the product of the covers that do at the feature's splits."""
    out = []
    stack: list[tuple[int, dict]] = [(0, {})]
    while stack:
        k, path = stack.pop()
        f = int(tree.feature[k])
        if f < 0:
            out.append((float(tree.value[k]), [(g, *v) for g, v in path.items()]))
            continue
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        cut = float(tree.threshold[k])
        for child, lo, hi in ((int(tree.left[k]), low, min(high, cut)), (int(tree.right[k]), max(low, cut), high)):
            stack.append((child, path | {f: (lo, hi, share * float(tree.cover[child] / tree.cover[k]))}))
    return out


def shapley(tree: Tree, x: np.ndarray) -> tuple[float, np.ndarray]:
    """(expected value, values (rows, features)): Shapley values of a tree whose absent features follow its covers.

    A leaf's share of the game is a product over the d features of its path: z, the covers' share, for absent ones and
    o, whether the row stays on the path, for present ones.  A feature's Shapley value is then
    value * (o - z) * integral over t in (0, 1) of the product over the others of ((1 - t) z + t o), as the weight of a
    coalition of s others is the Beta integral of t^s (1 - t)^(d - 1 - s).  The integrand is a polynomial of
    degree d - 1, which Gauss' rule with (d + 1) // 2 points sums exactly: d * d products a leaf, no coalitions.
    """
    out, expected = np.zeros(x.shape), 0.0
    low_first = np.where(np.isnan(x), -np.inf, x)  # NaN goes left at every split
    for value, path in _paths(tree):
        d = len(path)
        expected += value * math.prod(z for *_, z in path)
        if not d:
            continue
        t, w = np.polynomial.legendre.leggauss((d + 1) // 2)
        t, w = (t + 1) / 2, w / 2
        on = [((low_first[:, f] > lo) | ((lo == -math.inf) & (low_first[:, f] == -np.inf))) & (low_first[:, f] <= hi) for f, lo, hi, _ in path]
        term = [((1 - t) * z)[:, None] + t[:, None] * o[None, :] for o, (*_, z) in zip(on, path)]
        after = [np.ones_like(term[0])]
        for a in term[:0:-1]:
            after.append(after[-1] * a)
        before = np.ones_like(term[0])
        for i, (f, _, _, z) in enumerate(path):
            out[:, f] += value * (on[i] - z) * (w @ (before * after[d - 1 - i]))
            before = before * term[i]
    return expected, out


def attributions(df: DataFrame, key: str, model: Model) -> DataFrame:
    """(key, bias, margin, a column per feature): exact Shapley values of each row's margin; bias plus values is the margin.

    All rows are explained, in batches on the executors.  Values are at most rounding apart from zero for features that no
    tree uses.
    """
    columns = model.columns

    def run(frames):
        for pdf in frames:
            x = np.stack(pdf["x"]).astype(np.float64) if len(pdf) else np.zeros((0, len(columns)))
            bias, total = model.base, np.zeros(x.shape)
            for t in model.trees:
                e, own = shapley(t, x)
                bias, total = bias + e, total + own
            yield pd.DataFrame({"key": pdf["key"], "bias": bias, "margin": model.margin(x)} | {f"c{i}": total[:, i] for i in range(len(columns))})

    kind = df.schema[key].dataType.simpleString()
    made = _inputs(df, key, columns).mapInPandas(run, f"key {kind}, bias double, margin double, " + ", ".join(f"c{i} double" for i in range(len(columns))))
    return made.select(F.col("key").alias(key), "bias", "margin", *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
