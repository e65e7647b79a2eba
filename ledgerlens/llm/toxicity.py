"""Toxicity scores by weak supervision.

1. On a bounded sample of labelled texts, words and word edges (prefixes and suffixes of 4 to 6 letters)
   that toxic texts hold more often than chance are found by a binomial tail test, with Benjamini and
   Hochberg's false-discovery control over all that were tried.
2. Each of them is a voter of its own, a lexicon voter (word) or a pattern voter (edge), that votes toxic
   where it occurs; the given label is one more, fallible, voter.  A generative model with the true label
   latent is fitted by EM: every voter has rates of voting on toxic and on clean texts, given the vote of the
   one other voter that it depends on most.  These dependencies form a forest, the one with the most
   conditional mutual information, so that a word and its own edges are not counted as several witnesses.
   EM starts from how many voters speak, not from the label; like-minded ones share a vote.
3. A linear classifier (logistic regression on the presence of words and edges) is trained on the
   posterior labels; its bias is then set where the two classes part best.  A word that occurs often
   counts once, so a text's length does not move its score.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, least_hashed, ship_package

SAMPLE = 8000  # labelled texts learned from, those of least hashed id
EDGES = (4, 5, 6)
RATE = 0.05  # of false discoveries among voters
PRECISION = 0.9  # a voter is right on so many of the labelled texts that it speaks on, at least
_WORD = re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    out = [word]
    for n in EDGES:
        if len(word) > n:
            out += [word[:n] + "-", "-" + word[-n:]]
    return out


@cache
def _log_factorials(n: int) -> np.ndarray:
    return np.append(0.0, np.cumsum(np.log(np.arange(1, n + 1))))


def log_tail(n: int, k: int, p: float) -> float:
    """log P(Binomial(n, p) >= k), all terms of the sum."""
    f = _log_factorials(1 << max(4, int(n).bit_length()))
    i = np.arange(k, n + 1)
    terms = f[n] - f[i] - f[n - i] + i * log(p) + (n - i) * log(1 - p)
    top = terms.max()
    return float(top + np.log(np.exp(terms - top).sum()))


def text_features(text: str | None) -> set[str]:
    return {f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)}


def significant(tested: list[tuple[str, int, int, float]], tried: int, rate: float = RATE) -> list[str]:
    """Of (feature, texts, toxic texts, log p), those that Benjamini and Hochberg's rule accepts among ``tried`` tests."""
    ordered = sorted((q, -k, f) for f, _, k, q in tested)
    last = max((i for i, (q, _, _) in enumerate(ordered, 1) if q <= log(rate * i / max(1, tried))), default=0)
    return [f for _, _, f in sorted(ordered[:last], key=lambda x: (x[1], x[2]))]


class Votes:
    """A sparse table of votes: ``doc`` and ``voter`` name the votes for toxic."""

    def __init__(self, rows: list[list[int]], voters: int):
        self.n, self.voters = len(rows), voters
        self.doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.voter = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=len(self.doc))
        self.first = np.append(0, np.cumsum([len(r) for r in rows]))
        by = np.argsort(self.voter, kind="stable")
        self.docs_of = np.split(self.doc[by], np.cumsum(np.bincount(self.voter, minlength=voters))[:-1]) if voters else []
        self.key = self.doc * max(1, voters) + self.voter  # sorted, as rows are

    def together(self, j: int, weight: np.ndarray) -> np.ndarray:
        """Weight of the texts on which voter j and each voter both vote."""
        docs = self.docs_of[j]
        sizes = self.first[docs + 1] - self.first[docs]
        at = np.repeat(self.first[docs] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum()) if len(docs) else np.empty(0, np.int64)
        return np.bincount(self.voter[at], weights=np.repeat(weight[docs], sizes), minlength=self.voters)


def shares(v: Votes) -> np.ndarray:
    """What a voter's vote counts at first: one, shared with the voters that speak with it, by Jaccard similarity."""
    n, all_, out = np.bincount(v.voter, minlength=v.voters), np.ones(v.n), np.ones(v.voters)
    for j in range(v.voters):
        both = v.together(j, all_)
        out[j] = 1 / max(1.0, float((both / np.maximum(n[j] + n - both, 1)).sum()))
    return out


def dependencies(v: Votes, post: np.ndarray) -> np.ndarray:
    """Each voter's parent (-1: none) in the tree of most mutual information given the latent label.

    Prim's algorithm, with one voter's row of pair counts at a time.  An edge whose information does not pay
    for its two further rates (Bayesian information criterion) is left out.
    """
    parent, best, link = np.full(v.voters, -1), np.full(v.voters, -np.inf), np.full(v.voters, -1)
    left = np.ones(v.voters, dtype=bool)
    sides = [(post, post.sum() + 1.0), (1 - post, (1 - post).sum() + 1.0)]
    alone = [np.bincount(v.voter, weights=w[v.doc], minlength=v.voters) for w, _ in sides]

    def information(j: int) -> np.ndarray:
        out = np.zeros(v.voters)
        for (w, total), one in zip(sides, alone):
            both, a, b = v.together(j, w), one[j] + 0.5, one + 0.5
            both = np.minimum(both + 0.25, np.minimum(a, b))
            for cell, x, y in ((both, a, b), (a - both, a, total - b), (b - both, total - a, b), (total - a - b + both, total - a, total - b)):
                out += np.where(cell > 1e-12, cell * np.log(np.maximum(cell, 1e-12) * total / np.maximum(x * y, 1e-12)), 0.0)
        return out

    now = 0
    for _ in range(v.voters):
        left[now] = False
        gain = information(now)
        better = left & (gain > best)
        best[better], link[better] = gain[better], now
        if not left.any():
            break
        now = int(np.where(left, best, -np.inf).argmax())
        parent[now] = link[now] if best[now] > log(v.n + 2.0) else -1
    return parent


def label_model(rows: list[list[int]], voters: int, label: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, rates on toxic, rates on clean, parents): EM over the votes and the given label.

    ``rows`` lists each text's voters.  The rates returned are those without regard to parents; inside,
    each voter's rates are conditional on its parent's vote and the latent label.
    """
    v = Votes(rows, voters)
    if not v.n:
        return np.empty(0), np.empty(0), np.empty(0), np.empty(0, dtype=int)
    said = np.bincount(v.doc, weights=shares(v)[v.voter], minlength=v.n)
    post = np.where(said > 0, 1 - 0.3**said, 0.02)
    y = label.astype(float)
    kids = parent = None
    for turn in range(rounds):
        if turn in (0, 6, 12):  # the structure, from the first posterior and again from settled ones
            parent = dependencies(v, post)
            kids = [np.flatnonzero(parent == j) for j in range(voters)]
            sizes = np.array([len(k) for k in kids], dtype=np.int64)
            flat = np.concatenate(kids) if voters else np.empty(0, np.int64)
            start = np.append(0, np.cumsum(sizes)[:-1])
            # (doc, voter) pairs whose parent votes, whether they vote or not.
            count = sizes[v.voter]
            under_doc = np.repeat(v.doc, count)
            under = flat[np.repeat(start[v.voter] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())] if count.sum() else np.empty(0, np.int64)
            both = np.isin(under_doc * max(1, voters) + under, v.key)
            alone = ~np.isin(v.key, (under_doc * max(1, voters) + under)[both])
        # M: P(vote | parent's vote, label) with a weak prior towards silence.
        rates, total = {}, {}
        for c, w in ((1, post), (0, 1 - post)):
            with_parent = np.bincount(under, weights=w[under_doc], minlength=voters)
            yes1 = np.bincount(under[both], weights=w[under_doc[both]], minlength=voters)
            yes0 = np.bincount(v.voter[alone], weights=w[v.doc[alone]], minlength=voters)
            rates[c] = ((yes0 + 0.1) / (w.sum() - with_parent + 1.0), (yes1 + 0.5) / (with_parent + 1.0))
            total[c] = (yes0 + yes1 + 0.1) / (w.sum() + 1.0)
        rates = {c: [np.clip(r, 1e-6, 1 - 1e-6) for r in pair] for c, pair in rates.items()}
        hit = [((w * y).sum() + a) / (w.sum() + a + b) for w, a, b in ((post, 9, 1), (1 - post, 1, 19))]
        prior = np.clip(post.mean(), 1e-4, 1 - 1e-4)
        # E: evidence of silence without a silent parent's change, then what votes and parents' votes change.
        yes = [np.log(rates[1][a] / rates[0][a]) for a in (0, 1)]
        no = [np.log((1 - rates[1][a]) / (1 - rates[0][a])) for a in (0, 1)]
        logit = np.full(v.n, np.log(prior / (1 - prior)) + no[0].sum())
        logit += np.bincount(v.doc[alone], weights=(yes[0] - no[0])[v.voter[alone]], minlength=v.n)
        logit += np.bincount(under_doc, weights=np.where(both, yes[1][under], no[1][under]) - no[0][under], minlength=v.n)
        logit += y * np.log(hit[0] / hit[1]) + (1 - y) * np.log((1 - hit[0]) / (1 - hit[1]))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        moved, post = np.abs(new - post).max(), new
        if moved < 1e-6 and turn > 12:
            break
    return post, total[1], total[0], parent


def logistic(rows: list[list[int]], n: int, y: np.ndarray, l2: float = 0.02, rounds: int = 400, rate: float = 0.2) -> tuple[np.ndarray, float]:
    """Weights and bias on soft labels, by full-batch Adam; positive and negative texts weigh alike."""
    idx = np.fromiter((i for r in rows for i in r), dtype=np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(n), 0.0
    m = [np.zeros(n + 1), np.zeros(n + 1)]
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    c = np.where(y >= 0.5, 0.5 / share, 0.5 / (1 - share)) / len(y)
    for step in range(1, rounds + 1):
        z = np.bincount(doc, weights=w[idx], minlength=len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * c
        grad = np.append(np.bincount(idx, weights=g[doc], minlength=n) + l2 / len(y) * w, g.sum())
        m[0], m[1] = 0.9 * m[0] + 0.1 * grad, 0.999 * m[1] + 0.001 * grad**2
        move = rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def boundary(z: np.ndarray, y: np.ndarray) -> float:
    """The place among scores z with the least sum of both classes' error rates, in the middle of its gap;
    of equally good places the one in the widest gap."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order] >= 0.5
    if y.all() or not y.any():
        return 0.0
    missed = np.cumsum(y) / y.sum()
    wrong = (np.sum(~y) - np.cumsum(~y)) / np.sum(~y)
    gap = np.append(np.diff(z), 0.0)
    errors = np.where(gap > 1e-9, missed + wrong, np.inf)
    if not np.isfinite(errors).any():
        return 0.0
    i = max(np.flatnonzero(errors <= errors.min() + 1e-12), key=lambda i: gap[i])
    return float((z[i] + z[i + 1]) / 2)


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.seen: dict[str, tuple[str, ...]] = {}

    def hits(self, word: str) -> tuple[str, ...]:
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) > 500_000:
                self.seen.clear()
            got = self.seen[word] = tuple(f for f in word_features(word) if f in self.weights)
        return got

    def score(self, text: str | None) -> float:
        found = {f for w in set(_WORD.findall((text or "").lower())) for f in self.hits(w)}
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + exp(-max(-30.0, min(30.0, z))))


def fit(rows: list[list[int]], toxic: list[int], lexicon: list[str]) -> Model:
    """A model from texts given as places in ``lexicon``, with their labels."""
    if not rows:
        return Model({}, -30.0)
    post, _, _, _ = label_model(rows, len(lexicon), np.array(toxic, dtype=float))
    w, b = logistic(rows, len(lexicon), post)
    b -= boundary(np.array([w[r].sum() + b for r in rows]), post)
    return Model({f: float(w[i]) for i, f in enumerate(lexicon)}, b)


def _count(batches, texts_at_once=300):
    """(f, n, k): texts and toxic texts of some hundred rows that hold each feature."""
    n, k, held = Counter(), Counter(), 0

    def rows():
        names = list(n)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([n[f] for f in names], pa.int64()), pa.array([k[f] for f in names], pa.int64())], names=["f", "n", "k"]
        )

    for rb in batches:
        for text, y in zip(rb.column(1), rb.column(2)):
            found = text_features(text.as_py())
            n.update(found)
            if y.as_py() == 1:
                k.update(found)
            held += 1
            if held == texts_at_once or len(n) > 400_000:
                yield rows()
                n, k, held = Counter(), Counter(), 0
    if n:
        yield rows()


def _hold(batches, lexicon):
    at = {f: i for i, f in enumerate(lexicon)}
    for rb in batches:
        found = [sorted(at[f] for f in text_features(t.as_py()) if f in at) for t in rb.column(1)]
        yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(2), pa.array(found, pa.list_(pa.int32()))], names=["id", "y", "held"])


def _test(batches, share, rate):
    """(f, n, k, q): features that most of their texts being toxic speaks for, with log p at most log ``rate``."""
    p = min(max(share, 1e-6), 1 - 1e-6)
    for rb in batches:
        n, k = (rb.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
        worth = np.flatnonzero((k >= 3) & (k >= PRECISION * n))
        q = np.array([log_tail(int(n[i]), int(k[i]), p) for i in worth])
        keep = q <= log(rate) if len(worth) else np.empty(0, bool)
        yield pa.RecordBatch.from_arrays([*[rb.column(c).take(pa.array(worth[keep])) for c in (0, 1, 2)], pa.array(q[keep], pa.float64())], names=["f", "n", "k", "q"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col="doc_id", text_col="text", label_col="toxic", *, sample: int = SAMPLE, rate: float = RATE) -> Model:
    """A model fitted on at most ``sample`` labelled rows that ``learn``, a condition on the id, lets through.

    Whole texts are read, and counting and testing features runs on the executors; the driver gets the
    features whose own p-value is at most ``rate`` (no other can be accepted) and, for each text of the sample,
    its places in the lexicon.  An id labelled twice counts as toxic if one of its labels does; of an id's several
    texts the least is learned from.  No labels:
    a model that calls nothing toxic.
    """
    ship_package(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    chosen = labels.filter(learn & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__tx_id")).agg(F.max(label_col).cast("int").alias("__tx_y"))
    chosen = least_hashed(chosen, ["__tx_id", "__tx_y"], sample)  # the bound of the broadcast
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    own = src.join(F.broadcast(chosen), src["id"] == chosen["__tx_id"])
    own = own.groupBy(F.col("id").cast("long").alias("id"), F.col("__tx_y").alias("y")).agg(F.min("t").alias("t"))  # ``sample`` rows at most
    own = scratch.keep(own.select("id", "t", "y"), "sample")
    counts = scratch.keep(own.mapInArrow(_count, "f string, n long, k long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "counts")
    share = own.agg(F.avg(F.when(F.col("y") == 1, 1.0).otherwise(0.0))).first()[0] or 0.0
    tested = counts.filter("k >= 3 and 2 * k >= n").mapInArrow(lambda it: _test(it, share, rate), "f string, n long, k long, q double").collect()
    lexicon = significant([tuple(r) for r in tested], counts.count(), rate)
    rows = own.mapInArrow(lambda it: _hold(it, lexicon), "id long, y int, held array<int>").collect()
    rows.sort(key=lambda r: (r[0], r[2]))
    scratch.drop(own, counts)
    return fit([r[2] for r in rows], [int(r[1] == 1) for r in rows], lexicon)


def _score(batches, model):
    for rb in batches:
        scores = [model.score(t) for t in rb.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*[rb.column(k) for k in range(rb.num_columns)], pa.array(scores, pa.float64())], names=[*rb.schema.names, "score"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with ``out_col``, the probability of toxicity, for whole texts; null and empty texts get one too.

    Other columns pass through; one named ``out_col`` is replaced.  Repeated rows score alike.
    """
    ship_package(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text_col, out_col)]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest") if rest else F.struct(F.lit(0)).alias("rest"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["rest"].dataType.simpleString()
    out = src.mapInArrow(lambda it: _score(it, model), f"rest {kind}, text string, score double")
    cols = {c: F.col(f"rest.`{c}`").alias(c) for c in rest} | {text_col: F.col("text").alias(text_col)}
    return out.select(*[cols[c] for c in docs.columns if c in cols], F.col("score").alias(out_col))
