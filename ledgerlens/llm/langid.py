"""Language identification by a byte convolutional network in numpy.

Every byte value of the training texts is a class of its own (letters A-Z folded); values that they never
hold share one, which no training could tell apart, and padding has one.  Filters of widths 2 to 5 run over
windows of fixed length; each filter's rectified maximum over the window feeds a softmax.  At prediction,
convolutions are sums of table rows: a filter bank's response to a pair of classes is looked up, which is
the same linear map.  A text is cut into consecutive windows over all its bytes; its distribution is the
mean over windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, least_hashed, ship_package

WIDTHS, WINDOW = (2, 3, 4, 5), 256
PAD, UNSEEN = 255, 254  # at most 230 byte values are left once A-Z are folded
SAMPLE = 2400  # labelled texts that the network is fitted on, those of least hashed id
LEARNED = 30_000  # windows of these texts that the driver gets, those of least hash
CHECK, PATIENCE, STEPS = 150, 3, 6000  # steps between looks at the loss, looks without gain before the end, steps at most
NO_LANGUAGE = "und"


def byte_classes(texts: list[bytes]) -> np.ndarray:
    """The class of each byte value: seen ones are numbered by frequency."""
    fold = np.arange(256)
    fold[65:91] += 32
    n = np.zeros(256, dtype=np.int64)
    for t in texts:
        n += np.bincount(fold[np.frombuffer(t, dtype=np.uint8)], minlength=256)
    table = np.full(256, UNSEEN, dtype=np.uint8)
    for k, b in enumerate(b for b in np.argsort(-n, kind="stable") if n[b]):
        table[b] = k
    return table[fold]


def windows(data: bytes, table: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """The text's classes as rows of ``length``, the last one padded."""
    c = table[np.frombuffer(data, dtype=np.uint8)]
    n = max(1, -(-len(c) // length))
    out = np.full(n * length, PAD, dtype=np.uint8)
    out[: len(c)] = c
    return out.reshape(n, length)


class Network:
    def __init__(self, langs: list[str], table: np.ndarray, filters: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs, self.table, self.filters = langs, table, filters
        # The two special classes come right after the seen ones inside.
        seen = len(set(table.tolist()) - {UNSEEN})
        self.classes = seen + 2
        self.inner = np.arange(256, dtype=np.intp)
        self.inner[UNSEEN], self.inner[PAD] = seen, seen + 1
        self.w = {k: rng.normal(0, 0.3, (k, self.classes, filters)).astype(np.float32) for k in WIDTHS}
        self.b = {k: np.zeros(filters, dtype=np.float32) for k in WIDTHS}
        self.v = rng.normal(0, 0.1, (filters * len(WIDTHS), len(langs))).astype(np.float32)
        self.c = np.zeros(len(langs), dtype=np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, batch: int = 32, rate: float = 0.01, seed: int = 6) -> None:
        """Adam on the softmax loss; the gradient of a maximum goes to its argument alone.

        A tenth of the windows is held back.  Training ends when their loss has not fallen by a hundredth of itself for
        PATIENCE looks, whatever the number of windows, and the best weights seen are kept.
        """
        rng, f = np.random.default_rng(seed), self.filters
        order = rng.permutation(len(x))
        aside = order[: max(1, min(len(x) // 10, 1000))]
        order = order[len(aside) :] if len(x) > 1 else order
        n = len(order)
        names = [("w", k) for k in WIDTHS] + [("b", k) for k in WIDTHS] + [("v", None), ("c", None)]
        get = lambda s, k: getattr(self, s) if k is None else getattr(self, s)[k]
        m1, m2 = ({p: np.zeros_like(get(*p)) for p in names} for _ in range(2))
        best, kept, since = np.inf, None, 0
        for step in range(1, STEPS + 1):
            lo = (step - 1) * batch % n
            if lo < batch:
                order = rng.permutation(order)
            at = order[lo : lo + batch]
            xb, yb = self.inner[x[at]], y[at]
            hidden, places = [], {}
            for k in WIDTHS:
                span = xb.shape[1] - k + 1
                z = self.w[k][0][xb[:, :span]]
                for j in range(1, k):
                    z += self.w[k][j][xb[:, j : j + span]]
                places[k] = z.argmax(axis=1)
                hidden.append(np.maximum(np.take_along_axis(z, places[k][:, None, :], axis=1)[:, 0] + self.b[k], 0))
            h = np.concatenate(hidden, axis=1)
            logits = h @ self.v + self.c
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            grads = {("v", None): h.T @ p, ("c", None): p.sum(axis=0)}
            back = (p @ self.v.T) * (h > 0)
            for i, k in enumerate(WIDTHS):
                g = back[:, i * f : (i + 1) * f]
                grads["b", k] = g.sum(axis=0)
                gw = np.zeros_like(self.w[k])
                rows = np.arange(len(xb))[:, None]
                for j in range(k):
                    np.add.at(gw[j], (xb[rows, places[k] + j], np.arange(f)[None, :]), g)
                grads["w", k] = gw
            for q in names:
                m1[q] = 0.9 * m1[q] + 0.1 * grads[q]
                m2[q] = 0.999 * m2[q] + 0.001 * grads[q] ** 2
                get(*q)[...] -= rate * (m1[q] / (1 - 0.9**step)) / (np.sqrt(m2[q] / (1 - 0.999**step)) + 1e-8)
            if step % CHECK == 0:
                self.prepare()
                loss = -float(np.log(np.maximum(self.predict(x[aside])[np.arange(len(aside)), y[aside]], 1e-12)).mean())
                since = 0 if loss < 0.99 * best else since + 1
                if loss < best:
                    best, kept = loss, [get(*q).copy() for q in names]
                if since == PATIENCE or loss < 1e-4:
                    break
        for q, w in zip(names, kept or []):
            get(*q)[...] = w

    def prepare(self) -> None:
        """Response tables of pairs of classes: two for widths 4 and 5, one for 2 and 3."""
        pair = lambda k, i: (self.w[k][i][:, None, :] + self.w[k][i + 1][None, :, :]).reshape(-1, self.filters)
        self.pairs = {(k, i): pair(k, i) for k, i in ((2, 0), (3, 0), (4, 0), (4, 2), (5, 0), (5, 2))}

    def predict(self, x: np.ndarray, chunk: int = 64) -> np.ndarray:
        """Language probabilities of each window."""
        out, t = np.empty((len(x), len(self.langs)), dtype=np.float64), self.pairs
        for lo in range(0, len(x), chunk):
            c = self.inner[x[lo : lo + chunk]]
            p = c[:, :-1] * self.classes + c[:, 1:]
            h = []
            for k in WIDTHS:
                span = c.shape[1] - k + 1
                z = t[k, 0][p[:, :span]]
                if k >= 4:
                    z += t[k, 2][p[:, 2 : 2 + span]]
                if k % 2:
                    z += self.w[k][k - 1][c[:, k - 1 :]]
                h.append(np.maximum(z.max(axis=1) + self.b[k], 0))
            logits = np.concatenate(h, axis=1) @ self.v + self.c
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[lo : lo + chunk] = e / e.sum(axis=1, keepdims=True)
        return out


def _cut(batches):
    """(lang, h, k, w): the windows of each text as bytes; h stands for the text."""
    for rb in batches:
        for lang, h, text in zip(rb.column(0), rb.column(1), rb.column(2)):
            data = text.as_py()
            for lo in range(0, len(data), WINDOW << 12):
                part = [data[i : i + WINDOW] for i in range(lo, min(lo + (WINDOW << 12), len(data)), WINDOW)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang.as_py()] * len(part)), pa.array([h.as_py()] * len(part)), pa.array(range(lo // WINDOW, lo // WINDOW + len(part)), pa.int64()), pa.array(part, pa.binary())],
                    names=["lang", "h", "k", "w"],
                )


def labelled_windows(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, *, sample: int = SAMPLE, learned: int = LEARNED) -> list[tuple[str, bytes]]:
    """(language, bytes) of at most ``learned`` windows of at most ``sample`` labelled texts, whatever their lengths.

    Texts are those of least hashed id; an id with several texts of one language gives the least of them.
    Of their windows, cut by the tasks, those of least hash come to the driver.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & (F.col(text_col) != "")).select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).alias("l"))
    chosen = least_hashed(rows, ["i", "l"], sample)  # the bound of the broadcast
    texts = rows.join(F.broadcast(chosen), ["i", "l"]).groupBy("i", "l").agg(F.min("t").alias("t"))
    scratch = Scratch(labelled.sparkSession)
    cut = texts.select("l", F.xxhash64("i", "l").alias("h"), F.col("t").cast("binary").alias("t")).mapInArrow(_cut, "lang string, h long, k long, w binary")
    cut = scratch.keep(cut.withColumn("at", F.xxhash64("h", "k")), "windows")
    total = cut.count()
    if total > learned:
        cut = cut.filter(F.pmod("at", F.lit(1 << 40)) < F.lit(int(1.2 * learned / total * (1 << 40))))
    got = [(r.lang, bytes(r.w)) for r in cut.orderBy("at", "h", "k").limit(learned).collect()]
    scratch.drop_all_but()
    return got


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, *, sample: int = SAMPLE, learned: int = LEARNED) -> Network | None:
    """A network fitted on ``labelled_windows``; None without labels.  The driver holds a byte for each of theirs."""
    got = labelled_windows(labelled, id_col, text_col, lang_col, sample=sample, learned=learned)
    if not got:
        return None
    langs = sorted({lang for lang, _ in got})
    table = byte_classes([w for _, w in got])
    net = Network(langs, table)
    net.fit(np.concatenate([windows(w, table) for _, w in got]), np.array([langs.index(lang) for lang, _ in got]))
    net.prepare()
    return net


def _predict(batches, net):
    for rb in batches:
        texts = rb.column(1).to_pylist()
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < 500_000):
                size += len(texts[hi] or "")
                hi += 1
            part = [t or "" for t in texts[lo:hi]]
            some = [any(map(str.isalpha, t)) for t in part]
            grids = [windows(t.encode("utf-8", "surrogatepass"), net.table) if s else np.empty((0, WINDOW), np.uint8) for t, s in zip(part, some)]
            doc = np.repeat(np.arange(len(part)), [len(g) for g in grids])
            p = net.predict(np.concatenate(grids)) if len(doc) else np.empty((0, len(net.langs)))
            mean = np.stack([np.bincount(doc, weights=p[:, k], minlength=len(part)) for k in range(len(net.langs))], axis=1)
            mean = mean / np.maximum(np.bincount(doc, minlength=len(part)), 1)[:, None]
            best = mean.argmax(axis=1)
            langs = [net.langs[b] if s else NO_LANGUAGE for b, s in zip(best, some)]
            score = [float(min(1.0, mean[k, b])) if s else 0.0 for k, (b, s) in enumerate(zip(best, some))]
            yield pa.RecordBatch.from_arrays([rb.column(0).slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])
            lo = hi


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, sample: int = SAMPLE) -> DataFrame:
    """(id_col, lang_pred, score) for every row; ``learn`` is the condition for rows that may be learned from.

    Null texts and texts without a letter are ``und`` with score 0, as are all when there is no label to
    learn from.  Every byte of a text is read.  Repeated rows give repeated rows.  Other columns are not
    read.  At most LEARNED windows of ``sample`` labelled texts are learned from; prediction covers all rows.  Of
    equally likely languages the first in alphabetical order is given.
    """
    ship_package(docs.sparkSession)
    net = train(docs.filter(learn), id_col, text_col, lang_col, sample=sample)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if net is None:
        return src.select(F.col("id").alias(id_col), F.lit(NO_LANGUAGE).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of bounded size: some 20 MB with all 230 classes
    out = src.mapInArrow(lambda it: _predict(it, shared.value), f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
