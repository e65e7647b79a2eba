import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import langid, queries, toxicity
from ledgerlens.llm.common import fold, least_hashed


def made_docs(n=400, seed=1):
    rng = random.Random(seed)
    words = ["w%s" % "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    bad = ["idiotic", "scummy", "trashest", "vequor", "vequar", "vequis"]
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.25)
        text = [rng.choice(words) for _ in range(rng.choice([5, 60]))]
        if y:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, y))
    return rows, labels


def test_toxicity_learns_and_holds_out(spark):
    rows, labels = made_docs()
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (1001, ""), (1002, "vequxx")], "doc_id long, text string").withColumn("y", F.lit(3))
    labelled = spark.createDataFrame(labels + [(2000, 1), (1, None)], "doc_id long, toxic int")
    held = fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, labelled, ~held)
    got = toxicity.score(docs.withColumn("held", held), model).collect()
    truth = dict(labels)
    right = [(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in got if r.held and r.doc_id < 1000]
    assert len(right) > 40 and np.mean(right) >= 0.95
    assert all(0 <= r.score <= 1 and r.y == 3 for r in got) and len(got) == len(rows) + 4
    odd = {r.doc_id: r.score for r in got if r.doc_id >= 1000}
    assert odd[1000] == odd[1001] < 0.5 and odd[1002] > odd[1001]
    # The held-out labels make no difference.
    other = labelled.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, other, ~held)
    assert (again.weights, again.bias) == (model.weights, model.bias)


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none, F.lit(True))
    assert toxicity.score(docs, model).first().score < 0.5
    assert toxicity.score(docs.filter("false"), model).count() == 0


def test_toxicity_query(spark, sf):
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([got[i].predicted == y for i, y in labels.items() if i in got]) > 0.85


def as_rows(votes):
    return [np.flatnonzero(r).tolist() for r in votes]


def test_label_model_finds_the_poor_voter():
    rng = np.random.default_rng(0)
    y = (rng.random(3000) < 0.3).astype(float)
    flip = lambda rate: np.where(rng.random(3000) < rate, 1 - y, y)
    post, on, off, _ = toxicity.label_model(as_rows(np.column_stack([flip(0.05), flip(0.1), flip(0.45)])), 3, flip(0.05))
    assert ((post > 0.5) == (y == 1)).mean() > 0.97
    assert on[0] - off[0] > on[2] - off[2] + 0.5


def test_label_model_sees_through_copies():
    """One voter copied ten times is one witness: three good voters outvote it."""
    rng = np.random.default_rng(3)
    y = (rng.random(4000) < 0.3).astype(float)
    flip = lambda rate: np.where(rng.random(4000) < rate, 1 - y, y)
    poor = flip(0.3)
    votes = np.column_stack([flip(0.08), flip(0.08), flip(0.08), *[poor] * 10])
    post, _, _, parent = toxicity.label_model(as_rows(votes), votes.shape[1], flip(0.08))
    assert sum(int(p >= 3) for p in parent[3:]) >= 9  # the copies hang together
    assert ((post > 0.5) == (y == 1)).mean() > 0.95


def test_voters_and_tail_by_brute_force():
    from fractions import Fraction
    from math import comb, log

    for n, k, p in ((3, 3, 0.1), (40, 9, 0.25), (700, 300, 0.125)):
        q = Fraction(p)
        exact = sum(comb(n, i) * q**i * (1 - q) ** (n - i) for i in range(k, n + 1))
        assert abs(toxicity.log_tail(n, k, p) - (log(exact.numerator) - log(exact.denominator))) < 1e-9
    # Benjamini-Hochberg: the largest i with p(i) <= rate * i / tried, and all before it.
    tests = [("a", 9, 9, log(0.001)), ("b", 5, 5, log(0.012)), ("c", 4, 4, log(0.014)), ("d", 3, 3, log(0.05))]
    assert toxicity.significant(tests, 10, 0.05) == ["a", "b", "c"]
    assert toxicity.significant([], 0) == []


def test_scores_by_brute_force(spark):
    rows, labels = made_docs(300, seed=9)
    texts = rows + [(900, None), (901, ""), (902, "Idiotic IDIOTIC scummy " * 20000), (903, "vequor! (vequar)?")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert model.weights
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for i, t in texts:
        words, found = set(), set()
        word = ""
        for ch in (t or "").lower() + " ":
            if ch.isalnum() or ch == "_":
                word += ch
            elif word:
                words.add(word)
                word = ""
        for w in words:
            found.add(w)
            for n in (4, 5, 6):
                if len(w) > n:
                    found |= {w[:n] + "-", "-" + w[-n:]}
        z = model.bias + sum(model.weights.get(f, 0.0) for f in found)
        assert abs(got[i] - 1 / (1 + np.exp(-max(-30, min(30, z))))) < 1e-9
    assert got[902] > 0.5


def test_sample_of_repeated_rows(spark):
    rows = spark.range(20_000).select(F.lit(7).cast("long").alias("i"), F.lit("x").alias("l"))
    assert [tuple(r) for r in least_hashed(rows, ["i", "l"], 100).collect()] == [(7, "x")]
    many = spark.range(30_000).select(F.pmod("id", F.lit(5000)).alias("i"))
    assert least_hashed(many, ["i"], 300).count() == 300
    assert least_hashed(many, ["i"], 9000).count() == 5000


def test_conv_tables_equal_direct_convolution():
    table = langid.byte_classes([bytes(range(200))])
    net = langid.Network(["a", "b"], table)
    net.prepare()
    x = np.random.default_rng(1).integers(0, net.classes, (5, 256)).astype(np.uint8)
    h = []
    for k in langid.WIDTHS:
        z = sum(net.w[k][j][x[:, j : 256 - k + 1 + j]] for j in range(k))
        h.append(np.maximum(z.max(axis=1) + net.b[k], 0))
    logits = np.concatenate(h, axis=1) @ net.v + net.c
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    assert np.allclose(net.predict(x), e / e.sum(axis=1, keepdims=True), atol=1e-5)


def test_every_byte_of_the_training_texts_keeps_its_identity():
    table = langid.byte_classes([bytes(range(256))])
    fold_ = lambda b: b + 32 if 65 <= b <= 90 else b
    assert all((table[a] == table[b]) == (fold_(a) == fold_(b)) for a in range(256) for b in range(256))
    assert table.max() < langid.PAD


def test_language_of_repeated_rows(spark):
    """20,000 rows of a few ids: the sample is of ids, so the network learns all the same."""
    words = {"en": "the and of to in that it was", "de": "der und die das nicht ein auch mit"}
    kinds = [(i, " ".join([w, str(i)] * 8), lang) for i, lang in enumerate(("en", "de") * 30) for w in [words[lang]]]
    docs = spark.createDataFrame(kinds, "doc_id long, text string, lang string")
    docs = docs.crossJoin(spark.range(334)).drop("id")
    got = langid.identify(docs, F.col("doc_id") < 50).filter("doc_id >= 50").groupBy("doc_id", "lang_pred").count().collect()
    assert {(r.doc_id % 2, r.lang_pred) for r in got} == {(0, "en"), (1, "de")}


def test_windows_and_mean_by_brute_force(spark):
    texts = [(1, "abc " * 300 + "xyz"), (2, "q"), (3, "é" * 200), (4, "a" * 256), (5, "b" * 257)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    net = langid.train(docs, "doc_id", "text", "lang")
    got = {r.doc_id: r for r in langid.identify(docs, F.lit(True)).collect()}
    for i, t in texts:
        raw, parts = t.encode(), []
        for lo in range(0, len(raw), 256):
            cells = [int(net.table[b]) for b in raw[lo : lo + 256]]
            parts.append(net.predict(np.array([cells + [langid.PAD] * (256 - len(cells))], dtype=np.uint8))[0])
        mean = np.mean(parts, axis=0)
        assert got[i].lang_pred == net.langs[int(mean.argmax())] and abs(got[i].score - mean.max()) < 1e-6


def test_language_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    got = queries.op8_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    held = [r.lang_pred == truth[r.doc_id][0] for r in got if r.held_out and len(truth[r.doc_id][1]) > 60]
    assert np.mean(held) > 0.95
    odd = docs.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "123 !? 456", None), (-4, "the thing " * 40000, None)], "doc_id long, text string, lang string")
    )
    out = {r.doc_id: r for r in langid.identify(odd, F.col("doc_id") >= 0).collect()}
    assert [out[i].lang_pred for i in (-1, -2, -3)] == ["und"] * 3 and out[-4].lang_pred == "en"
    assert langid.identify(odd.filter("false"), F.lit(True)).count() == 0
    assert all(0 <= r.score <= 1 for r in out.values())
