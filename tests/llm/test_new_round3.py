"""Resampling, token counts and whitening against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import queries, resample, tokencount, whitening
from ledgerlens.llm.common import ship_package

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _runs(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, words + [" ".join(p) for p in zip(words, words[1:])]


def _resampled(docs, target):
    """The contract, word for word, over lists."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    raw, want = Counter(), Counter()
    for _, text in docs:
        raw.update(map(bucket, _runs(text)[1]))
    for text in target:
        want.update(map(bucket, _runs(text)[1]))
    s_all, t_all = sum(raw.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1) * (s_all + 10000) / ((raw[b] + 1) * (t_all + 10000))))
    rows = []
    for key, text in docs:
        words, runs = _runs(text)
        weight = sum(gain(bucket(f)) for f in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"7:{key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(runs), weight, score, len(words)])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: 25 * len(able) // 100])}
    return sorted((*r[:4], rank.get(id(r))) for r in rows)


def test_resampling_is_the_formula(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    got = sorted(tuple(r) for r in queries.queries()["op11_importance_resampling"](spark, sf).collect())
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(got, key=key) == sorted(_resampled(docs, target), key=key)


def test_resampling_odd_rows(spark):
    long = " ".join(f"w{k % 50}" for k in range(200_000))
    same = " ".join(f"s{k}" for k in range(25))
    docs = [(1, None), (2, ""), (3, "\x00--"), (4, long), (5, same), (5, same), (6, "Ünï çödé X1 " * 9), (7, "a-b_c" * 12), (8, same)]
    df = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, rank int, weight string")
    target = spark.createDataFrame([("s1 s2 s3",), (None,)], "text string")
    key = lambda r: tuple(-1 if v is None else v for v in r)
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resample.resample(df, target).collect()]
    assert sorted(got, key=key) == sorted(_resampled(docs, ["s1 s2 s3", None]), key=key)
    none = resample.resample(df, target.limit(0)).collect()
    assert len(none) == len(docs) and all(r.n_features == 0 for r in none if r.doc_id < 4)
    assert resample.resample(df.limit(0), target).count() == 0
    lone = resample.resample(spark.createDataFrame([(None, same)] * 8, "doc_id long, text string"), target, percent=100).collect()
    assert [(r.score, r["rank"], r.n_words) for r in lone] == [(None, None, 25)] * 8


def test_resampling_copies_of_one_row_are_each_ranked(spark):
    """A third of all rows is one row; all are drawn, each with its own rank."""
    same = " ".join(f"s{k}" for k in range(25))
    df = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id") + 10).alias("doc_id"), F.lit(same).alias("text"))
    got = resample.resample(df, spark.createDataFrame([(same,)], "text string"), percent=100).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 3001))
    assert [(-r.score, r.doc_id) for r in sorted(got, key=lambda r: r["rank"])] == sorted((-r.score, r.doc_id) for r in got)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB1 -é_\n\x7f中", max_size=60))
def test_overlapped_spans_are_the_word_runs(text):
    found = resample.hashed_runs(text.encode(), resample.run_patterns(3), 10**9)
    words = WORD.findall(text.translate(LOWER))
    for n, got in enumerate(found, 1):
        assert got.tolist() == [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10**9 for i in range(len(words) - n + 1)]


def _library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_are_the_librarys(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = [(r.doc_id, len(r.text.encode()), n, n > 2048) for r, n in zip(docs, _library([r.text for r in docs]))]
    assert sorted(tuple(r) for r in queries.queries()["op12_token_counts"](spark, sf).collect()) == want


def test_token_counts_odd_rows(spark):
    odd = ["", "<|endoftext|>x<|ENDOFTEXT|> <|startoftext|>", "İstanbul é ́ \x1c\x85　 ''s 'LL9't", "a" * 70_000, "1" * 70_000, "字" * 70_000]
    odd += ["word's 12 é <|endoftext|> " * 9_000, ("x" * 65_530 + " ") * 2 + "<|endoftext|>" * 3, "a" * 66_000 + "1b" * 9]
    rows = [(k, t) for k, t in enumerate(odd)] + [(None, "a b"), (3, odd[3])]
    df = spark.createDataFrame([(*r, 1) for r in rows] + [(99, None, 1)], "doc_id long, text string, n_tokens int")
    path = queries.vocabulary("word_bpe_49k.json")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.count_tokens(df, path).collect()), key=str)
    want = [(k, len(t.encode()), n) for (k, t), n in zip(rows, _library([t for _, t in rows]))] + [(99, 0, 0)]
    assert got == sorted(want, key=str)
    assert tokencount.count_tokens(df.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        tokencount.count_tokens(df, queries.vocabulary("byte_bpe_50k.json"))  # a blank belongs to the next piece there


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab 1\n\té字'́<|>", max_size=80), st.integers(1, 12))
def test_parts_add_up(text, part):
    cut = tokencount.parts_of(text, part)
    assert "".join(cut) == text
    assert sum(_library(cut)) == _library([text])[0]


def test_batches_are_balanced():
    sizes = np.array([900, 10, 500, 400, 90, 100] * 50)
    batches = tokencount.balanced(sizes, 4000)
    assert sorted(np.concatenate(batches).tolist()) == list(range(300))
    loads = [int(sizes[b].sum()) for b in batches]
    assert max(loads) - min(loads) <= 100 and max(loads) <= 4000


def _exact(vectors):
    """(n, S, M) by fractions, and eigenvalues by numpy."""
    xs = sorted({tuple(math.floor(Fraction(c) * 256) for c in v) for v in vectors})
    n, d = len(xs), len(xs[0])
    s = [sum(x[j] for x in xs) for j in range(d)]
    m = [[n * sum(x[i] * x[j] for x in xs) - s[i] * s[j] for j in range(d)] for i in range(d)]
    return n, s, m


def test_whitening_on_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    n, s, m = _exact([r[1] for r in rows])
    got = queries.queries()["op13_embedding_whitening"](spark, sf).collect()
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    v = np.array(m, dtype=float) / n**2
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1][:4], vector[:, ::-1][:, :4]
    by = {(r.vec_id, r.component): r for r in got}
    x = np.floor(256 * np.array([r[1] for r in rows], dtype=float))
    want = (x - np.array(s) / n) @ vector / np.sqrt(value)
    have = np.array([[by[r[0], c].whitened for c in range(1, 5)] for r in rows])
    sign = np.sign((want * have).sum(0))
    assert np.abs(have - want * sign).max() < 1e-8
    assert np.allclose([by[rows[0][0], c].explained for c in range(1, 5)], value / np.trace(v), rtol=1e-12)
    assert [by[r[0], 1].deviation for r in rows] == [int(((n * a.astype(int) - np.array(s)) ** 2).sum()) for a in x]
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, 1.0, -2.0], [0.25, 3.0, 1.0], [1.5, -1.0, 0.0], [0.5, 1.0, -2.0], [-0.001, 0.0, 0.003]]
    rows = [(k, v, "x") for k, v in enumerate(good)] + [(None, good[0], "x"), (10, None, "x"), (11, [], "x"), (12, [1.0, None, 2.0], "x"), (13, [nan, 0.0, 1.0], "x"), (14, [0.0, -inf, 1.0], "x"), (15, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")
    got = whitening.whiten(df).collect()
    n, s, m = _exact(good)
    assert n == 4 and {r.n for r in got} == {4}
    assert sorted(((r.vec_id, r.component) for r in got), key=str) == sorted(((k, c) for k in [*range(5), None] for c in (1, 2, 3)), key=str)
    same = {r.component: r.whitened for r in got if r.vec_id == 0}
    assert same == {r.component: r.whitened for r in got if r.vec_id == 3} == {r.component: r.whitened for r in got if r.vec_id is None}
    assert got[0].identity_error < 1e-9
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id in (0, 3)")).count() == 0  # one distinct vector has no variance
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [3e12, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(huge).collect()
    assert len(got) == 6 and got[0].identity_error < 1e-4
    top = 2**63 - 1
    assert {r.vec_id: int(r.deviation) for r in got}[1] == (3 * top - (top - 2**63 + 3 * 10**12 * 256)) ** 2 + (-768) ** 2


@pytest.mark.parametrize("d, n", [(1, 5), (2, 9), (7, 30), (20, 8)])
def test_polynomial_roots_and_components(spark, d, n):
    ship_package(spark)
    rng = np.random.default_rng(d)
    x = rng.integers(-300, 300, size=(n, d))
    m = [[n * int(x[:, i] @ x[:, j]) - int(x[:, i].sum()) * int(x[:, j].sum()) for j in range(d)] for i in range(d)]
    c = whitening.characteristic_polynomial(spark, m)
    # Newton's identities over exact power sums give the same coefficients.
    big, power, sums = np.array(m, dtype=object).reshape(d, d), np.eye(d, dtype=object), []
    for _ in range(d):
        power = power.dot(big)
        sums.append(int(np.trace(power)))
    e = [1]
    for k in range(1, d + 1):
        e.append(sum((-1) ** (i - 1) * e[k - i] * sums[i - 1] for i in range(1, k + 1)) // k)
    assert c == [(-1) ** k * v for k, v in enumerate(e)]
    roots = whitening.largest_roots(c, 4)
    want = np.linalg.eigvalsh(np.array(m, dtype=float))[::-1]
    assert len(roots) == min(4, d, n - 1)
    assert np.allclose([a / (1 << b) for a, b in roots], want[: len(roots)], rtol=1e-9)
    vectors = np.array(whitening.components(m, roots))
    assert np.abs(vectors @ vectors.T - np.eye(len(roots))).max() < 1e-14
    assert np.abs(np.array(m, dtype=float) @ vectors.T - vectors.T * want[: len(roots)]).max() < 1e-10 * want[0]


def test_equal_and_nearly_equal_eigenvalues():
    m = [[20 if i == j else 0 for j in range(6)] for i in range(6)]
    c = [math.comb(6, k) * (-20) ** k for k in range(7)]
    roots = whitening.largest_roots(c, 4)
    vectors = np.array(whitening.components(m, roots))
    assert [Fraction(a, 1 << b) for a, b in roots] == [20] * 4 or np.allclose([a / (1 << b) for a, b in roots], 20)
    assert np.abs(vectors @ vectors.T - np.eye(4)).max() < 1e-14
    big = 10**30  # eigenvalues 10**30 and 10**30 + 1: the same double, yet told apart
    roots = whitening.largest_roots([1, -(2 * big + 1), big * (big + 1)], 2)
    near = np.array(whitening.components([[big, 0], [0, big + 1]], roots))
    assert np.abs(near - np.array([[0, 1], [1, 0]])).max() < 1e-14


def test_gram_is_exact_at_any_size():
    rng = np.random.default_rng(3)
    for top in (5, 1 << 25, (1 << 63) - 1):
        x = rng.integers(-top, top, size=(50, 4), endpoint=True)
        x[0, 0] = -(1 << 63) if top > 1 << 60 else x[0, 0]
        want = x.astype(object).T.dot(x.astype(object))
        assert (whitening.gram(x) == want).all()
