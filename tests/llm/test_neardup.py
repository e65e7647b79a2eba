import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import neardup
from ledgerlens.llm.shingles import shingle_set

SCHEMA = "doc_id long, text string"


def brute(rows, percent=75):
    """Components over all pairs, by plain sets of word tuples."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both, s, t = len(sets[a] & sets[b]), sets[a], sets[b]
        if s and t and 100 * both >= percent * (len(s) + len(t) - both):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {(i, len(sets[i]), root(i), root(i) == i) for i in sets}


def corpus(seed=3, groups=12):
    rng = random.Random(seed)
    vocab = ["w%d" % k for k in range(400)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([6, 40, 120]))]
        for _ in range(rng.choice([1, 3, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((n, " ".join(words)))
            n += 1
    return rows


def test_matches_brute_force(spark):
    rows = corpus() + [(900, None), (901, ""), (902, " \n "), (903, "One two"), (904, "one TWO"), (905, "two one"), (906, "É a b c d"), (907, "é a b c d")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r)[:4] for r in got.collect()} == brute(rows)


def test_chain_and_hot_group(spark):
    """A chain whose ends are far apart, and many mutual near copies with some that only reach a few of them."""
    rng = random.Random(1)
    base = ["h%d" % k for k in range(100)]
    rows = [(i, " ".join(base[:i] + ["x%d" % i] + base[i + 1 :])) for i in range(60)]
    chain = ["c%d" % k for k in range(160)]
    rows += [(500 + i, " ".join(chain[4 * i : 4 * i + 90])) for i in range(15)]
    rng.shuffle(rows)
    got = {tuple(r)[:4] for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    assert len({r[2] for r in got}) == 2


def test_odd_tables(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d e f", 5, "k"), (1, "a b c d e f", 5, "k"), (2, "A b c d e f", 6, "k"), (None, "a b c d e f", 7, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA + ", n_shingles int, rep string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == [(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, True)]


def test_ids_with_several_texts(spark):
    """Each row is linked by its own text, so none of an id's texts is lost or unlinked."""
    a, b = " ".join("a%d" % k for k in range(12)), " ".join("b%d" % k for k in range(14))
    rows = [(3, a), (7, a), (7, b), (7, b), (9, b + " more"), (9, None), (9, "")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumn("h", F.lit(1))).collect()
    mine = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept, r.representative) for r in got)
    assert mine == [(3, 8, 3, True, True), (7, 8, 3, False, False), (7, 10, 7, True, True), (7, 10, 7, True, True), (9, 0, 9, True, True), (9, 0, 9, True, True), (9, 11, 7, False, False)]


def test_star_centres_meet_all_their_pairs(spark, monkeypatch):
    """More pairs than one stretch of a star holds."""
    monkeypatch.setattr(neardup, "STAR", 4)
    rng = random.Random(2)
    base = ["k%d" % k for k in range(60)]
    rows = [(0, " ".join(base))] + [(i, " ".join(base[:j] + ["y%d" % i] + base[j + 1 :])) for i in range(1, 40) for j in [rng.randrange(60)]]
    got = {tuple(r)[:4] for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_very_long_text(spark):
    long = " ".join("w%d" % (k * k % 9973) for k in range(60_000))
    rows = [(1, long), (2, long + " tail"), (3, "short one")]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_prune_table_keeps_true_pairs():
    least = neardup.prune_table(128, 16, 0.75, 1e-4)
    rng = np.random.default_rng(0)
    hits = np.cumsum(rng.random((20000, 128)) < 0.75, axis=1)[:, 15::16]
    assert (hits < np.array(least)).any(axis=1).mean() < 2e-3
    assert neardup.prune_table(128, 16, 0.75, 1e-4) == sorted(least)


@pytest.mark.parametrize("text,n", [("", 0), ("a", 1), ("a b c d", 1), ("a b c d e", 1), ("a b c d e f", 2), ("x x x x x x x", 1), ("a b c", 1)])
def test_shingle_counts(text, n):
    assert len(shingle_set(text)) == n


def test_blocks_repeat_members_after_the_joins(spark):
    """A large bucket's members are repeated for each pair of blocks once all joins are done, so no join grows with its square."""
    named = spark.createDataFrame([(1, 0, i, i, 10, 9) for i in range(6)], "key long, salt int, id long, label long, n long, c long")
    reps = spark.createDataFrame([(i, bytearray(256), [1] * neardup.BANDS) for i in range(6)], "id long, sig binary, bands array<long>")
    pool = spark.createDataFrame([(i, "a b c d e f") for i in range(6)], SCHEMA.replace("doc_id", "id"))
    hot = spark.createDataFrame([], "key long, salts int")
    pairs = neardup._rest(named, reps, pool, hot, [0] * 8, 16, 75, 5)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
