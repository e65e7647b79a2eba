"""Orders of a key that holds most rows, split by time, against the plain way and pandas."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import features, ordered

START = dt.datetime(2024, 1, 1)


def moment(x):
    return START + dt.timedelta(microseconds=int(x))


@pytest.fixture(scope="module")
def busy(spark):
    rng = random.Random(3)
    rows = [(1 if rng.random() < 0.7 else rng.randrange(2, 30), moment(rng.randrange(10**11)), rng.randrange(-500, 9000) / 100) for _ in range(4000)]
    rows += [rows[0]] * 40 + [(77, moment(5), 1.0), (None, moment(9), 2.0), (None, moment(8), 2.0), (1, None, 3.0)]
    return rows, spark.createDataFrame(rows, "account_id long, transaction_timestamp timestamp_ntz, amount double").repartition(5)


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12))


def test_gaps_of_a_split_account_equal_the_plain_way(spark, busy):
    rows, df = busy
    plain = {r[0]: r[1:] for r in features.gaps(df).collect()}
    split = {r[0]: r[1:] for r in features.gaps(df, hot=500, parts=9).collect()}
    assert plain.keys() == split.keys() and all(close(x, y) for k in plain for x, y in zip(plain[k], split[k]))
    times = sorted(t for k, t, _ in rows if k == 1 and t)
    gap = np.diff([t.timestamp() for t in times]) / 3600
    assert plain[1][0] == pytest.approx(np.median(gap)) and plain[1][2] == pytest.approx(gap.std(ddof=1))
    dealt, is_split = ordered.dealt(df, "account_id", "transaction_timestamp", hot=500, parts=9)
    sizes = {(r.account_id, r["__part"]): r["count"] for r in dealt.groupBy("account_id", "__part").count().collect()}
    own = [n for (k, _), n in sizes.items() if k == 1]
    assert is_split and len(own) == 9 and max(own) < 2 * sum(own) / 9  # no task holds the account
    assert all(p == 0 for k, p in sizes if k != 1)


def brute(left, right, strictly):
    out = []
    for i, (k, t) in enumerate(left):
        seen = [(rt, v) for rk, rt, v in right if k is not None and t is not None and rk == k and rt is not None and (rt < t if strictly else rt <= t)]
        last = max(seen, default=(None, None))
        out.append((i, k, last[0], last[1], len(seen), round(sum(v for _, v in seen), 2) if seen else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("strictly", [False, True])
@pytest.mark.parametrize("hot", [10**6, 100])
def test_as_of_by_brute_force(spark, strictly, hot):
    rng = random.Random(8)
    key = lambda: rng.choice([1, 1, 1, 2, 3, None])
    time = lambda: rng.choice([None] + [moment(x) for x in range(0, 4000, 10)])  # noqa: E731 - many ties
    left, right = [(key(), time()) for _ in range(700)], [(key(), time(), rng.randrange(-300, 900) / 100) for _ in range(500)]
    a = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(left)], "i int, k long, t timestamp_ntz, r string")
    b = spark.createDataFrame([(*r, 0) for r in right], "k long, t timestamp_ntz, v double, side int")
    got = ordered.as_of(a, b, "k", "t", ["v"], {"total": "v"}, strictly=strictly, hot=hot, parts=6)
    assert got.columns == ["i", "k", "t", "r", "last_ts", "v", "n_before", "total"]
    assert sorted(((r.i, r.k, r.last_ts, r.v, r.n_before, r.total) for r in got.collect()), key=str) == brute(left, right, strictly)


def test_as_of_odd_tables(spark):
    a = spark.createDataFrame([(1, moment(5)), (1, moment(5)), (None, None)], "k long, t timestamp_ntz")
    b = spark.createDataFrame([(1, moment(4), "p"), (1, moment(4), "q")], "k long, at timestamp_ntz, name string")
    got = ordered.as_of(a, b, "k", "t", ["name"], right_ts="at").collect()
    assert sorted(((r.k, r.name, r.n_before) for r in got), key=str) == [(1, "q", 2), (1, "q", 2), (None, None, 0)]
    assert {r.n_before for r in ordered.as_of(a, b.limit(0), "k", "t", ["name"], right_ts="at").collect()} == {0}
    assert ordered.as_of(a.limit(0), b, "k", "t", ["name"], right_ts="at").count() == 0
