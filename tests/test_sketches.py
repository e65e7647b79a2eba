"""Merging the states of ten parts is as good as one pass, within the stated errors."""

import datetime as dt

import numpy as np
import pytest

from ledgerlens.operators import sketches

SCHEMA = "account_id long, transaction_timestamp timestamp_ntz, amount double, counterparty_id long"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    return [(int(rng.choice([1, 1, 1, 2, 3])), START + dt.timedelta(seconds=int(rng.integers(10**7))), round(float(rng.gamma(2, 50)), 2), int(rng.integers(20_000))) for _ in range(30_000)]


def check(got, rows):
    for r in got:
        own = [x for x in rows if x[0] == r.account_id]
        amounts = np.sort([x[2] for x in own])
        exact = len({x[3] for x in own})
        assert r.n == len(own) and r.total == pytest.approx(amounts.sum(), abs=1e-6)
        assert (r.first_ts, r.last_ts) == (min(x[1] for x in own), max(x[1] for x in own))
        assert abs(r.n_partners - exact) <= 4 * sketches.distinct_error() * exact
        for name, p in (("p25_amount", 0.25), ("median_amount", 0.5), ("p95_amount", 0.95)):
            assert abs(np.searchsorted(amounts, r[name]) / len(amounts) - p) <= 2 * sketches.rank_error() + 1 / len(amounts)


def test_ten_parts_merge_within_the_error(spark, rows):
    parts = [sketches.state(spark.createDataFrame(rows[i::10], SCHEMA)) for i in range(10)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    got = sketches.features(sketches.merged(both)).collect()
    assert len(got) == 3
    check(got, rows)
    check(sketches.features(sketches.state(spark.createDataFrame(rows, SCHEMA))).collect(), rows)


def test_batches_are_kept_and_replays_change_nothing(spark, rows, tmp_path):
    keep = sketches.keeper(str(tmp_path))
    for b in range(4):
        keep(spark.createDataFrame(rows[b * 500 : (b + 1) * 500], SCHEMA), b)
    keep(spark.createDataFrame(rows[1500:2000], SCHEMA), 3)
    check(sketches.features(spark.read.parquet(f"{tmp_path}/v3")).collect(), rows[:2000])
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["v2", "v3"]


def test_nulls_and_empty_batches(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, START, None, None), (1, START, 2.5, 7)], SCHEMA)
    got = {r.account_id: r for r in sketches.features(sketches.merged(sketches.state(df).unionByName(sketches.state(df.limit(0))))).collect()}
    assert (got[None].n, got[None].n_partners, got[None].median_amount) == (1, 0, None)
    assert (got[1].n, got[1].n_partners, got[1].median_amount, got[1].total) == (2, 1, 2.5, 2.5)
