"""Gaps by keyed state with timers: shuffled input gives the batch gaps, and the state shrinks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.streaming import twins

START = dt.datetime(2024, 1, 1)
SCHEMA = "account_id long, transaction_timestamp timestamp_ntz"


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    rng = random.Random(4)
    rows = [(rng.randrange(6), START + dt.timedelta(minutes=rng.randrange(5 * 1440))) for _ in range(300)]
    # Out of order by up to a day: a row's place is its time and a random delay.
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(1400)))
    base = tmp_path_factory.mktemp("gaps")
    parts = [rows[i : i + 100] for i in range(0, 300, 100)]
    parts += [[(99, START + dt.timedelta(days=8))], [(98, START + dt.timedelta(days=60))], [(97, START + dt.timedelta(days=120)), (None, None), (0, None)]]
    schema = twins.T._parse_datatype_string(SCHEMA)
    for k, part in enumerate(parts):
        # One file a trigger, in the order of their names and times.
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{base}/in/p{k}")
    progress = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{base}/in")
    out = twins.ordered_gaps(stream, late="1 day", idle_days=20)
    q = out.writeStream.format("memory").queryName("ordered_gaps_out").outputMode("append").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    progress = [p for p in q.recentProgress]
    return rows, spark.table("ordered_gaps_out").collect(), progress


def test_shuffled_rows_give_the_batch_gaps(run):
    rows, got, _ = run
    want = {}
    for k in range(6):
        times = sorted(t for a, t in rows if a == k)
        want[k] = [(t, None if i == 0 else (t - times[i - 1]).total_seconds() / 3600, i + 1) for i, t in enumerate(times)]
    for k in range(6):
        mine = [(r.ts.replace(tzinfo=None), r.gap_hrs, r.n) for r in got if r.account_id == k]
        assert [(t, n) for t, _, n in mine] == [(t, n) for t, _, n in want[k]]  # emitted in order, once each
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for (_, a, _), (_, b, _) in zip(mine, want[k]))


def test_state_shrinks_after_expiry(run):
    _, _, progress = run
    sizes = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert max(sizes) >= 12 and sizes[-1] <= 4, sizes  # two values a key; lists count once
