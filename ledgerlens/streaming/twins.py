"""Structured Streaming twins of the running aggregates.  On a finished input they give the batch results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import importable

KEY, TS = "account_id", "transaction_timestamp"


def source(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def _timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling_counts(stream: DataFrame, late: str = "1 day", key: str = KEY, ts: str = TS, amount: str = "amount", size: str = "1 day") -> DataFrame:
    g = _timed(stream, ts, late).groupBy(F.window(ts, size), key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(amount).cast("decimal(18,2)")).cast("double").alias("total"))
    return g.select(key, F.col("window.start").cast("date").alias("day"), "n", "total")


def sliding_counts(stream: DataFrame, late: str = "1 day", size: str = "30 days", slide: str = "1 day", key: str = KEY, ts: str = TS) -> DataFrame:
    g = _timed(stream, ts, late).groupBy(F.window(ts, size, slide), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def bursts(stream: DataFrame, gap: str = "6 hours", late: str = "1 day", key: str = KEY, ts: str = TS) -> DataFrame:
    """Sessions of activity without a pause of ``gap``."""
    g = _timed(stream, ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def distinct_transactions(stream: DataFrame, late: str = "1 day", id_col: str = "transaction_id", ts: str = TS) -> DataFrame:
    return _timed(stream, ts, late).dropDuplicatesWithinWatermark([id_col])


GAPS = "account_id long, n long, min_gap_hrs double, mean_gap_hrs double"


def running_gaps(stream: DataFrame, key: str = KEY, ts: str = TS) -> DataFrame:
    """Least and mean gap per account so far; state is five numbers a key, whatever its number of rows.

    Rows of one trigger may come in any order; they must not be older than those of earlier triggers.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, low, total = state.get if state.exists else (None, 0, None, 0.0)
        times = sorted(x for pdf in batches for x in pdf[ts].astype("int64").tolist())
        for t in times:
            if last is not None:
                gap = (t - last) / 3.6e12
                low = gap if low is None else min(low, gap)
                total += gap
            last, n = t, n + 1
        state.update((last, n, low, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "min_gap_hrs": [low], "mean_gap_hrs": [total / (n - 1) if n > 1 else None]})

    src = stream.select(key, F.col(ts).cast("timestamp").alias(ts))
    return src.groupBy(key).applyInPandasWithState(step, GAPS, "last long, n long, low double, total double", "update", GroupStateTimeout.NoTimeout)


def upsert(target: str, keys: list[str]):
    """A foreachBatch function that keeps the newest row per key in a Parquet table, a new version per batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{target}/v{batch_id}"
        old = f"{target}/v{batch_id - 1}"
        rows = batch
        if batch_id > 0:
            before = spark.read.parquet(old)
            rows = batch.unionByName(before.join(batch.select(*keys), keys, "left_anti"))
        rows.write.mode("overwrite").parquet(path)

    return run


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that a stream has now, through the memory sink; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


ORDERED = "ts timestamp, gap_hrs double, n long"
HOUR_US = 3_600_000_000


class OrderedGaps(StatefulProcessor):
    """Gaps between a key's events in the order of their own times, however they arrive within the watermark.

    State of a key: the events not yet passed by the watermark (a list), and the time and number of those that
    were.  An event-time timer at the earliest waiting event releases what the watermark has passed, in order.  A second kind
    of timer, ``idle`` after the last released event, drops the key when nothing has come since, so the
    state holds only keys that were active of late; a key that comes back later begins anew, without a gap.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long")
        self.passed = handle.getValueState("passed", "last long, n long")

    def handleInputRows(self, key, rows, timerValues):
        own = [int(x) for pdf in rows for x in pdf["us"].dropna().tolist()]
        if own:
            self.waiting.appendList([(x,) for x in own])
            self.handle.registerTimer(min(own) // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(int(r[0]) for r in self.waiting.get())
        due, rest = [x for x in held if x <= mark], [x for x in held if x > mark]
        last, n = self.passed.get() if self.passed.exists() else (None, 0)
        out = []
        for x in due:
            n += 1
            out.append((x, (x - last) / HOUR_US if last is not None else None, n))
            last = x
        if due:
            self.passed.update((last, n))
            if rest:
                self.waiting.put([(x,) for x in rest])
            else:
                self.waiting.clear()
        if rest:
            self.handle.registerTimer(rest[0] // 1000)
        elif last is not None:
            end = last // 1000 + self.idle_ms
            if mark // 1000 >= end:
                self.passed.clear()
            else:
                self.handle.registerTimer(end)
        if out:
            us, gap, count = zip(*out)
            yield pd.DataFrame({"key": [key[0]] * len(out), "ts": pd.to_datetime(list(us), unit="us", utc=True), "gap_hrs": pd.array(gap, dtype="Float64"), "n": count})

    def close(self) -> None:
        pass


def ordered_gaps(stream: DataFrame, late: str = "1 day", idle_days: float = 30.0, key: str = KEY, ts: str = TS) -> DataFrame:
    """(key, ts, gap_hrs, n): each event once the watermark has passed it, with the gap to the one before and its number.

    Rows may come out of order by up to ``late``; what is older than the watermark is dropped by Spark.  Null
    times are no events.  Needs the RocksDB state store, which is set on the session.
    """
    spark = stream.sparkSession
    importable(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = stream.schema[key].dataType.simpleString()
    src = _timed(stream.select(key, ts), ts, late).select(F.col(key).alias("key"), F.col(ts), F.unix_micros(F.col(ts)).alias("us"))
    out = src.groupBy("key").transformWithStateInPandas(OrderedGaps(int(idle_days * 86_400_000)), f"key {kind}, {ORDERED}", "Append", "EventTime")
    return out.withColumnRenamed("key", key)
