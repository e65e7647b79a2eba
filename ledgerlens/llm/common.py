"""Shared plumbing of the training-data operators: scratch tables, worker set-up, id folds."""

from __future__ import annotations

import atexit
import itertools
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

_SEQ = itertools.count()
_LIVE: dict[str, tuple[SparkSession, str]] = {}


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver imported it.

    On a cluster the package is installed on each machine or shipped with --py-files; then this
    only adds a folder that the workers skip.
    """
    bound_batches(spark)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, root])


#: Rows that go to a Python worker at once: texts are large rows, and a batch is held whole on both sides.
BATCH_ROWS = 1024


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of executors.

    ``keep`` writes a frame and reads it back.  ``drop`` deletes tables no later plan reads.  What a
    returned DataFrame still reads stays until the session's interpreter ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/ledgerlens-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}  # by number

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}-{next(_SEQ)}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[len(self.paths)] = path
        _LIVE[path] = (self.spark, path)
        out._scratch_path = path  # noqa: SLF001 - a handle for drop()
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                _delete(self.spark, path)
                _LIVE.pop(path, None)


    def drop_all_but(self, *names: str) -> None:
        """Deletes every table of this object but those kept under ``names``."""
        for path in self.paths.values():
            if path in _LIVE and path.rsplit("/", 1)[1].rsplit("-", 1)[0] not in names:
                _delete(self.spark, path)
                _LIVE.pop(path, None)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in list(_LIVE.values()):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            break
    _LIVE.clear()


def fold(col: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(n)


def least_hashed(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` distinct ``keys`` of ``df`` that have the least hash, or all where there are fewer.

    A first cut by the hash leaves about 2n distinct keys, so that ordering gets no more than that.  Its
    share comes from a sketch of the number of distinct keys, so repeated rows do not move it.
    """
    cut = df.select(*keys).withColumn("__h", F.xxhash64(*keys))
    about = cut.agg(F.approx_count_distinct("__h", 0.02)).first()[0]
    if about > 2 * n:
        cut = cut.filter(F.pmod(F.col("__h"), F.lit(1 << 40)) < F.lit(int(2 * n / about * (1 << 40))))
    return cut.distinct().orderBy("__h", *keys).limit(n).drop("__h")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


HOT_SHARE = 1000  # a key with more than one in so many of the rows is dealt into several tasks


def hot_keys(scratch: Scratch, counts: DataFrame, keys: list[str], n: str = "c") -> DataFrame:
    """(keys..., salts) of the hot keys of ``counts``, a table with a row count ``n`` per key: HOT_SHARE rows at most.

    ``salts``: how many tasks such a key's rows are dealt into, so that each holds about a HOT_SHARE-th of all.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    hot = counts.filter(F.col(n) * HOT_SHARE > F.lit(total))
    return scratch.keep(hot.select(*keys, F.ceil(F.col(n) * HOT_SHARE / F.lit(max(1, total))).cast("int").alias("salts")), "hot")


def _tasks(hot: DataFrame, keys: list[str]) -> Column:
    """Into how many tasks a row's key is dealt: 1, or the ``salts`` of a hot key.

    Their hashes (HOT_SHARE at most) are read once and written into the plan, so that no rows go through a join to learn
    it.  Keys of one hash are dealt alike on both sides of a later join, so nothing is lost by it.
    """
    held = getattr(hot, "_tasks", None)
    if held is None:
        held = {}
        for h, m in hot.select(F.xxhash64(*keys), "salts").collect():
            held.setdefault(m, []).append(h)
        hot._tasks = held  # noqa: SLF001 - read once for all plans
    if not held:
        return F.lit(1)
    among = lambda hashes: f"xxhash64({', '.join(keys)}) IN ({', '.join(f'{h}L' for h in hashes)})"
    each = " ".join(f"WHEN {among(hashes)} THEN {m}" for m, hashes in sorted(held.items()))
    return F.expr(f"CASE WHEN {among([h for hashes in held.values() for h in hashes])} THEN CASE {each} END ELSE 1 END")


def salted(rows: DataFrame, hot: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """``rows`` with ``salt``: 0, and for hot keys a number that ``by`` hashes to."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), _tasks(hot, keys)).cast("int"))


def spread(small: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``small``, a table with one row per key, repeated for every salt of a hot key."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), _tasks(hot, keys) - 1)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
