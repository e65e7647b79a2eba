"""Where tables that cut lineage are written: a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the session's checkpoint folder.

    Where neither is set, a local session (one machine, as in tests) gets a temporary folder; on a cluster
    executors would each write to their own disk, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` by a reliable checkpoint in the shared folder, which cuts its lineage and survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        base = shared_dir(df.sparkSession)
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(base)
    return df.checkpoint(eager=True)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did; on a cluster it is installed or shipped, and this
    only adds a folder that they skip."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([*parts, root])


#: Shuffle files go when their query has ended, not when the driver collects garbage: for operators of many rounds.
DELETED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Rows of megabytes are read and held a few at a time.
LARGE_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "8", "spark.sql.inMemoryColumnarStorage.batchSize": "8"}


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str):
    """The session's settings ``conf`` for a while."""
    old = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Tables:
    """Tables written to the shared folder to cut lineage, deleted when the next one has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n, self.live = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", 0, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{name}-{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.live.append((out, path))
        _HELD.append((self.spark, path))
        return out

    def folder(self, name: str) -> str:
        """A folder of this object for files of other kinds, deleted when the interpreter ends."""
        path = f"{self.base}/{name}"
        _HELD.append((self.spark, path))
        return path

    def drop(self, *frames: DataFrame) -> None:
        for frame, path in list(self.live):
            if any(frame is f for f in frames):
                _remove(self.spark, path)
                self.live.remove((frame, path))

    def drop_all(self) -> None:
        self.drop(*[f for f, _ in self.live])

    def drop_all_but(self, *frames: DataFrame) -> None:
        self.drop(*[f for f, _ in self.live if not any(f is x for x in frames)])


_HELD: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if (spark, path) in _HELD:
        _HELD.remove((spark, path))


@atexit.register
def _remove_held() -> None:
    """What returned DataFrames still read goes when the interpreter ends, if its session is still there."""
    for spark, path in list(_HELD):
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended
            return
