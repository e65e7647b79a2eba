"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import SCHEMAS


def read_csv(spark: SparkSession, paths: str | Iterable[str], schema: T.StructType) -> DataFrame:
    """CSV files with a header under a declared schema: one scan, whatever the number of parts.

    Timestamps are read as text and parsed with bad values as null; other bad values are null too.
    """
    text = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampNTZType) else f.dataType, True) for f in schema.fields])
    raw = spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").csv([paths] if isinstance(paths, str) else list(paths))
    return raw.select(*[parse_time(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in schema.fields])


RECORD = "_record"


def checked_csv(spark: SparkSession, paths: str | Iterable[str], schema: T.StructType, quarantine: str | None = None, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows under ``schema``, bad rows as (reason, record)): no row is lost, and none is read with holes it did not have.

    A row is bad for ``columns`` if it has too few or too many of them or a number that is none, and for ``time`` if a
    timestamp is not empty and cannot be read; ``record`` is its text.  With ``quarantine`` the bad rows are written there,
    by reason, and read back.  All columns are parsed whatever is selected later, so a row's verdict never changes.
    """
    # Read as text and cast here, so the filter below needs every column and none is left unparsed by pruning.
    text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields] + [T.StructField(RECORD, T.StringType(), True)])
    source = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.schema(text).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD).option("columnPruning", False).csv(source)
    value = {f.name: parse_time(F.col(f.name)) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name).try_cast(f.dataType) for f in schema.fields}

    def unread(kinds: bool) -> Column:
        out = F.lit(False)
        for f in schema.fields:
            if isinstance(f.dataType, T.TimestampNTZType) == kinds:
                out = out | F.coalesce((F.trim(f.name) != "") & value[f.name].isNull(), F.lit(False))
        return out

    raw = raw.withColumn("reason", F.when(F.col(RECORD).isNotNull() | unread(False), "columns").when(unread(True), "time"))
    good = raw.filter("reason is null").select(*[c.alias(n) for n, c in value.items()])
    bad = raw.filter("reason is not null").select("reason", F.coalesce(RECORD, F.to_csv(F.struct(*[F.col(f.name) for f in schema.fields]))).alias("record"))
    if quarantine:
        bad.write.mode("overwrite").partitionBy("reason").parquet(quarantine)
        bad = spark.read.schema("record string, reason string").parquet(quarantine).select("reason", "record")
    return good, bad


def parse_time(c) -> F.Column:
    """A timestamp from text; what cannot be read is null."""
    return c.try_cast("timestamp_ntz")


def load(spark: SparkSession, folder: str, fmt: str = "csv") -> dict[str, DataFrame]:
    """All tables of the banking model from ``folder``; transactions may lie in parts named transactions*."""
    out = {}
    for name, schema in SCHEMAS.items():
        path = f"{folder}/{name}*.{fmt}"
        out[name] = read_csv(spark, path, schema) if fmt == "csv" else spark.read.schema(schema).format(fmt).load(path)
    return out


def concat(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name, missing ones null."""
    out = frames[0].select("*")
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header.  ``one_file`` is for small results: one task then writes all rows."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def predictions(scores: DataFrame, windows: DataFrame, score_col: str = "score") -> DataFrame:
    """The submission: account_id, is_mule, and the window's ends as ISO text, empty where there is none."""
    iso = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    both = scores.join(windows.select("account_id", "suspicious_start", "suspicious_end"), "account_id", "left")
    return both.select("account_id", F.col(score_col).alias("is_mule"), iso("suspicious_start").alias("suspicious_start"), iso("suspicious_end").alias("suspicious_end"))
