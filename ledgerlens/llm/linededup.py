"""Removal of lines that repeat, by overlapping windows of consecutive lines.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, hot_keys, salted, spread


def _window_rows(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, t, pos, h1, h2) for each window of ``size`` lines that has a line with more than blanks; t: hash of the text."""
    lines = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"), F.split(F.col(text_col), "\n", -1).alias("lines")
    )
    lines = lines.filter(F.size("lines") >= size)

    def window(i):
        own = [F.get("lines", i + k) for k in range(size)]
        full = F.lit(False)
        for x in own:
            full = full | (F.trim(x) != "")
        return F.when(full, F.struct(i.alias("pos"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(size), *own).alias("h2")))

    # explode() makes a row per window here; nothing is gathered.
    out = lines.select("id", "t", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - size), window)).alias("w"))
    return out.filter("w is not null").select("id", "t", "w.pos", "w.h1", "w.h2")


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 3) -> DataFrame:
    """``docs`` with later occurrences of any ``size``-line window taken out of ``text_col``.

XX  Every removed line still stands somewhere
    earlier.  Windows of blank lines only do not count.  Adds ``n_lines`` and ``n_removed`` (replacing
    columns of these names); all other columns pass through, whatever their names.

    Null texts stay null with 0 lines; texts of fewer than ``size`` lines stay as they are.  Rows with a
    null id stay as they are and are no occurrence for others.  An id with several texts is several documents,
    each with its own lines; rows with the same id and text are one, and all get the same removals.
    Windows are compared by two 64-bit hashes, texts of one id by one.
    """
    scratch = Scratch(docs.sparkSession)
    rows = _window_rows(docs, id_col, text_col, size)
    # Partial aggregation runs before the shuffle, so a window in a third of all documents is a few rows.
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct("id", "t", "pos")).alias("first"), F.count("*").alias("c")).filter("c > 1")
    first = scratch.keep(first, "repeated")
    # Windows that hold more than a thousandth of all occurrences are met in several tasks.
    hot = hot_keys(scratch, first, ["h1", "h2"])
    again = salted(rows, hot, ["h1", "h2"], F.struct("id", "t", "pos"))
    later = again.join(spread(first.drop("c"), hot, ["h1", "h2"]), ["h1", "h2", "salt"]).filter(F.struct("id", "t", "pos") > F.col("first"))
    own = fresh(docs, "covered_id")
    places = fresh(docs, "covered")
    own_text = fresh(docs, "covered_text")
    covered = later.groupBy(F.col("id").alias(own), F.col("t").alias(own_text)).agg(F.array_sort(F.collect_set("pos")).alias(places))

    joined = docs.join(covered, (docs[id_col] == covered[own]) & (F.xxhash64(docs[text_col]) == covered[own_text]), "left")
    lines, pos = F.split(F.col(text_col), "\n", -1), F.col(places)
    c_lines, c_from, c_to, c_kept = (fresh(joined, f"{k}_of_{places}") for k in ("lines", "from", "to", "kept"))
    starts = F.filter(pos, lambda p, i: (i == 0) | (p > F.get(pos, i - 1) + size))
    ends = F.transform(F.filter(pos, lambda p, i: (i == F.size(pos) - 1) | (F.get(pos, i + 1) > p + size)), lambda p: p + size)
    joined = joined.withColumns({c_lines: lines, c_from: starts, c_to: ends})
    # What stays: the lines before the first merged stretch, between two, and after the last.
    kept = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(c_from)),
            lambda j: F.slice(
                F.col(c_lines),
                F.coalesce(F.get(c_to, j - 1), F.lit(0)) + 1,
                F.coalesce(F.get(c_from, j), F.size(c_lines)) - F.coalesce(F.get(c_to, j - 1), F.lit(0)),
            ),
        )
    )
    touched = pos.isNotNull() & F.col(text_col).isNotNull()
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(c_lines)).cast("long")
    joined = joined.withColumn(c_kept, F.when(touched, kept))
    out = joined.withColumns(
        {
            "n_lines": n_lines,
            "n_removed": F.when(touched, F.size(c_lines) - F.size(c_kept)).otherwise(0).cast("long"),
            text_col: F.when(touched, F.array_join(c_kept, "\n")).otherwise(F.col(text_col)),
        }
    )
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*[F.col(f"`{c}`") for c in names], "n_lines", "n_removed")
