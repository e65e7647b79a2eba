"""Importance resampling towards a target set, by hashed counts of word runs.

A document's features are its runs of 1 to ``n`` words.  Separators are collapsed to single blanks, and one
overlapped search per run length gives the spans of all runs; the bytes of each span are hashed where they
stand.  A bucket's gain compares how often target and raw documents fall into it; documents are drawn without
replacement by the mean gain of their features plus Gumbel noise that their ids determine.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, ship_package

#: Bytes that are no part of a word once A-Z are lower case; all bytes of letters beyond ASCII are.
_TO_BLANK = bytes(32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
_BLANKS = regex.compile(rb" {2,}")


def collapsed(text: bytes) -> bytes:
    """Lower-case words of ``text`` with one blank between two."""
    return _BLANKS.sub(b" ", text.lower().translate(_TO_BLANK)).strip(b" ")


def run_patterns(n: int) -> list[regex.Pattern]:
    """Patterns of runs of 1 to ``n`` words in collapsed text, for overlapped search; none starts or ends inside a word."""
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % k) for k in range(n)]


def hashed_runs(text: bytes, patterns: list[regex.Pattern], buckets: int) -> list[np.ndarray]:
    """For each pattern the buckets of its runs, in order of their starts."""
    flat = collapsed(text)
    return [
        np.fromiter((zlib.crc32(m[0]) for m in p.finditer(flat, overlapped=True)), dtype=np.uint32) % np.uint32(buckets)
        for p in patterns
    ]


def _features(docs: DataFrame, id_col: str, text_col: str, n: int, buckets: int) -> DataFrame:
    """(id, n_words, runs): ``runs`` are the sorted buckets as 32-bit numbers, so equal neighbours compress."""

    def run(batches):
        patterns = run_patterns(n)
        for rb in batches:
            words, packed = [], []
            for text in rb.column(1):
                found = hashed_runs(text.as_py() or b"", patterns, buckets)
                words.append(len(found[0]))
                packed.append(np.sort(np.concatenate(found)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(words, pa.int64()), pa.array(packed, pa.binary())], names=["id", "n_words", "runs"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return src.mapInArrow(run, "id long, n_words long, runs binary")


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket.  Tasks count first; the driver gets ``buckets`` numbers."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for rb in batches:
            for runs in rb.column(0):
                total += np.bincount(np.frombuffer(runs.as_py(), dtype="<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "c"])

    sums = features.select("runs").mapInArrow(run, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c"))
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, c in sums.collect():
        out[bucket] = c
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed target and raw shares, per bucket, rounded down."""
    k, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + k)) / float((s + 1) * (t_all + k)))) for s, t in zip(raw.tolist(), target.tolist())], dtype=np.int64)


def gumbel(key: object, seed: int) -> int:
    """Thousandths of a Gumbel draw that ``seed`` and ``key`` determine, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(features: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    def run(batches):
        for rb in batches:
            sizes, weights, scores = [], [], []
            for key, runs in zip(rb.column(0).to_pylist(), rb.column(2)):
                at = np.frombuffer(runs.as_py(), dtype="<u4")
                weight = int(gain[at].sum()) // len(at) if len(at) else 0
                sizes.append(len(at))
                weights.append(weight)
                scores.append(None if key is None else weight + gumbel(key, seed))
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), rb.column(1), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64()), pa.array(scores, pa.int64())],
                names=["id", "n_words", "n_features", "weight", "score"],
            )

    return features.mapInArrow(run, "id long, n_words long, n_features long, weight long, score long")


def _ranked(scratch: Scratch, rows: DataFrame, draws: int) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, ... by falling score, then id; null beyond ``draws``.

    Rows are dealt by ranges and numbered within a range; equal rows are told apart by their place in the
    table, so that copies of one row need not share a range.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("id"), F.col("__place")]
    dealt = rows.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = scratch.keep(dealt.drop("__place").withColumn("__i", F.monotonically_increasing_id()), "dealt")
    part, low = F.shiftright("__i", 33), F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = [], 0
    for p, c in sorted(dealt.groupBy(part.alias("p")).count().collect()):  # one row a range
        before.append((p, total))
        total += c
    offsets = rows.sparkSession.createDataFrame(before, "__p long, __before long")
    out = dealt.withColumn("__p", part).join(F.broadcast(offsets), "__p").withColumn("rank", F.col("__before") + low + 1)
    return out.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank"))).drop("__i", "__p", "__before")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", *,
    n: int = 2, buckets: int = 10000, percent: int = 25, min_words: int = 20, seed: int = 7,
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_features, weight, score, rank.

    Of the rows with an id and at least ``min_words`` words, ``percent`` in a hundred (rounded down) are drawn:
    those of highest score, ties to the smaller id; ``rank`` counts them from 1 and is null for the others.
    ``weight`` is the mean gain of a row's features, rounded down; ``score`` adds the row's Gumbel noise.

    Null and empty texts have no features and weight 0.  Null ids have no score and are never drawn, but their
    features count for the raw distribution.  Repeated rows are drawn each for itself (same id: same noise).
    An empty target, or one without words, leaves smoothed raw shares alone to weigh.  Empty ``docs``: no
    rows.  Only the named columns are read, so others may have any name.  Texts are read once: what is kept of
    them is four bytes a feature.  The driver gets ``buckets`` numbers per side, the number of rows per
    distinct score (at most some 10^5: a score is a whole number, and a gain is at most 1000 ln of all features), and
    one row for each shuffle partition.
    """
    spark = docs.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    raw = scratch.keep(_features(docs, id_col, text_col, n, buckets), "runs")
    nobody = fresh(target, "no_id")
    wanted = _features(target.withColumn(nobody, F.lit(None).cast("long")), nobody, target_text_col, n, buckets)
    gain = gains(bucket_counts(raw, buckets), bucket_counts(wanted, buckets))
    scored = scratch.keep(_scored(raw, gain, seed), "scored")
    scratch.drop(raw)
    able = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    per_score = sorted(scored.filter(able).groupBy("score").count().collect(), reverse=True)
    draws, seen, cut = percent * sum(c for _, c in per_score) // 100, 0, None
    for score, c in per_score:
        if seen >= draws:
            break
        seen, cut = seen + c, score
    rest = F.lit(None).cast("long").alias("rank")
    if cut is None:
        out = scored.select("*", rest)
    else:
        near = F.coalesce(able & (F.col("score") >= cut), F.lit(False))
        out = _ranked(scratch, scored.filter(near), draws).unionByName(scored.filter(~near).select("*", rest))
    return out.withColumnRenamed("id", id_col)
