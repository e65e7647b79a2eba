"""A corpus cleaning pipeline over the documents table, made of the training-data operators.

``STAGES`` lists (name, function) in order; a function takes (spark, docs, sf_dir) and returns what the
next one works on.  All but the last return the columns of documents.  ``run`` applies them to documents,
each stage's result being written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import linededup, neardup, packing, secrets, toxicity
from ledgerlens.llm.common import Scratch, fold, fresh, ship_package, table
from ledgerlens.llm.queries import vocabulary


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; labels are learned from the same folds as in op6."""
    ship_package(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    toxic = fresh(docs, "toxic")
    return toxicity.score(docs, model, out_col=toxic).filter(F.col(toxic) < 0.5).drop(toxic)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows leave the texts; no document goes.

    A document that is left empty stays as one without text, so that what becomes of each id can be told
    from the table; packing gives it its end mark only.
    """
    out = linededup.remove_repeated_windows(docs).select(*docs.columns)
    return _sized(out)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: that of the smallest id.

    Rows are told apart by id and text, so an id with two texts loses only the text that stands elsewhere.
    Of rows with one id and text, one stays.  Rows without words or without an id stay as they are.
    """
    ship_package(spark)
    found = Scratch(spark).keep(neardup.near_duplicates(docs).filter("doc_id is not null and n_shingles > 0").select("doc_id", "text_hash", "representative"), "found")
    key = fresh(docs, "text_hash")
    rows = docs.withColumn(key, F.xxhash64("text"))
    names = lambda df: df.select(F.col("doc_id"), F.col("text_hash").alias(key))
    stay = rows.join(names(found.filter("not representative")).distinct(), ["doc_id", key], "left_anti")
    again = names(found.filter("representative").groupBy("doc_id", "text_hash").count().filter("count > 1"))
    single, repeated = stay.join(again, ["doc_id", key], "left_anti"), stay.join(again, ["doc_id", key], "left_semi")
    return single.unionByName(repeated.dropDuplicates(["doc_id", key])).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret in a text is replaced by a mark; no document goes."""
    spans = fresh(docs, "spans")
    found = secrets.find_secrets(docs, out_col=spans)
    return _sized(secrets.redact(found, spans_col=spans).select(*docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids: one row per piece of a document, with its ids."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name)
        scratch.drop(last)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Toxicity is a trained model, which SQL does not express; tests compare with a brute-force version.
ORACLE_SQL = None
