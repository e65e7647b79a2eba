import os

import pytest
from pyspark.sql import functions as F
from test_lines_chat import brute as brute_lines
from test_neardup import brute as brute_groups
from test_secrets import brute as brute_secrets

import corpus_pipeline
from ledgerlens.llm import toxicity
from ledgerlens.llm.common import Scratch, fold

P = pytest.importorskip("public_tokenizers")
DATA = os.environ.get("LEDGERLENS_TESTDATA", "/root/testdata")


@pytest.mark.parametrize("sf_dir", [f"{DATA}/sf0.001", f"{DATA}/sf0.01"])
def test_pipeline_matches_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = Scratch(spark).keep(stage(spark, got, sf_dir), name)
        assert got.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in got.collect()}
        assert all(r.n_chars == len(r.text) for r in got.collect())
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(F.col("doc_id"), 5) != 0)
    want = {r.doc_id: r.text for r in docs.collect() if model.score(r.text) < 0.5}
    assert kept["toxicity"] == want
    want = brute_lines(sorted(want.items()))
    assert kept["line_dedup"] == want
    want = {i: want[i] for i, _, _, stays in brute_groups(sorted(want.items())) if stays}
    assert kept["near_dedup"] == want
    assert kept["secret_scan"].keys() == want.keys()
    for i, text in kept["secret_scan"].items():
        assert not brute_secrets(text.replace("[SECRET]", " ")), text
        if "[SECRET]" not in text:
            assert text == want[i]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: r.start):
        assert len(ids.setdefault(r.doc_id, [])) == r.start
        ids[r.doc_id] += r.ids
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert ids == {i: t.encode(x, add_special_tokens=False).ids + [0] for i, x in kept["secret_scan"].items()}


def test_pipeline_on_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "password=abcdef x", "en", None, 17), (3, "password=abcdef x", "en", None, 17)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, rows in (("full", docs), ("empty", docs.filter("false"))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert sorted(r.doc_id for r in got) == ([1, 2, 3] if name == "full" else [])


def test_near_dedup_stage_keeps_every_text_once(spark):
    """An id with two texts loses only the one that stands elsewhere; repeated rows and clashing column names."""
    a, b = " ".join("a%d" % k for k in range(12)), " ".join("b%d" % k for k in range(14))
    rows = [(3, a, "x"), (7, a, "x"), (7, b, "y"), (7, b, "y"), (9, b + " more", "z"), (5, "", "e"), (5, "", "e"), (None, a, "n"), (None, a, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string")
    got = corpus_pipeline.dedup_documents(spark, docs, "")
    assert got.columns == docs.columns
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in got.collect()), key=key) == [(None, a, "n"), (None, a, "n"), (3, a, "x"), (5, "", "e"), (5, "", "e"), (7, b, "y")]
