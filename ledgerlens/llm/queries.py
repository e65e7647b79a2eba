"""The contract queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, imi, langid, linededup, media, neardup, packing, resample, secrets, tokencount, toxicity, whitening
from .common import fold, ship_package, table


def op1_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def vocabulary(name: str) -> str:
    """Where a public vocabulary is installed; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packing.with_crc(packed)


def op3_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imi.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def digest(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", secrets.kind_name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    base = digest(F.filter("secret_spans", lambda s: s["kind"] < 3))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"),
        F.sha2(base, 256).alias("base_sha256"), digest(F.col("secret_spans")).alias("spans"),
    )


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.tiktoken")
    back = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 5) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held)
    got = toxicity.score(docs, model)
    return got.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_texts(media.store_texts(table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) == 2
    return langid.identify(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = chat.END + chat.START + "assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(turns.unionByName(own))
    back = chat.read_chats(formatted.select(F.struct("conv_id", F.length("formatted").alias("chars")).alias("key"), "formatted", "mask"), "key")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("key.conv_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("key.chars").cast("long").alias("formatted_chars"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.remove_repeated_windows(docs).select("doc_id", "n_lines", "n_removed", "text")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))  # null where a long cannot hold it


_QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash_neardup, op2_cost_packing, op3_inverted_multi_index, op4_secret_scan, op5_bpe_codec, op6_toxicity, op7_media_columns, op8_language_id,
        op9_chat_format, op10_line_dedup, op11_importance_resampling, op12_token_counts, op13_embedding_whitening,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark, sf_dir):
            ship_package(spark)
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return run

    return {name: shipped(f) for name, f in _QUERIES.items()}


#: Plain SQL for the operators that SQL expresses whole.  Near-duplicates: all pairs with a common shingle.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') AS ws FROM documents),
l AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                          WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS shs FROM w),
s AS MATERIALIZED (SELECT doc_id, len(shs) AS n, unnest(shs) AS sh FROM l),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT a AS id, b AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT id, min(other) AS low FROM r GROUP BY id)
SELECT doc_id, CAST(len(shs) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(low, doc_id)) AS kept FROM l LEFT JOIN c ON doc_id = id"""

OP9_SQL = """
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
t AS (SELECT *, role IS DISTINCT FROM lag(role) OVER w AS fresh, row_number() OVER w AS k
      FROM own WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS said,
        coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum(length(replace(text, '<|', '<||')) + CASE WHEN fresh THEN 12 + length(role) + 1 + 11 ELSE 10 END) AS chars
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g"""

OP10_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, pos, lines[pos + 1] AS a, lines[pos + 2] AS b, lines[pos + 3] AS c
      FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS pos FROM d WHERE len(lines) >= 3)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k
      FROM w WHERE trim(a) <> '' OR trim(b) <> '' OR trim(c) <> ''),
gone AS (SELECT DISTINCT doc_id, pos + x AS line FROM r, (SELECT unnest(range(0, 3)) AS x) WHERE k > 1),
l AS (SELECT doc_id, unnest(lines) AS s, unnest(range(0, len(lines))) AS line FROM d WHERE text IS NOT NULL),
kept AS (SELECT l.doc_id, coalesce(string_agg(s, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '') AS text,
           count(*) AS n_lines, count(g.line) AS n_removed
         FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept.text
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_neardup": OP1_SQL, "op9_chat_format": OP9_SQL, "op10_line_dedup": OP10_SQL}
