"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdgraph.llm import bpe, chat, codes, licenses, mixing, neardup, negatives, ngramjoin, packing, substring, tokens, topk, toxicity
from holdgraph.llm.session import table, with_small_batches

BYTE_RANKS = "byte_bpe_50k.tiktoken"
BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest_repeats(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_components(table(spark, sf_dir, "documents"))


#: A conversation that is formatted beside the table's: its texts hold marks and escapes.
PLANTED_TEXT = r"\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED_TEXT), (-7, 1, "assistant", PLANTED_TEXT)], turns.schema)
    ranks = public_tokenizers.path(BYTE_RANKS)
    return chat.round_trip(turns.unionByName(planted), ranks)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id's label is moved on by one, so that labels and vectors disagree there."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: with_small_batches(f)
    for f in (
        op1_token_counts,
        op2_substring_dedup,
        op3_best_fit_packing,
        op4_ngram_jaccard_join,
        op5_chat_format,
        op6_toxicity,
        op7_embedding_near_dedup,
        op8_bpe_round_trip,
        op9_exact_top_k,
        op10_license_scan,
        op11_source_mix,
        op12_hard_negatives,
        op13_vector_codes,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(w[s + 1 : s + 20], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 19, 0))) AS s FROM d)
), again AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY words ORDER BY doc_id, s) AS k FROM win) WHERE k > 1
), gone AS (SELECT DISTINCT doc_id, s + o AS p FROM again, (SELECT unnest(range(20)) AS o)),
word AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS x FROM d),
part AS (
  SELECT word.doc_id, count(*) AS n, count(gone.p) AS removed, string_agg(x, ' ' ORDER BY word.p) FILTER (gone.p IS NULL) AS kept
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p GROUP BY word.doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN part ON d.doc_id = part.doc_id""",
    "op10_license_scan": licenses.SCAN_SQL,
    "op11_source_mix": mixing.MIX_SQL,
    "op12_hard_negatives": negatives.MINE_SQL,
    "op13_vector_codes": codes.CODES_SQL,
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[s + 1 : s + 5], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(CASE WHEN len(w) >= 5 THEN len(w) - 4 WHEN len(w) > 0 THEN 1 ELSE 0 END)) AS s FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
link AS (
  SELECT p.a, p.b FROM (SELECT u.doc_id AS a, v.doc_id AS b, count(*) AS i FROM g u JOIN g v ON u.x = v.x AND u.doc_id <> v.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * i >= 80 * (na.n + nb.n - i)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT link.a, reach.r FROM reach JOIN link ON link.b = reach.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id""",
    "op7_embedding_near_dedup": """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id <> y.vec_id AND list_cosine_similarity(x.v, y.v) >= 0.9
), reach(vec_id, r) AS (
  SELECT vec_id, vec_id FROM e UNION SELECT link.a, reach.r FROM reach JOIN link ON link.b = reach.vec_id
), part AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
SELECT part.vec_id, (SELECT count(*) FROM link WHERE link.a = part.vec_id) AS n_links, component_id, part.vec_id = component_id AS kept FROM part""",
    "op9_exact_top_k": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
), pair AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pair) WHERE rank <= 20""",
    "op5_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *,
    length(replace(replace(replace(replace(role, '\', '\\'), '<turn>', '<\turn>'), '<says>', '<\says>'), '</turn>', '<\/turn>'))
    + length(replace(replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '<says>', '<\says>'), '</turn>', '<\/turn>'))
    + length('<turn>') + length('<says>') + length('</turn>') AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
}
