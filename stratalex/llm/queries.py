"""The queries of this package, with production parameters, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_cnn as op

    docs = table(spark, sf_dir, "documents")
    return op.score(docs, op.train(docs, table(spark, sf_dir, "labels")))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import projected_ann as op

    return op.nearest(table(spark, sf_dir, "embeddings"))


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sentence_pieces as op

    return op.ids_for_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), verify=True)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import edit_counts as op

    return op.count_tokens(table(spark, sf_dir, "documents"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dup as op

    return op.near_duplicates(table(spark, sf_dir, "documents"), op.CONTRACT).select("doc_id", "n_shingles", "component_id", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules as op

    docs = table(spark, sf_dir, "documents")
    rows = op.judged(docs, op.train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing as op

    return op.mix_sizes(table(spark, sf_dir, "documents"), [5, 2, 1])


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import reply_trees as op

    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    return op.digests(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding as op

    rows = op.shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_spans as op

    return op.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), listed AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length('<turn ' || replace(replace(replace(role, '\', '\\'), '>', '\g'), chr(10), '\n') || '>' || chr(10)
      || regexp_replace(text, '<(\\*/?turn)', '<\\\1', 'g') || chr(10) || '</turn>' || chr(10))) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM listed
"""


NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3
      THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes m ON m.doc_id = x JOIN sizes n ON n.doc_id = y WHERE 100 * c >= 85 * (m.n + n.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
least AS (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(y, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_near_duplicates": NEAR_SQL, "op8_chat_format": CHAT_SQL}
