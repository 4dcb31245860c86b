"""A corpus pipeline over ``documents``: quality rules, near-duplicates, secrets, mixing, SentencePiece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalex.llm import mixing, near_dup, quality_rules, secret_spans, sentence_pieces
from stratalex.llm.common import saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep. Null and empty texts have no words and go; repeated rows are
    judged alike; without labels only the base rules count. An empty table stays empty."""
    rules = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, rules).filter("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one of the smallest id, and of the smallest hash
    among texts of one id. Rows equal in id and text are one. Texts that no other is near to stay, whatever ids they share;
    null texts and texts without words are near to none. Rows without an id stay. An empty table stays empty."""
    named = docs.filter("doc_id is not null").withColumn("__hash", F.xxhash64("text"))
    found = near_dup.near_duplicates(named, near_dup.Near()).filter("first")
    # which rows stay is decided on ids and hashes; texts are moved once, to meet that decision
    kept = saved(found.groupBy("doc_id", F.col("text_hash").alias("__hash")).agg(F.count(F.lit(1)).alias("__n")), "kept")
    rows = named.join(kept.filter("__n = 1"), ["doc_id", "__hash"], "left_semi")
    if not (more := kept.filter("__n > 1")).isEmpty():
        rows = rows.unionByName(named.join(more, ["doc_id", "__hash"], "left_semi").dropDuplicates(["doc_id", "__hash"]))
    return rows.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark and n_chars brought up to date. Null and empty texts, and
    texts without secrets, stay as they are; repeated rows stay."""
    return secret_spans.redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of sources takes them. Null texts have no words and are not taken more than once;
    a null source is one source; rows that repeat an id and a text are taken alike. An empty table stays empty."""
    return mixing.mixed_documents(docs, [5, 2, 1])


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their texts in place of the texts, and whether decoding gave the text back. Null and empty
    texts have no ids; repeated rows get a row each."""
    return sentence_pieces.ids_for_texts(docs, verify=True)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("secret_scan", secrets), ("mixing", mixture), ("sentence_pieces", pieces)]

#: Learned rules, sketches, hashes and ids have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs.select(*[F.col(f"`{c}`") for c in docs.columns]), name)
    return docs
