"""The registered queries of the training-data operators. Each reads its whole
tables below ``sf_dir`` and derives the columns of its result from its operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_trie, centroids, decontaminate, hard_negatives, language, ngram_join, packing, quality_ledger, substring, token_files, toxicity, url_model, warc
from .oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                       F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                       ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.spans(substring.links(table(spark, sf_dir, "documents"))).drop("key")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(table(spark, sf_dir, "pages"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents")).drop("key", "label")


def fold(parts: int) -> Column:
    """crc32 of doc_id as text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = language.identify(table(spark, sf_dir, "documents"), fold(3) != 1)
    return rows.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_model.score_urls(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "host", "path", "rule", "verdict", "score")


def op8_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_ledger.ledger(table(spark, sf_dir, "documents"))
    rows = quality_ledger.apply_policy(quality_ledger.apply_policy(rows, "base-1", column="base"), "web-1")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~F.col("base")).alias("base_failed"), "kept", "failed")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), fold(5) != 0))
    return rows.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


def op12_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe_trie.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                       F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_substring, op3_warc, op4_ngram_join, op5_language, op6_token_files, op7_url_model, op8_quality_ledger, op9_packing,
                                   op10_toxicity, op11_hard_negatives, op12_bpe_trie, op13_centroids)}
