"""The numbered queries: each applies its operator to whole tables and derives the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbank.llm import bpe, centroids, common, decontam, divergence, jaccard_join, language_id, licenses, quality_classifier, quality_rules, sentencepieces, substring_dedup, token_counts, toxicity

#: The rank file of the encoding query.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: The model file of the SentencePiece query.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Centroids, rounds, seed and components of the clustering query.
CENTROIDS, ROUNDS, SEED, COMPONENTS = 8, 10, 3, 64


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    sample = common.labelled_sample(docs, labels, "quality", common.remainder("doc_id", 3) != 1, quality_classifier.MAX_ROWS)
    scored = quality_classifier.quality(docs, quality_classifier.train(sample))
    return scored.select("doc_id", (common.remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every text: a cut in its first quarter, an insertion in its middle, a line at its end."""
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda at, length, new: F.struct(at.cast("int").alias("start"), F.lit(length).alias("length"), F.lit(new).alias("replacement"))
    docs = common.table(spark, sf_dir, "documents").withColumn("edits", F.array(edit(F.floor(n / 4), 3, ""), edit(F.floor(n / 2), 0, " and so, "), edit(n + 6, 0, "\nThe end.")))
    counted = token_counts.token_counts(docs, RANKS, public_tokenizers.PATTERN)
    return counted.select("doc_id", "n_before", "n_tokens", "n_pieces", "n_reencoded", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), "n_matches")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(common.table(spark, sf_dir, "documents")).drop("dup_line_chars", "dup_ngram_chars")


def bpe_digests(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of docs, by encoding and decoding."""
    return bpe.round_trip(docs, path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(common.table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    sample = common.labelled_sample(docs, labels, "toxic", common.remainder("doc_id", 5) != 0, toxicity.MAX_ROWS)
    scored = toxicity.toxicity(docs, toxicity.train(sample))
    return scored.select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(common.table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = language_id.train(language_id.sample(docs, common.remainder("doc_id", 4) != 2))
    found = language_id.language(docs, model)
    return found.select("doc_id", (common.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepieces.round_trip(common.table(spark, sf_dir, "documents"), PIECES)
    return coded.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    found = centroids.cluster(common.table(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS, order, COMPONENTS)
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)).drop("centroid")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.table(spark, sf_dir, "documents"))


QUERIES = (op1_quality_classifier, op2_token_counts, op3_license_scans, op4_byte_level_bpe, op5_quality_rules, op6_toxicity, op7_ngram_jaccard_join, op8_benchmark_decontamination, op9_language_id, op10_substring_dedup, op11_sentencepiece, op12_centroid_clustering, op13_source_divergence)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scans": licenses.SQL, "op5_quality_rules": quality_rules.SQL, "op7_ngram_jaccard_join": jaccard_join.SQL, "op8_benchmark_decontamination": decontam.SQL, "op10_substring_dedup": substring_dedup.SQL, "op12_centroid_clustering": centroids.sql(CENTROIDS, ROUNDS, SEED, COMPONENTS), "op13_source_divergence": divergence.SQL}
