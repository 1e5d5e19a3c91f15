"""A corpus pipeline of five stages over documents; each stage works on all that its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns the columns of documents
(doc_id, text, lang, source, n_chars), the last one token ids. No stage looks at
lang or source. Further columns of docs are ignored, whatever their names; an
empty table gives an empty one. Nulls in any column are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textbank.llm import common, decontam, jaccard_join, quality_classifier, substring_dedup
from textbank.llm.common import cut
from textbank.llm.queries import RANKS, bpe_digests

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among them whose crc32(doc_id) mod 3 is not 1.

    A null or empty text is judged as one without words, a score of exactly 0.5
    is accepted, and repeated rows share their fate. Without labelled documents
    all have that score and stay.
    """
    sample = common.labelled_sample(docs, common.table(spark, sf_dir, "labels"), "quality", common.remainder("doc_id", 3) != 1, quality_classifier.MAX_ROWS)
    return quality_classifier.accepted(docs.select(*COLUMNS), quality_classifier.train(sample))


def _row_key() -> Column:
    """A 64-bit hash of id and text, null or not: rows that share it are the same document."""
    return F.xxhash64("doc_id", "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: one of least doc_id, a null id after all others.

    Rows are told apart by id and text, so ids may repeat or be null; of rows
    equal in both one stays, the least by its other columns. Among texts of one
    least id any one stays. Texts without a word, null ones too, are in no group
    and all stay.
    """
    keyed = docs.select(*COLUMNS, _row_key().alias("key"))
    found = jaccard_join.jaccard_join(keyed.select(F.col("key").alias("doc_id"), "text")).where("n_shingles > 0")
    members = cut(found.groupBy(F.col("doc_id").alias("key"), "component_id").agg(F.count("*").alias("copies")))
    crowded = members.groupBy("component_id").agg(F.sum("copies").alias("n")).where("n > 1").select("component_id")
    members = cut(members.join(crowded, "component_id", "left_semi"))
    ids = keyed.select("key", "doc_id").join(common.small(members.select("key")), "key", "left_semi").distinct()
    first = members.join(ids, "key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key"))["key"].alias("key"))
    members = cut(members.join(first.select("key", F.lit(True).alias("first")), "key", "left").select("key", "copies", F.col("first").isNotNull().alias("first")))
    out = keyed.join(common.small(cut(members.where("NOT first OR copies > 1").select("key"))), "key", "left_anti").select(*COLUMNS)
    repeated = cut(members.where("first AND copies > 1").select("key"))
    if repeated.isEmpty():
        return out
    one = keyed.join(common.small(repeated), "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return out.unionByName(one.select("row.*"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document has; one with nothing left goes.

    A text that loses no word stays as it is, null and empty ones too; else its
    words are joined by single spaces. Rows without an id lose nothing and are no
    source; rows of one id, repeated ones too, never cost each other words.
    """
    found = substring_dedup.substring_dedup(docs, carry=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    whole = F.col("n_removed") == 0
    return found.where(whole | (F.col("n_removed") < F.col("n_words"))).select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; rows are told apart by id and text.

    Null and empty texts are clean; repeated rows stay or go together. An empty
    benchmark, or one of texts without words, contaminates nothing.
    """
    keyed = docs.select(*COLUMNS, _row_key().alias("key"))
    found = decontam.decontaminate(keyed.select(F.col("key").alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    dropped = common.small(cut(found.where("contaminated").select(F.col("doc_id").alias("key")).distinct()))
    return keyed.join(dropped, "key", "left_anti").select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the token ids and of the text that they decode to; a null text counts as empty, each row gives one."""
    return bpe_digests(docs, RANKS)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_free),
    ("byte-level BPE", token_ids),
]
#: The first stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all of documents; what each stage kept is computed once."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
