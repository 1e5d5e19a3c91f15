"""Retrieval evaluation with binary relevance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from textbank.functions.text import let
from textbank.operators.common import BROADCAST_ROWS, cut, small
from textbank.operators.containment import containment
from textbank.operators.folds import numbered


def relevant(page_start: Column, page_end: Column, text: Column, pages: Column, contains: Column) -> Column:
    """Whether a document overlaps an expected page or contains an expected string, in any case; false without expectation."""
    on_page = F.coalesce(F.arrays_overlap(F.sequence(page_start, F.coalesce(page_end, page_start)), pages), F.lit(False))
    needles = F.filter(F.coalesce(contains, F.array().cast("array<string>")), lambda s: F.length(F.trim(s)) > 0)
    held = F.exists(needles, lambda s: F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(s)))
    return on_page | held


def _triples(text: Column) -> Column:
    """The different runs of three words, in lower case, a space between words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    at = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1)))
    runs = let(words, lambda w: F.transform(at(w), lambda i: F.when(F.size(w) >= i + 2, F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))))
    return F.array_distinct(F.array_compact(runs))


_WORDS = re.compile("[a-z0-9]+").findall


def _met(docs: DataFrame, wanted: list[tuple[int, str]]) -> DataFrame:
    """_id, triple: which of the wanted triples of words a document has, once each; documents are read once and not moved."""
    kind = StructType([StructField("_id", docs.schema["_id"].dataType), StructField("triple", LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {tuple(words.split(" ")): no for no, words in wanted}
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                w = _WORDS(text or "")
                own = {no for no in map(number.get, zip(w, w[1:], w[2:])) if no is not None}
                at += [i] * len(own)
                found += own
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.int64())], names=["_id", "triple"])

    return docs.select("_id", F.lower(F.col("text").cast("string")).alias("text")).mapInArrow(scan, kind)


def shared_triples(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, _id, shared, n: how many of the n different word triples of a query (query_id, text) a document (_id, text) has, if it has any.

    A query meets only what shares a triple with it. Up to BROADCAST_ROWS different
    triples go to every task, which looks its documents' up in them; more of them
    are joined to those of the documents.
    """
    own = cut(queries.select("query_id", F.explode(_triples(F.col("text"))).alias("words")).distinct())
    n = own.groupBy("query_id").agg(F.count("*").alias("n"))
    wanted = cut(own.select("words").distinct().withColumn("triple", F.monotonically_increasing_id()))
    if wanted.count() <= BROADCAST_ROWS:
        found = _met(docs, [(r["triple"], r["words"]) for r in wanted.collect()])
    else:
        found = docs.select("_id", F.explode(_triples(F.col("text"))).alias("words")).distinct().join(wanted, "words").select("_id", "triple")
    met = found.join(small(cut(own.join(wanted, "words").select("query_id", "triple"))), "triple").groupBy("query_id", "_id").agg(F.count("*").alias("shared"))
    return met.join(n, "query_id")


def judged_by_containment(queries: DataFrame, docs: DataFrame, most: int = 20, specialist: str = "fused") -> tuple[DataFrame, DataFrame]:
    """(judged, relevant): the `most` documents that share most triples with each query, and all that contain it.

    judged has query_id, _id, specialist, rank and relevant; relevant has query_id
    and _id. A document is relevant if it contains the query's text, in any case,
    however short the text is and wherever in a word it begins or ends.
    """
    held = cut(containment(queries.select("query_id", F.col("text").alias("needle")), docs))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("shared"), "_id"))
    top = shared_triples(queries, docs).withColumn("rank", place).where(F.col("rank") <= most).join(held.withColumn("relevant", F.lit(True)), ["query_id", "_id"], "left")
    return top.select("query_id", "_id", F.lit(specialist).alias("specialist"), "rank", F.coalesce("relevant", F.lit(False)).alias("relevant")), held


def expected_rows(expected: DataFrame, rows: DataFrame, fields: list[str]) -> DataFrame:
    """query_id, _id: rows that meet what a golden query expects, by page or by a string in any of the text fields, in any case.

    expected has query_id, pages (array) and contains (array of strings), either
    may be null; rows has _id, page_start, page_end (null: page_start) and the
    fields, which are read as one text with spaces between. Pages are joined page
    by page, strings by containment, so nothing meets what it does not match.
    """
    pages = expected.select("query_id", F.explode(F.array_distinct("pages")).alias("page"))
    spans = rows.where("page_start IS NOT NULL").select("_id", F.explode(F.sequence(F.col("page_start").cast("long"), F.greatest(F.coalesce("page_end", "page_start"), F.col("page_start")).cast("long"))).alias("page"))
    by_page = spans.join(pages.select("query_id", F.col("page").cast("long").alias("page")), "page").select("query_id", "_id")
    text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    by_text = containment(expected.select("query_id", F.explode("contains").alias("needle")), rows.select("_id", text.alias("text")))
    return by_page.unionByName(by_text).distinct()


def score_queries(judged: DataFrame, pairs: DataFrame, totals: DataFrame, k: int = 8) -> DataFrame:
    """query_id, specialist and hit_at_k, recall_at_k, mrr, ndcg_at_k, n_returned, n_relevant for every row of pairs.

    judged has query_id, specialist, rank from 1 and relevant; pairs (query_id,
    specialist) lists what to score, empty lists too; totals has query_id and
    total_relevant. The ideal of nDCG takes the relevant rows that were returned.
    """
    rel = F.col("relevant").cast("int")
    gain = F.when(F.col("rank") <= k, rel / F.log2(F.col("rank") + 1)).otherwise(0.0)
    scored = judged.groupBy("query_id", "specialist").agg(
        F.max(F.when(F.col("rank") <= k, rel).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("rank") <= k, rel).otherwise(0)).alias("found"),
        F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.sum(gain).alias("dcg"),
        F.sum(rel).alias("n_relevant"),
        F.count("*").alias("n_returned"),
    )
    n = F.least(F.coalesce("n_relevant", F.lit(0)), F.lit(k)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return (
        pairs.join(scored, ["query_id", "specialist"], "left")
        .join(totals, "query_id", "left")
        .select(
            "query_id",
            "specialist",
            zero(F.col("hit").cast("double")).alias("hit_at_k"),
            F.round(zero(F.try_divide(F.col("found").cast("double"), F.col("total_relevant"))), 6).alias("recall_at_k"),
            F.round(zero(1 / F.col("first")), 6).alias("mrr"),
            F.round(F.when(n > 0, zero(F.col("dcg")) / ideal).otherwise(0.0), 6).alias("ndcg_at_k"),
            F.coalesce("n_returned", F.lit(0)).cast("long").alias("n_returned"),
            F.coalesce("n_relevant", F.lit(0)).cast("long").alias("n_relevant"),
        )
    )


#: Specialists in the order in which the fused list takes them; parents of specialist rows close the text list.
SPECIALISTS = ("text", "formula", "figure", "table")


def golden_scores(expected: DataFrame, found: DataFrame, rows: DataFrame, fields: list[str], k: int = 8) -> DataFrame:
    """score_queries for golden queries: every specialist's list and "fused", all lists one after the other.

    expected has query_id, pages and contains as for expected_rows; found has
    query_group (the query_id), kind, _id and place, as routed_retrieve gives;
    rows has every row of the indexes once, with its pages and text fields. What
    meets an expectation is counted per query before anything is joined to it.
    """
    met = cut(expected_rows(expected, rows, fields))
    parent = F.col("kind") == "parent"
    own = found.select(F.col("query_group").alias("query_id"), F.when(parent, "text").otherwise(F.col("kind")).alias("specialist"), parent.cast("int").alias("late"), "place", "_id")
    order = F.array_position(F.array(*map(F.lit, SPECIALISTS)), F.col("specialist"))
    listed = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "specialist").orderBy("late", "place", "_id")))
    fused = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "late", "place", "_id"))).withColumn("specialist", F.lit("fused"))
    judged = listed.unionByName(fused).select("query_id", "specialist", "rank", "_id").join(met.withColumn("relevant", F.lit(True)), ["query_id", "_id"], "left")
    judged = judged.withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    pairs = expected.select("query_id", F.explode(F.array(*map(F.lit, (*SPECIALISTS, "fused")))).alias("specialist"))
    return score_queries(judged, pairs, met.groupBy("query_id").agg(F.count("*").alias("total_relevant")), k)


def mean_scores(scores: DataFrame) -> DataFrame:
    """Per specialist the mean of each measure, to four places, and the number of queries."""
    return scores.groupBy("specialist").agg(*[F.round(F.avg(c), 4).alias(c) for c in ("hit_at_k", "recall_at_k", "mrr", "ndcg_at_k")], F.count("*").alias("n_queries"))


def weakest(scores: DataFrame, specialist: str = "fused", n: int = 3) -> DataFrame:
    """The n queries of least reciprocal rank."""
    return scores.where(F.col("specialist") == specialist).orderBy("mrr", "query_id").limit(n).select("query_id", "mrr")


def auto_golden(chunks: DataFrame, stride: int = 10) -> DataFrame:
    """query, book_id, pages from every stride-th chunk of a book: its section title and first four key terms, expecting its own pages."""
    return (
        numbered(chunks, ["book_id"], ["page_start", "_id"], "place_")
        .where((F.col("place_") - 1) % stride == 0)
        .select("book_id", "_id", F.concat_ws(" ", "section_title", F.slice("key_terms", 1, 4)).alias("query"), F.sequence("page_start", "page_end").alias("pages"))
    )
