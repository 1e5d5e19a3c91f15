"""Checks of a corpus: coverage, vectors, texts, chapters, links, duplicates, scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbank.functions.text import matches, strip


def _n(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))


def page_coverage(chunks: DataFrame, pages: DataFrame, widest: int = 50, blank: int = 20) -> DataFrame:
    """book_id, page, state of every page that is expected or covered: covered, blank, missing or extra.

    chunks has book_id, page_start and page_end, a range wider than `widest` counting
    with its first page alone; pages has book_id, page and text.
    """
    end = F.when(F.col("page_end") - F.col("page_start") > widest, F.col("page_start")).otherwise(F.greatest("page_start", "page_end"))
    covered = chunks.select("book_id", F.explode(F.sequence("page_start", end)).alias("page")).distinct().withColumn("c_", F.lit(True))
    expected = pages.select("book_id", "page", (F.length(strip(F.coalesce("text", F.lit("")))) < blank).alias("blank_"))
    state = F.when(F.col("c_") & F.col("blank_").isNotNull(), "covered").when(F.col("blank_").isNull(), "extra").when(F.col("blank_"), "blank").otherwise("missing")
    return expected.join(covered, ["book_id", "page"], "full").select("book_id", "page", state.alias("state"))


def coverage_summary(states: DataFrame) -> DataFrame:
    n = lambda s: _n(F.col("state") == s).alias(f"n_{s}")
    return states.groupBy("book_id").agg(n("covered"), n("blank"), n("missing"), n("extra"), F.round(F.try_divide(100 * _n(F.col("state") == "covered"), _n(F.col("state") != "extra")), 2).alias("pct"))


def vector_check(rows: DataFrame, width: int) -> DataFrame:
    e = F.col("embedding")
    missing = e.isNull() | (F.size(e) == 0)
    return rows.agg(F.count("*").alias("n"), _n(missing).alias("n_missing"), _n(~missing & (F.size(e) != width)).alias("n_wrong"), _n(~missing & (F.size(e) == width)).alias("n_ok"))


def text_check(rows: DataFrame, by: str) -> DataFrame:
    n = F.length("text")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(n), 2).alias("avg_length"), _n(n < 100).alias("n_tiny"), _n((n >= 100) & (n < 300)).alias("n_short"))


def chapter_gaps(chunks: DataFrame) -> DataFrame:
    """book_id, chapter_num of chapters that a book skips."""
    have = chunks.where("chapter_num > 0").select("book_id", "chapter_num").distinct()
    every = have.groupBy("book_id").agg(F.max("chapter_num").alias("m")).select("book_id", F.explode(F.sequence(F.lit(1), "m")).alias("chapter_num"))
    return every.join(have, ["book_id", "chapter_num"], "left_anti")


def richness(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Number and percent of rows that meet each condition."""
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), F.coalesce(c, F.lit(False)).cast("int").alias("hit")) for k, c in flags.items()])
    return rows.select(F.inline(pairs)).groupBy("feature").agg(F.sum("hit").alias("n"), F.round(100 * F.avg("hit"), 2).alias("pct"))


def issues(summary: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """book_id, severity, issue: every rule (severity, text, condition) that holds."""
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(t).alias("issue"))) for s, t, c in rules]))
    return summary.select("book_id", F.inline(found))


def boundary_rate(rows: DataFrame, by: str) -> DataFrame:
    """Share of texts that end where a sentence may end."""
    return rows.groupBy(by).agg(F.round(F.avg(strip(F.col("text")).rlike(r"[.!?:;)\]\"'|]$").cast("double")), 4).alias("rate"))


def linkage_rate(entries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per index the share of entries whose chunk exists."""
    known = chunks.select(F.col("_id").alias("parent_chunk_id")).distinct().withColumn("k_", F.lit(1.0))
    return entries.join(known, "parent_chunk_id", "left").groupBy("index").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("k_", F.lit(0.0))), 4).alias("rate"))


def junk_rate(formulas: DataFrame) -> DataFrame:
    """Formulas that are too short or a stand-in."""
    bad = (F.length(strip(F.col("formula_latex"))) < 4) | matches(F.col("formula_latex"), r"^\s*(n/?a|none|null|unknown|\?+)\s*$")
    return formulas.agg(F.count("*").alias("n"), _n(bad).alias("n_junk"), F.round(F.coalesce(F.avg(bad.cast("double")), F.lit(0.0)), 4).alias("rate"))


def duplicate_counts(entries: DataFrame, parent: str, normal: str) -> DataFrame:
    """True duplicates (same parent and text) and repeats elsewhere (same text, another parent)."""
    by = entries.groupBy(parent, normal).agg(F.count("*").alias("n"))
    totals = by.groupBy(normal).agg(F.sum("n").alias("n"), F.count("*").alias("p"))
    return totals.agg(F.sum(F.col("n") - F.col("p")).alias("n_duplicates"), F.sum(F.col("p") - 1).alias("n_repeats"))


def is_prose(c: Column) -> Column:
    """Formulas that are rather sentences: eight words and no operator."""
    return (F.regexp_count(c, F.lit("[A-Za-z]{2,}")) >= 8) & ~c.rlike(r"[=+√∑∫±≤≥^\\]")


def capture(found: DataFrame, truth: DataFrame) -> DataFrame:
    """kind, n_found, n_true, pct; null percent where there is nothing to find."""
    return truth.join(found, "kind", "left").select("kind", F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"), "n_true", F.round(F.try_divide(100.0 * F.coalesce("n_found", F.lit(0)), F.col("n_true")), 2).alias("pct"))


def scorecard(measures: DataFrame, thresholds: dict[str, tuple[float, float]]) -> DataFrame:
    """measure, value, verdict: PASS from the first threshold, WARN from the second, else FAIL; SKIP without value or threshold."""
    rows = F.array(*[F.struct(F.lit(k).alias("measure"), F.lit(float(a)).alias("pass_"), F.lit(float(b)).alias("warn_")) for k, (a, b) in thresholds.items()])
    limits = measures.sparkSession.range(1).select(F.inline(rows))
    v = F.col("value")
    return measures.join(F.broadcast(limits), "measure", "left").select("measure", "value", F.when(v.isNull() | F.col("pass_").isNull(), "SKIP").when(v >= F.col("pass_"), "PASS").when(v >= F.col("warn_"), "WARN").otherwise("FAIL").alias("verdict"))


def marker_counts(pages: DataFrame) -> DataFrame:
    """Structural marks per book: examples, solutions, practice boxes, numbered items."""
    n = lambda p: F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p))).cast("long")
    return pages.groupBy("book_id").agg(n(r"(?md)^\s*(?:EXAMPLE|Example)\s+\d").alias("n_examples"), n(r"(?md)^\s*(?:SOLUTION|Solution)\b").alias("n_solutions"), n(r"(?md)^\s*(?:TRY\s*IT|Try\s*It)\b").alias("n_try_its"), n(r"(?md)^\s*\d{1,3}\.\s+[A-Z]").alias("n_numbered"))
