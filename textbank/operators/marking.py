"""Marking of submissions: keywords and similarity, routes, objective keys, outcomes, overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textbank.functions.text import answer_letter, correct_letter, keyword_coverage, line_options, marking_reply, option_key, rubric_keywords, strip, text_or_empty, true_false, true_false_key
from textbank.functions.vectors import cosine

#: Similarity and coverage for full marks without a marker, and confidence for the middle route.
FULL_SIMILARITY, FULL_COVERAGE, MIDDLE = 0.92, 0.60, 0.55


def route(similarity: Column, coverage: Column, confidence: Column) -> Column:
    return F.when((similarity >= FULL_SIMILARITY) & (coverage >= FULL_COVERAGE), "HIGH").when(confidence >= MIDDLE, "MID").otherwise("LOW")


def pre_score(answers: DataFrame) -> DataFrame:
    """answers (answer_text, rubric, max_marks, answer_embedding, model_embedding) with keyword_coverage, semantic_similarity, confidence, route, provisional_mark."""
    coverage = F.round(keyword_coverage(F.col("answer_text"), rubric_keywords(F.col("rubric"))), 6)
    similarity = F.round(F.greatest(F.lit(0.0), cosine(F.col("answer_embedding"), F.col("model_embedding"))), 6)
    out = answers.withColumns({"keyword_coverage": coverage, "semantic_similarity": similarity}).withColumn("confidence", F.round(0.4 * F.col("keyword_coverage") + 0.6 * F.col("semantic_similarity"), 4))
    out = out.withColumn("route", route(F.col("semantic_similarity"), F.col("keyword_coverage"), F.col("confidence")))
    return out.withColumn("provisional_mark", F.when(F.col("route") == "HIGH", F.col("max_marks")).otherwise(F.round(F.col("confidence") * F.col("max_marks"), 2)))


def mark_objective(answers: DataFrame) -> DataFrame:
    """answers (answer_text, question_text, question_type, correct_answer, model_answer, max_marks) with key, correct, auto_mark, marking_route, is_flagged.

    The key is the stored one or what the model answer says; without one the answer is flagged with no marks.
    """
    options = line_options(F.col("question_text"))
    stored = F.nullif(strip(text_or_empty(F.col("correct_answer"))), F.lit(""))
    tf = F.col("question_type") == "true_false"
    key = F.when(tf, F.coalesce(F.when(true_false(stored).isNotNull(), F.when(true_false(stored), "True").otherwise("False")), F.when(strip(text_or_empty(F.col("model_answer"))) != "", true_false_key(F.col("model_answer"))))).otherwise(F.coalesce(answer_letter(stored, options), correct_letter(F.col("model_answer"), options)))
    given = F.when(tf, F.when(true_false(F.col("answer_text")), "True").when(~true_false(F.col("answer_text")), "False")).otherwise(answer_letter(F.col("answer_text"), options))
    same_text = ~tf & F.coalesce(option_key(F.col("answer_text")) == option_key(options[key]), F.lit(False))
    out = answers.withColumn("key", key)
    correct = F.when(F.col("key").isNotNull(), F.coalesce(given == F.col("key"), F.lit(False)) | same_text)
    return out.withColumns({"correct": correct, "auto_mark": F.when(correct, F.col("max_marks")).otherwise(0.0), "marking_route": F.when(F.col("key").isNull(), "LOW").otherwise("HIGH"), "is_flagged": F.col("key").isNull()})


def mark_subjective(scored: DataFrame) -> DataFrame:
    """scored (route, max_marks, raw) with auto_mark, auto_feedback and is_flagged: full marks on HIGH, else the marker's reply; LOW and unreadable replies are flagged."""
    reply = marking_reply(F.col("raw"), F.col("max_marks"))
    high = F.col("route") == "HIGH"
    return scored.withColumns(
        {
            "auto_mark": F.when(high, F.col("max_marks")).otherwise(F.coalesce(reply["mark"], F.lit(0.0))),
            "auto_feedback": F.when(high, "Full marks.").otherwise(reply["feedback"]),
            "is_flagged": ~high & ((F.col("route") == "LOW") | ~reply["parsed"]),
        }
    )


def outcome(scored: DataFrame) -> DataFrame:
    """_id, auto_mark, is_flagged, is_marked and feedback with its route and confidence in front."""
    # format_number rounds the double itself, ties to even; %.2f would round its shortest decimal form half up.
    prefix = F.format_string("[Route:%s Conf:%s] ", F.col("route"), F.call_function("format_number", F.col("confidence"), F.lit("0.00")))
    return scored.select("_id", "auto_mark", "is_flagged", F.lit(True).alias("is_marked"), F.concat(prefix, text_or_empty(F.col("auto_feedback"))).alias("auto_feedback"))


def failed_outcome(failures: DataFrame) -> DataFrame:
    """The outcome of a submission that could not be marked: no marks, flagged, with the reason."""
    return failures.select("_id", F.lit(0.0).alias("auto_mark"), F.lit(True).alias("is_flagged"), F.lit(True).alias("is_marked"), F.concat(F.lit("Marking failed: "), F.substring(text_or_empty(F.col("reason")), 1, 200)).alias("auto_feedback"))


def effective_feedback() -> Column:
    return F.coalesce(F.nullif(F.col("override_feedback"), F.lit("")), F.col("auto_feedback"))


def apply_overrides(submissions: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(submissions with the overrides' marks and cleared flags, audit rows with the mark before)."""
    new = overrides.select(F.col("submission_id").alias("_id"), F.col("override_mark").alias("new_mark"), "actor_id", "ts")
    joined = submissions.join(new, "_id", "left")
    hit = F.col("new_mark").isNotNull()
    before = F.coalesce("override_mark", "auto_mark")
    audit = joined.where(hit).select(F.lit("mark_override").alias("event_type"), "actor_id", F.col("_id").alias("submission_id"), "student_id", "question_id", before.alias("old_mark"), F.col("new_mark"), "ts")
    out = joined.withColumns({"override_mark": F.coalesce("new_mark", "override_mark"), "is_flagged": F.when(hit, F.lit(False)).otherwise(F.col("is_flagged"))}).drop("new_mark", "actor_id", "ts")
    return out, audit
