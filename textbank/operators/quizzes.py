"""Timed quizzes: deadlines, endings, drafts, timing and access of submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textbank.functions.text import strip, text_or_empty

#: Seconds after the deadline that a strict quiz still accepts.
GRACE = 30
#: Characters of a draft answer.
DRAFT_CAP = 20_000


def seconds(a: Column, b: Column) -> Column:
    """Whole seconds from a to b."""
    return F.unix_timestamp(b) - F.unix_timestamp(a)


def deadline(started: Column, minutes: Column) -> Column:
    return started + F.make_dt_interval(mins=minutes)


def expired(mode: Column, deadline_at: Column, now: Column, grace: int = GRACE) -> Column:
    """Whether a strict attempt's deadline and grace have passed; never without a deadline."""
    return F.coalesce((mode == "strict") & (seconds(deadline_at, now) > grace), F.lit(False))


def finalise(attempts: DataFrame, now: Column) -> DataFrame:
    """attempts (started_at, deadline_at, timing_mode) with status, finished_at, duration_seconds and late_by_seconds as of now; an expired one ends at its deadline."""
    over = expired(F.col("timing_mode"), F.col("deadline_at"), now)
    out = attempts.withColumns({"status": F.when(over, "expired").otherwise("completed"), "finished_at": F.when(over, F.col("deadline_at")).otherwise(now)})
    late = F.when(F.col("deadline_at").isNotNull(), F.greatest(F.lit(0), seconds(F.col("deadline_at"), F.col("finished_at")))).otherwise(0)
    return out.withColumns({"duration_seconds": seconds(F.col("started_at"), F.col("finished_at")), "late_by_seconds": late.cast("long")})


def flush_drafts(attempts: DataFrame, quizzes: DataFrame, submissions: DataFrame) -> DataFrame:
    """attempt_id, student_id, question_id, answer_text: drafts with an answer, to questions of the quiz, that are not submitted yet."""
    drafts = attempts.select(F.col("_id").alias("attempt_id"), "quiz_id", "student_id", F.explode("draft_answers").alias("question_id", "answer_text")).withColumn("answer_text", strip(F.col("answer_text"))).where("answer_text <> ''")
    lines = quizzes.select(F.col("_id").alias("quiz_id"), F.explode("question_ids").alias("question_id")).distinct()
    return drafts.join(lines, ["quiz_id", "question_id"], "left_semi").join(submissions.select("student_id", "question_id"), ["student_id", "question_id"], "left_anti").select("attempt_id", "student_id", "question_id", "answer_text")


def timing_verdict(submissions: DataFrame, quizzes: DataFrame, attempts: DataFrame, grace: int = GRACE) -> DataFrame:
    """_id, quiz_id, verdict, late_by_seconds of each submission (_id, student_id, question_id, submitted_at).

    Of the student's quizzes with the question, one without a time limit accepts;
    else one that is under way, the first by its start, accepts or, if it is strict
    and its grace is over, rejects; a quiz not begun or finished rejects. A question
    in no quiz is accepted.
    """
    lines = quizzes.select(F.col("_id").alias("quiz_id"), "time_limit_minutes", "timing_mode", F.col("student_id"), F.explode(F.array_distinct("question_ids")).alias("question_id"))
    own = attempts.select("quiz_id", "student_id", "status", "started_at", "deadline_at")
    # Which quiz decides does not depend on the submission, so one is left for each student and question before submissions meet it.
    rank = F.when(F.col("time_limit_minutes").isNull(), 0).when(F.col("status") == "in_progress", 1).otherwise(2)
    first = F.min(F.struct(rank.alias("rank"), "started_at", "quiz_id", "time_limit_minutes", "timing_mode", "status", "deadline_at")).alias("r")
    decisive = lines.join(own, ["quiz_id", "student_id"], "left").groupBy("student_id", "question_id").agg(first).select("student_id", "question_id", "r.*")
    joined = submissions.join(decisive, ["student_id", "question_id"], "left")
    late = F.greatest(F.lit(0), F.coalesce(seconds(F.col("deadline_at"), F.col("submitted_at")), F.lit(0))).cast("long")
    verdict = (
        F.when(F.col("quiz_id").isNull() | F.col("time_limit_minutes").isNull(), "accepted")
        .when(F.col("status") == "in_progress", F.when((F.col("timing_mode") == "strict") & (late > grace), "time is over").otherwise("accepted"))
        .when(F.col("status").isNull(), "not started")
        .otherwise("finished")
    )
    best = F.row_number().over(Window.partitionBy("_id").orderBy("rank", "started_at", "quiz_id"))
    return joined.withColumns({"verdict": verdict, "late_by_seconds": F.when(F.col("time_limit_minutes").isNull(), F.lit(0)).otherwise(late).cast("long"), "n_": best}).where("n_ = 1").select("_id", "quiz_id", "verdict", "late_by_seconds")


def access_verdict(submissions: DataFrame, direct: DataFrame, through_quiz: DataFrame) -> DataFrame:
    """submissions with allowed: the question was given to the student directly or by a quiz."""
    either = direct.select("student_id", "question_id").unionByName(through_quiz.select("student_id", "question_id")).distinct().withColumn("allowed", F.lit(True))
    return submissions.join(either, ["student_id", "question_id"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def merge_drafts(old: Column, new: Column, question_ids: Column) -> Column:
    """Draft answers with the new ones in place of the old, to questions of the quiz only, each cut to its cap."""
    allowed = lambda m: F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: F.array_contains(question_ids, k))
    kept = F.map_filter(allowed(old), lambda k, _: ~F.map_contains_key(allowed(new), k))
    return F.transform_values(F.map_concat(kept, allowed(new)), lambda _, v: F.substring(text_or_empty(v), 1, DRAFT_CAP))


def hide_timed(quizzes: DataFrame, started: DataFrame) -> DataFrame:
    """quizzes (_id, student_id) with question_ids emptied where a time limit holds and the student has not started."""
    own = started.select(F.col("quiz_id").alias("_id"), "student_id", F.lit(True).alias("started_")).distinct()
    visible = F.col("time_limit_minutes").isNull() | F.coalesce("started_", F.lit(False))
    return quizzes.join(own, ["_id", "student_id"], "left").withColumn("question_ids", F.when(visible, F.col("question_ids")).otherwise(F.array().cast(quizzes.schema["question_ids"].dataType))).drop("started_")
