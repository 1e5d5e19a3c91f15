"""Reports over submissions, questions, books and attempts; paging, joins and sets of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textbank.operators.containment import containment
from textbank.operators.folds import numbered


def effective(override: str = "override_mark", auto: str = "auto_mark") -> Column:
    return F.coalesce(F.col(override), F.col(auto))


def share(condition: Column) -> Column:
    """Share of rows where the condition holds, 0 without rows."""
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0))


def pipeline_stats(submissions: DataFrame) -> DataFrame:
    """Per marking route: number, percent of all, mean confidence and mark, flagged and overridden rows."""
    by = submissions.groupBy(F.coalesce("marking_route", F.lit("unknown")).alias("route")).agg(
        F.count("*").alias("n"),
        F.round(F.avg("auto_confidence"), 4).alias("avg_confidence"),
        F.round(F.avg("auto_mark"), 4).alias("avg_mark"),
        F.sum(F.coalesce(F.col("is_flagged"), F.lit(False)).cast("long")).alias("n_flagged"),
        F.count("override_mark").alias("n_overridden"),
    )
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total)).withColumn("pct", F.round(100 * F.col("n") / F.col("total"), 2)).drop("total")


def pipeline_totals(submissions: DataFrame) -> DataFrame:
    return submissions.agg(
        F.count("*").alias("n"),
        F.round(F.coalesce(F.avg("auto_confidence"), F.lit(0.0)), 4).alias("avg_confidence"),
        F.round(share(F.col("is_flagged")), 4).alias("flagged_rate"),
        F.round(share(F.col("override_mark").isNotNull()), 4).alias("override_rate"),
    )


def question_accuracy(submissions: DataFrame, questions: DataFrame, preview: int = 80) -> DataFrame:
    """Per question, also unanswered ones: submissions, mean mark and confidence, flagged rate, mean change by overrides."""
    delta = F.when(F.col("override_mark").isNotNull(), F.col("override_mark") - F.col("auto_mark"))
    by = submissions.groupBy("question_id").agg(
        F.count("*").alias("n"), F.avg("auto_mark").alias("mark"), F.avg("auto_confidence").alias("confidence"), share(F.col("is_flagged")).alias("flagged"), F.avg(delta).alias("delta")
    )
    text = F.when(F.length("question_text") > preview, F.concat(F.substring("question_text", 1, preview), F.lit("…"))).otherwise(F.col("question_text"))
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 4)
    return questions.join(by, questions["_id"] == by["question_id"], "left").select(
        questions["_id"].alias("question_id"), text.alias("preview"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), zero("mark").alias("avg_mark"), zero("confidence").alias("avg_confidence"), zero("flagged").alias("flagged_rate"), zero("delta").alias("override_delta")
    )


def confidence_histogram(submissions: DataFrame, bins: int = 20) -> DataFrame:
    """Number of confidences in each of equal bins of [0, 1], the last one closed; empty bins too."""
    placed = submissions.where("auto_confidence IS NOT NULL").select(F.least(F.floor(F.col("auto_confidence") * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    every = submissions.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(placed.groupBy("bin").agg(F.count("*").alias("n")), "bin", "left").select("bin", F.round(F.col("bin") / bins, 4).alias("low"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def counts_by(rows: DataFrame, column: str) -> DataFrame:
    """Rows per value of a column; null counts as unknown."""
    return rows.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def distributions(rows: DataFrame, columns: list[str]) -> DataFrame:
    """counts_by for several columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("n"))


def book_stats(chunks: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Per book: chunks, different topics, first and last page, and how many chunks meet each condition of flags."""
    return chunks.groupBy("book_id").agg(
        F.count("*").alias("n_chunks"), F.array_join(F.array_sort(F.collect_set("topic_tag")), ",").alias("topics"), F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"), *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in flags.items()]
    )


def chapter_titles(chunks: DataFrame, most: int = 30) -> DataFrame:
    """Per book and chapter number the shortest title without dot leaders; the first chapters only, as a book's report shows them."""
    title = F.trim(F.regexp_replace("chapter_title", r"[ .]*\.{2,}[ .]*\d*$", ""))
    by = chunks.where("chapter_num IS NOT NULL").groupBy("book_id", "chapter_num").agg(F.min(F.struct(F.length(title).alias("n"), title.alias("title"))).alias("t"))
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_num"))
    return by.withColumn("place", place).where(F.col("place") <= most).select("book_id", "chapter_num", "t.title")


def discover_chapters(chunks: DataFrame) -> DataFrame:
    """Per book and chapter number the topic of its first page, and its chunks."""
    return chunks.groupBy("book_id", "chapter_num").agg(F.min_by("topic_tag", F.struct("page_start", "_id")).alias("topic"), F.count("*").alias("n_chunks"))


def _places(value: Column, n: int) -> Column:
    """Rounded half away from zero as the double it is, not by its shortest decimal form."""
    rounded = F.round(value * 10.0**n) / 10.0**n
    return F.when(F.abs(rounded) == float("inf"), value).otherwise(rounded)


def student_scores(submissions: DataFrame, questions: DataFrame) -> DataFrame:
    """Per student: earned and possible marks, percent, and submissions known not to be marked yet.

    Marks are summed as doubles one by one in the order of the submissions' ids (of the marks themselves, if there are no
    ids), so that a sum on half a tenth of a percent falls the same way wherever the rows lie.
    """
    joined = submissions.join(questions.select(F.col("_id").alias("question_id"), "max_marks"), "question_id", "left")
    ids = [c for c in submissions.columns if c == "_id"]
    rows = joined.select("student_id", *ids, F.coalesce(effective(), F.lit(0.0)).alias("mark_"), "max_marks", "is_marked").repartition("student_id").sortWithinPartitions("student_id", *ids, "mark_")
    sums = rows.groupBy("student_id").agg(F.sum("mark_").alias("sum_"), F.sum("max_marks").alias("most_"), F.count_if(~F.col("is_marked")).alias("n_pending"))
    pct = F.try_divide(100 * F.col("sum_"), F.col("most_"))
    return sums.select("student_id", _places(F.col("sum_"), 6).alias("earned"), F.coalesce("most_", F.lit(0.0)).alias("possible"), _places(pct, 1).alias("pct"), "n_pending")


def dashboard(submissions: DataFrame) -> DataFrame:
    flag = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return submissions.agg(flag(~F.coalesce("is_marked", F.lit(False))).alias("n_pending"), flag(F.coalesce("is_flagged", F.lit(False))).alias("n_flagged"))


def quiz_sizes(quizzes: DataFrame, questions: DataFrame) -> DataFrame:
    """Per quiz: questions, those known, and their marks in all."""
    lines = quizzes.select(F.col("_id").alias("quiz_id"), F.explode("question_ids").alias("question_id")).join(questions.select(F.col("_id").alias("question_id"), "max_marks"), "question_id", "left")
    return lines.groupBy("quiz_id").agg(F.count("*").alias("n_questions"), F.count("max_marks").alias("n_known"), F.coalesce(F.sum("max_marks"), F.lit(0.0)).alias("total_marks"))


def ordered_questions(quizzes: DataFrame, questions: DataFrame) -> DataFrame:
    """quiz_id, place, question_id: a quiz's known questions in its order, numbered anew."""
    lines = quizzes.select(F.col("_id").alias("quiz_id"), F.posexplode("question_ids").alias("pos", "question_id")).join(questions.select(F.col("_id").alias("question_id")), "question_id")
    return lines.select("quiz_id", F.row_number().over(Window.partitionBy("quiz_id").orderBy("pos")).alias("place"), "question_id")


def reachable_questions(quizzes: DataFrame, untimed_only: bool = False) -> DataFrame:
    """student_id, question_id: what a student's quizzes contain, each pair once."""
    own = quizzes.where("time_limit_minutes IS NULL") if untimed_only else quizzes
    return own.select("student_id", F.explode("question_ids").alias("question_id")).distinct()


def unknown_ids(ids: DataFrame, known: DataFrame) -> DataFrame:
    """owner, ids: per owner the sorted different ids that are not known; owners without such ids are left out."""
    return ids.select("owner", "id").join(known.select("id").distinct(), "id", "left_anti").groupBy("owner").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def page(rows: DataFrame, order: list[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of a report: limit rows after skip, in order."""
    return rows.orderBy(*order).offset(skip).limit(limit)


def round_robin(rows: DataFrame, group: str, score: str, limit: int) -> DataFrame:
    """The best row of each group, then the second of each, and so on; groups in order of their best row.

    A group never gives more than `limit` rows, so Spark cuts each to that many
    before it is sorted, and the best of a group is that of its first turn.
    """
    own = Window.partitionBy(group).orderBy(F.desc(score), "_id")
    ranked = rows.withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= limit)
    best = F.first(score).over(Window.partitionBy(group).orderBy("turn"))
    return ranked.withColumn("best", best).orderBy("turn", F.desc("best"), group).limit(limit)


def diverse_selection(chunks: DataFrame, limit: int, topic: str | None = None, least: float = 0.15, few: int = 5) -> DataFrame:
    """The chunks (_id, chapter_num, topic_tag, score) to ask about: all columns and turn.

    Chunks of a chapter above 0 are the source, or all if there is none. Of these
    the ones whose topic contains the wanted text, in any case, and that score
    above `least` take turns by topic, topics in order of their best score, each
    giving its best chunk left, up to `limit`. If no such chunk is left, the first
    `few` of the source by _id are taken, all in turn 1. What decides between the
    cases is counted over all rows; a topic is cut to `limit` rows before any sort.
    A null topic is '', a null score or chapter 0.
    """
    rows = chunks.withColumns({"topic_tag": F.coalesce("topic_tag", F.lit("")), "score": F.coalesce("score", F.lit(0.0)), "chapter_num": F.coalesce("chapter_num", F.lit(0))})
    in_topic = F.contains(F.lower("topic_tag"), F.lit((topic or "").lower()))
    fit = in_topic & (F.col("score") > least)
    some = lambda c: F.coalesce(F.max(c), F.lit(False))
    chaptered = F.col("chapter_num") > 0
    seen = rows.agg(some(chaptered).alias("chapters"), some(fit & chaptered).alias("fit_in_chapters"), some(fit).alias("fit_at_all")).first()
    source = rows.where(chaptered) if seen["chapters"] else rows
    if not (seen["fit_in_chapters"] if seen["chapters"] else seen["fit_at_all"]):
        return source.orderBy("_id").limit(few).withColumn("turn", F.lit(1))
    return round_robin(source.where(fit), "topic_tag", "score", limit).drop("best")


def prefer(rows: DataFrame, condition: Column, k: int) -> DataFrame:
    """The k best rows of each query, those that meet the condition first."""
    own = Window.partitionBy("query_id").orderBy(F.when(condition, 0).otherwise(1), "rank")
    return rows.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k)


def every_nth(rows: DataFrame, group: str, order: list[str], stride: int) -> DataFrame:
    """Every stride-th row of a group, from the first: a systematic sample."""
    return numbered(rows, [group], order, "place").withColumn("place", F.col("place") - 1).where(F.col("place") % stride == 0)


def uncovered_concepts(concepts: DataFrame, questions: DataFrame) -> DataFrame:
    """concept: different concepts that stand in no question (_id, text), in any case; a null one is in none."""
    different = concepts.select("concept").distinct()
    covered = containment(different.withColumn("needle", F.col("concept")), questions, "concept").select("concept").distinct()
    return different.join(covered, "concept", "left_anti")


def missing_pages(rows: DataFrame) -> DataFrame:
    """book_id, first, last: runs of pages from 0 to the greatest page of all books that a book (book_id, page) lacks.

    Gaps are read off the sorted pages of a book, so the work grows with the pages
    there are and not with those that there might be.
    """
    last = rows.agg(F.max("page").alias("greatest"))
    own = Window.partitionBy("book_id").orderBy("page")
    pages = rows.select("book_id", F.col("page").cast("long").alias("page")).where("page IS NOT NULL").distinct()
    before = pages.select("book_id", (F.coalesce(F.lag("page").over(own), F.lit(-1)) + 1).alias("first"), (F.col("page") - 1).alias("last"))
    behind = pages.groupBy("book_id").agg((F.max("page") + 1).alias("first")).join(F.broadcast(last)).select("book_id", "first", F.col("greatest").cast("long").alias("last"))
    return before.unionByName(behind).where("first <= last")


def attempt_roster(attempts: DataFrame, submissions: DataFrame, quizzes: DataFrame, questions: DataFrame) -> DataFrame:
    """Per attempt: questions, answered and marked ones, score (null if none is marked) and possible marks (null if 0)."""
    lines = quizzes.select(F.col("_id").alias("quiz_id"), F.explode("question_ids").alias("question_id")).distinct().join(questions.select(F.col("_id").alias("question_id"), "max_marks"), "question_id", "left")
    own = attempts.select(F.col("_id").alias("attempt_id"), "quiz_id", "student_id").join(lines, "quiz_id")
    subs = submissions.groupBy("student_id", "question_id").agg(F.max("is_marked").alias("is_marked"), F.max(F.struct("submitted_at", "_id", effective().alias("mark"))).alias("last"))
    joined = own.join(subs, ["student_id", "question_id"], "left")
    marked = F.coalesce("is_marked", F.lit(False))
    return joined.groupBy("attempt_id").agg(
        F.count("*").alias("n_questions"), F.count("last").alias("n_answered"), F.sum(marked.cast("long")).alias("n_marked"), F.round(F.sum(F.when(marked, F.col("last.mark"))), 6).alias("score"), F.nullif(F.coalesce(F.sum("max_marks"), F.lit(0.0)), F.lit(0.0)).alias("max_score")
    )
