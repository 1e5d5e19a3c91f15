"""Queries of reports, joins, sets and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textbank.functions import text as T
from textbank.operators import analytics, sets
from textbank.plans import inputs
from textbank.plans.inputs import QUESTIONS, SUBMISSIONS
from textbank.plans.registry import query

#: quizzes() in SQL.
_QUIZ = """quiz AS (SELECT o_orderkey AS _id, o_custkey AS student_id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS question_ids, any_value(o_orderpriority) AS pr
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"""


def _simple(name: str, sql: str, f) -> None:  # noqa: ANN001
    query(name, sql)(f)


_simple(
    "AG-1_pipeline_stats",
    f"""WITH {SUBMISSIONS} SELECT coalesce(marking_route, 'unknown') AS route, count(*) AS n, round(avg(auto_confidence), 4) AS avg_confidence, round(avg(auto_mark), 4) AS avg_mark,
      CAST(count(*) FILTER (is_flagged) AS BIGINT) AS n_flagged, count(override_mark) AS n_overridden, round(100 * count(*) / (SELECT count(*) FROM submissions), 2) AS pct FROM submissions GROUP BY 1""",
    lambda s, d: analytics.pipeline_stats(inputs.submissions(s, d)),
)
_simple(
    "AG-2_pipeline_totals",
    f"WITH {SUBMISSIONS} SELECT count(*) AS n, round(avg(auto_confidence), 4) AS avg_confidence, round(avg(CAST(is_flagged AS INT)), 4) AS flagged_rate, round(count(override_mark) / count(*), 4) AS override_rate FROM submissions",
    lambda s, d: analytics.pipeline_totals(inputs.submissions(s, d)),
)
_simple(
    "AG-3_question_accuracy",
    f"""WITH {SUBMISSIONS}, {QUESTIONS} SELECT q._id AS question_id, CASE WHEN length(any_value(question_text)) > 80 THEN substr(any_value(question_text), 1, 80) || '…' ELSE any_value(question_text) END AS preview, count(s._id) AS n,
      round(coalesce(avg(auto_mark), 0), 4) AS avg_mark, round(coalesce(avg(auto_confidence), 0), 4) AS avg_confidence, round(coalesce(avg(CAST(is_flagged AS INT)), 0), 4) AS flagged_rate,
      round(coalesce(avg(override_mark - auto_mark), 0), 4) AS override_delta FROM questions q LEFT JOIN submissions s ON s.question_id = q._id GROUP BY q._id""",
    lambda s, d: analytics.question_accuracy(inputs.submissions(s, d), inputs.questions(s, d)),
)
_simple(
    "AG-4_confidence_histogram",
    f"""WITH {SUBMISSIONS}, h AS (SELECT least(CAST(floor(auto_confidence * 20) AS INT), 19) AS bin, count(*) AS n FROM submissions GROUP BY 1)
      SELECT CAST(b AS INTEGER) AS bin, round(b / 20, 4) AS low, coalesce(n, 0) AS n FROM range(20) AS t(b) LEFT JOIN h ON h.bin = b""",
    lambda s, d: analytics.confidence_histogram(inputs.submissions(s, d)),
)
_simple("AG-5_topic_counts", f"WITH {QUESTIONS} SELECT topic_tag AS value, count(*) AS n FROM questions GROUP BY 1", lambda s, d: analytics.counts_by(inputs.questions(s, d), "topic_tag"))
_simple(
    "AG-6_book_stats",
    """SELECT source AS book_id, count(*) AS n_chunks, string_agg(DISTINCT lang, ',' ORDER BY lang) AS topics, CAST(min(doc_id) AS INTEGER) AS first_page, CAST(max(doc_id) AS INTEGER) AS last_page,
      CAST(count(*) FILTER (contains(text, '|')) AS BIGINT) AS with_tables, CAST(count(*) FILTER (regexp_matches(text, '[=%]')) AS BIGINT) AS with_math FROM documents GROUP BY 1""",
    lambda s, d: analytics.book_stats(inputs.chunks(s, d), {"with_tables": F.col("text").contains("|"), "with_math": F.col("text").rlike("[=%]")}),
)


def _chaptered(s: SparkSession, d: str) -> DataFrame:
    c = inputs.chunks(s, d)
    return c.withColumns({"chapter_num": (F.col("_id") % 17).cast("int"), "chapter_title": F.concat(F.regexp_extract("text", "^[^ ]*", 0), F.when(F.col("_id") % 2 == 0, " .... 12").otherwise(""))})


_CHAPTERED = "c AS (SELECT doc_id AS _id, source AS book_id, lang AS topic_tag, text, CAST(doc_id AS INTEGER) AS page_start, CAST(doc_id % 17 AS INTEGER) AS chapter_num, regexp_extract(text, '^[^ ]*') || CASE WHEN doc_id % 2 = 0 THEN ' .... 12' ELSE '' END AS chapter_title FROM documents)"
_simple(
    "AG-7_chapter_titles",
    f"""WITH {_CHAPTERED}, t AS (SELECT book_id, chapter_num, trim(regexp_replace(chapter_title, '[ .]*\\.{{2,}}[ .]*\\d*$', '')) AS title FROM c)
      SELECT book_id, chapter_num, title FROM t QUALIFY row_number() OVER (PARTITION BY book_id, chapter_num ORDER BY length(title), title) = 1""",
    lambda s, d: analytics.chapter_titles(_chaptered(s, d)),
)
_simple(
    "AG-8_discover_chapters",
    f"WITH {_CHAPTERED} SELECT book_id, chapter_num, arg_min(topic_tag, page_start) AS topic, count(*) AS n_chunks FROM c GROUP BY 1, 2",
    lambda s, d: analytics.discover_chapters(_chaptered(s, d)),
)
_simple("AG-9_counts", "SELECT count(*) AS n FROM part", lambda s, d: inputs.questions(s, d).agg(F.count("*").alias("n")))
_simple(
    "AG-10_dashboard",
    f"WITH {SUBMISSIONS} SELECT count(*) FILTER (NOT is_marked) AS n_pending, count(*) FILTER (is_flagged) AS n_flagged FROM submissions",
    lambda s, d: analytics.dashboard(inputs.submissions(s, d)),
)
_simple(
    "AG-11_student_scores",
    f"""WITH {SUBMISSIONS}, {QUESTIONS} SELECT student_id, round(sum(coalesce(override_mark, auto_mark, 0)), 6) AS earned, coalesce(sum(max_marks), 0) AS possible,
      round(100 * sum(coalesce(override_mark, auto_mark, 0)) / nullif(sum(max_marks), 0), 1) AS pct, count(*) FILTER (NOT is_marked) AS n_pending
      FROM submissions s LEFT JOIN questions q ON q._id = s.question_id GROUP BY 1""",
    lambda s, d: analytics.student_scores(inputs.submissions(s, d), inputs.questions(s, d)),
)


def _attempts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each order is a quiz; a student's number is the customer's modulo 150, as in events; questions are dealt over the hundred answered ones."""
    q = inputs.quizzes(s, d).withColumn("question_ids", F.transform("question_ids", lambda x: x % 100))
    return q.select((F.col("_id") + 1).alias("_id"), F.col("_id").alias("quiz_id"), (F.col("student_id") % 150).alias("student_id")), q


def _roster(s: SparkSession, d: str) -> DataFrame:
    attempts, quizzes = _attempts(s, d)
    return analytics.attempt_roster(attempts, inputs.submissions(s, d), quizzes, inputs.questions(s, d))


_simple(
    "AG-12_attempt_roster",
    f"""WITH {SUBMISSIONS}, {QUESTIONS}, l AS (SELECT DISTINCT o_orderkey, o_custkey % 150 AS student_id, l_partkey % 100 AS question_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
      s AS (SELECT student_id, question_id, bool_or(is_marked) AS is_marked, arg_max(coalesce(override_mark, auto_mark), (submitted_at, _id)) AS mark FROM submissions GROUP BY 1, 2)
      SELECT o_orderkey + 1 AS attempt_id, count(*) AS n_questions, count(s.mark) AS n_answered, CAST(count(*) FILTER (is_marked) AS BIGINT) AS n_marked, round(sum(mark) FILTER (is_marked), 6) AS score, sum(max_marks) AS max_score
      FROM l LEFT JOIN questions q ON q._id = l.question_id LEFT JOIN s ON s.student_id = l.student_id AND s.question_id = l.question_id GROUP BY 1""",
    _roster,
)
_simple(
    "AG-13_quiz_sizes",
    f"WITH {QUESTIONS} SELECT l_orderkey AS quiz_id, count(*) AS n_questions, count(q._id) AS n_known, coalesce(sum(max_marks), 0) AS total_marks FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN questions q ON q._id = l_partkey GROUP BY 1",
    lambda s, d: analytics.quiz_sizes(inputs.quizzes(s, d), inputs.questions(s, d)),
)
_simple(
    "AG-14_distributions",
    f"WITH {QUESTIONS} SELECT 'difficulty' AS field, difficulty AS value, count(*) AS n FROM questions GROUP BY 2 UNION ALL SELECT 'bloom_level', bloom_level, count(*) FROM questions GROUP BY 2 UNION ALL SELECT 'chapter_num', CAST(chapter_num AS VARCHAR), count(*) FROM questions GROUP BY 2",
    lambda s, d: analytics.distributions(inputs.questions(s, d), ["difficulty", "bloom_level", "chapter_num"]),
)
_simple("AG-15_distinct_books", "SELECT DISTINCT source AS book_id FROM documents", lambda s, d: inputs.chunks(s, d).select("book_id").distinct())
_simple(
    "AG-16_topics_covered",
    f"WITH {QUESTIONS} SELECT chapter_num, string_agg(DISTINCT topic_tag, ',' ORDER BY topic_tag) AS topics FROM questions GROUP BY 1",
    lambda s, d: inputs.questions(s, d).groupBy("chapter_num").agg(F.array_join(F.array_sort(F.collect_set("topic_tag")), ",").alias("topics")),
)
_simple(
    "AG-17_attempt_progress",
    f"""WITH {SUBMISSIONS}, l AS (SELECT DISTINCT o_orderkey AS quiz_id, o_custkey % 150 AS student_id, l_partkey % 100 AS question_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
      s AS (SELECT DISTINCT student_id, question_id FROM submissions)
      SELECT quiz_id, count(s.question_id) AS n_submitted, CAST(count(*) FILTER (s.question_id IS NULL) AS BIGINT) AS n_open FROM l LEFT JOIN s USING (student_id, question_id) GROUP BY 1""",
    lambda s, d: _attempts(s, d)[1]
    .select(F.col("_id").alias("quiz_id"), (F.col("student_id") % 150).alias("student_id"), F.explode(F.array_distinct("question_ids")).alias("question_id"))
    .join(inputs.submissions(s, d).select("student_id", "question_id", F.lit(1).alias("hit")).distinct(), ["student_id", "question_id"], "left")
    .groupBy("quiz_id")
    .agg(F.count("hit").alias("n_submitted"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("n_open")),
)

# Joins.
_simple(
    "JN-1_submission_questions",
    f"WITH {SUBMISSIONS}, {QUESTIONS} SELECT s._id, s.student_id, q.question_text, q.max_marks FROM submissions s LEFT JOIN questions q ON q._id = s.question_id WHERE s.is_flagged",
    lambda s, d: inputs.submissions(s, d).where("is_flagged").join(inputs.questions(s, d).select(F.col("_id").alias("question_id"), "question_text", "max_marks"), "question_id", "left").select("_id", "student_id", "question_text", "max_marks"),
)
_simple(
    "JN-2_marks_export",
    f"""WITH {SUBMISSIONS}, {QUESTIONS} SELECT s._id, coalesce(c_name, '') AS student, CASE WHEN regexp_matches(q.question_text, '^[ \\t\\r\\n]*[=+\\-@]') THEN '''' || substr(q.question_text, 1, 120) ELSE substr(q.question_text, 1, 120) END AS question,
      round(coalesce(override_mark, auto_mark), 6) AS mark, CASE WHEN override_mark IS NULL THEN '0' ELSE '1' END AS overridden, strftime(submitted_at, '%Y-%m-%dT%H:%M:%S') AS submitted_at
      FROM submissions s LEFT JOIN customer ON c_custkey = s.student_id LEFT JOIN questions q ON q._id = s.question_id""",
    lambda s, d: inputs.submissions(s, d)
    .join(inputs.table(s, d, "customer").select(F.col("c_custkey").alias("student_id"), "c_name"), "student_id", "left")
    .join(inputs.questions(s, d).select(F.col("_id").alias("question_id"), "question_text"), "question_id", "left")
    .select("_id", F.coalesce("c_name", F.lit("")).alias("student"), T.safe_csv(F.substring("question_text", 1, 120)).alias("question"), F.round(analytics.effective(), 6).alias("mark"), F.when(F.col("override_mark").isNull(), "0").otherwise("1").alias("overridden"), F.date_format("submitted_at", "yyyy-MM-dd'T'HH:mm:ss").alias("submitted_at")),
)
_simple(
    "JN-5_ordered_questions",
    "SELECT l_orderkey AS quiz_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS INTEGER) AS place, l_partkey AS question_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey",
    lambda s, d: analytics.ordered_questions(inputs.quizzes(s, d), inputs.questions(s, d)),
)
_simple(
    "JN-6_reachable_questions",
    "SELECT DISTINCT o_custkey AS student_id, l_partkey AS question_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '5-LOW'",
    lambda s, d: analytics.reachable_questions(inputs.quizzes(s, d), untimed_only=True),
)
_simple(
    "JN-7_open_drafts",
    f"WITH {SUBMISSIONS} SELECT DISTINCT o_custkey % 150 AS student_id, l_partkey % 100 AS question_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE NOT EXISTS (SELECT 1 FROM submissions s WHERE s.student_id = o_custkey % 150 AND s.question_id = l_partkey % 100)",
    lambda s, d: analytics.reachable_questions(_attempts(s, d)[1].withColumn("student_id", F.col("student_id") % 150)).join(inputs.submissions(s, d).select("student_id", "question_id"), ["student_id", "question_id"], "left_anti"),
)
_simple(
    "JN-8_unknown_ids",
    "SELECT l_orderkey AS owner, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS ids FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 30) GROUP BY 1",
    lambda s, d: analytics.unknown_ids(
        inputs.table(s, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_partkey").cast("string").alias("id")), inputs.table(s, d, "part").where("p_size < 30").select(F.col("p_partkey").cast("string").alias("id"))
    ).withColumn("ids", F.array_join("ids", ",")),
)
_simple(
    "JN-12_library",
    f"WITH {_CHAPTERED} SELECT c.book_id, count(*) AS n_chunks, (SELECT count(*) FROM conversations v WHERE 'src' || CAST(v.conv_id % 20 AS VARCHAR) = c.book_id) AS n_jobs FROM c GROUP BY 1",
    lambda s, d: inputs.chunks(s, d)
    .groupBy("book_id")
    .agg(F.count("*").alias("n_chunks"))
    .join(inputs.table(s, d, "conversations").groupBy(F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("book_id")).agg(F.count("*").alias("n_jobs")), "book_id", "left")
    .withColumn("n_jobs", F.coalesce("n_jobs", F.lit(0))),
)
_simple(
    "JN-13_direct_only",
    "SELECT DISTINCT l_suppkey AS student_id, l_partkey AS question_id FROM lineitem EXCEPT SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    lambda s, d: inputs.table(s, d, "lineitem").select(F.col("l_suppkey").alias("student_id"), F.col("l_partkey").alias("question_id")).distinct().join(analytics.reachable_questions(inputs.quizzes(s, d)), ["student_id", "question_id"], "left_anti"),
)
_simple(
    "JN-11_uncovered_concepts",
    "WITH concepts AS (SELECT DISTINCT p_type AS concept FROM part), q AS (SELECT p_name || ' ' || p_brand AS t FROM part) SELECT concept FROM concepts c WHERE NOT EXISTS (SELECT 1 FROM q WHERE contains(lower(q.t), lower(c.concept)))",
    lambda s, d: analytics.uncovered_concepts(inputs.table(s, d, "part").select(F.col("p_type").alias("concept")), inputs.table(s, d, "part").select(F.col("p_partkey").alias("_id"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))),
)

# Sets.
_simple(
    "ST-1_assessment_union",
    "SELECT l_suppkey AS student_id, l_partkey AS question_id FROM lineitem UNION SELECT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '5-LOW'",
    lambda s, d: inputs.table(s, d, "lineitem").select(F.col("l_suppkey").alias("student_id"), F.col("l_partkey").alias("question_id")).unionByName(analytics.reachable_questions(inputs.quizzes(s, d), untimed_only=True)).distinct(),
)
_simple(
    "ST-2_distinct_in_order",
    f"WITH {_QUIZ}, u AS (SELECT _id, unnest(question_ids) % 50 AS x, generate_subscripts(question_ids, 1) AS i FROM quiz), f AS (SELECT _id, x, min(i) AS i FROM u GROUP BY 1, 2) SELECT _id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY i) AS ids FROM f GROUP BY 1",
    lambda s, d: inputs.quizzes(s, d).select("_id", F.array_join(F.array_distinct(F.transform("question_ids", lambda x: (x % 50).cast("string"))), ",").alias("ids")),
)
_simple(
    "ST-4_page_difference",
    "WITH e AS (SELECT source AS book_id, unnest(range(0, (SELECT max(doc_id) + 1 FROM documents))) AS page FROM (SELECT DISTINCT source FROM documents)) SELECT book_id, CAST(page AS BIGINT) AS page FROM e EXCEPT SELECT source, doc_id FROM documents",
    lambda s, d: analytics.missing_pages(inputs.chunks(s, d).select("book_id", F.col("_id").alias("page"))).select("book_id", F.explode(F.sequence("first", "last")).alias("page")),
)
_simple(
    "ST-5_token_intersection",
    "SELECT conv_id, turn, CAST(len(list_intersect(list_distinct(string_split(lower(text), ' ')), list_distinct(string_split(lower(prev), ' ')))) AS INTEGER) AS n_shared FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE prev IS NOT NULL",
    lambda s, d: sets.shared_with_previous(inputs.table(s, d, "conversations")),
)

# Rankings and pages.
_simple(
    "WN-1_page",
    f"WITH {SUBMISSIONS} SELECT _id, student_id FROM submissions ORDER BY submitted_at DESC, _id LIMIT 100 OFFSET 50",
    lambda s, d: analytics.page(inputs.submissions(s, d), [F.desc("submitted_at"), F.col("_id")], 50, 100).select("_id", "student_id"),
)
_simple(
    "WN-3_round_robin",
    "WITH r AS (SELECT doc_id AS _id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS turn, max(n_chars) OVER (PARTITION BY lang) AS best FROM documents) SELECT _id, CAST(turn AS INTEGER) AS turn FROM r ORDER BY turn, best DESC, lang LIMIT 25",
    lambda s, d: analytics.round_robin(inputs.table(s, d, "documents").withColumnRenamed("doc_id", "_id"), "lang", "n_chars", 25).select("_id", "turn"),
)
_CHUNK_SCORES = "SELECT doc_id AS _id, doc_id % 9 AS chapter_num, lang || source AS topic_tag, least(n_chars / 20000.0, 1.0) AS score FROM documents"
for _name, _topic, _least in (("by_topic", "src1", 0.15), ("all", "", 0.15), ("fallback", "no such topic", 0.15)):
    _simple(
        f"WN-3_diverse_selection_{_name}",
        f"WITH c AS ({_CHUNK_SCORES}), s AS (SELECT * FROM c WHERE chapter_num > 0), p AS (SELECT *, row_number() OVER (PARTITION BY topic_tag ORDER BY score DESC, _id) AS turn, max(score) OVER (PARTITION BY topic_tag) AS best FROM s WHERE contains(topic_tag, '{_topic}') AND score > {_least}), "
        "t AS (SELECT _id, turn FROM p ORDER BY turn, best DESC, topic_tag LIMIT 25), f AS (SELECT _id, 1 AS turn FROM s ORDER BY _id LIMIT 5) SELECT _id, CAST(turn AS INTEGER) AS turn FROM t UNION ALL SELECT _id, 1 FROM f WHERE NOT EXISTS (SELECT 1 FROM t)",
        lambda s, d, topic=_topic, least=_least: analytics.diverse_selection(
            inputs.table(s, d, "documents").select(F.col("doc_id").alias("_id"), (F.col("doc_id") % 9).alias("chapter_num"), F.concat("lang", "source").alias("topic_tag"), F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("score")), 25, topic, least
        ).select("_id", "turn"),
    )
_simple(
    "WN-4_best_chunk",
    "SELECT source AS book_id, arg_max(doc_id, (n_chars, -doc_id)) AS _id FROM documents GROUP BY 1",
    lambda s, d: inputs.table(s, d, "documents").groupBy(F.col("source").alias("book_id")).agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("_id")),
)
_simple(
    "WN-5_preferred",
    "WITH r AS (SELECT source AS query_id, doc_id AS _id, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lang IN ('de', 'fr') THEN 0 ELSE 1 END, rank) AS place FROM r WHERE rank <= 12) SELECT query_id, _id, CAST(place AS INTEGER) AS place FROM p WHERE place <= 4",
    lambda s, d: analytics.prefer(sets.ranked_in(inputs.table(s, d, "documents"), "source", 12), F.col("lang").isin("de", "fr"), 4).select("query_id", "_id", "place"),
)
_simple(
    "WN-7_every_nth",
    "SELECT source AS book_id, doc_id AS _id FROM documents QUALIFY (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 7 = 0",
    lambda s, d: analytics.every_nth(inputs.chunks(s, d), "book_id", ["_id"], 7).select("book_id", "_id"),
)

# Projections and predicates.
_simple(
    "PF-1_filtered_list",
    f"WITH {QUESTIONS} SELECT _id, question_text FROM questions WHERE topic_tag = 'Brand#4' AND difficulty = 'hard' ORDER BY _id DESC LIMIT 50",
    lambda s, d: analytics.page(inputs.questions(s, d).where("topic_tag = 'Brand#4' AND difficulty = 'hard'"), [F.desc("_id")], 0, 50).select("_id", "question_text"),
)
_simple(
    "PF-2_flagged",
    f"WITH {SUBMISSIONS}, {QUESTIONS} SELECT s._id, q.question_text FROM submissions s LEFT JOIN questions q ON q._id = s.question_id WHERE is_flagged ORDER BY submitted_at DESC, s._id LIMIT 100",
    lambda s, d: analytics.page(inputs.submissions(s, d).where("is_flagged"), [F.desc("submitted_at"), F.col("_id")]).join(inputs.questions(s, d).select(F.col("_id").alias("question_id"), "question_text"), "question_id", "left").select("_id", "question_text"),
)
_simple("PF-3_status_in", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')", lambda s, d: inputs.table(s, d, "events").where(F.col("event_type").isin(*[x.strip() for x in "click, view".split(",")])).select("event_id", "event_type"))
_simple(
    "PF-4_incomplete",
    "SELECT event_id, event_type FROM events WHERE event_type <> 'purchase' ORDER BY ts DESC, event_id LIMIT 100",
    lambda s, d: analytics.page(inputs.table(s, d, "events").where("event_type <> 'purchase'"), [F.desc("ts"), F.col("event_id")]).select("event_id", "event_type"),
)
_simple(
    "PF-5_formula_or_math",
    "SELECT doc_id FROM documents WHERE regexp_matches(text, '[=√∑]') OR coalesce(regexp_extract(text, '[0-9]+%'), '') <> ''",
    lambda s, d: inputs.table(s, d, "documents").where(F.col("text").rlike("[=√∑]") | (F.coalesce(F.regexp_extract("text", "[0-9]+%", 0), F.lit("")) != "")).select("doc_id"),
)
_simple("PF-6_array_not_empty", f"WITH {_QUIZ} SELECT _id FROM quiz WHERE len(list_filter(question_ids, lambda x: x % 10 = 0)) > 0", lambda s, d: inputs.quizzes(s, d).where(F.size(F.filter("question_ids", lambda x: x % 10 == 0)) > 0).select("_id"))
_simple(
    "PF-7_defaults",
    f"WITH {SUBMISSIONS} SELECT _id, coalesce(marking_route, 'PENDING') AS marking_route, coalesce(override_mark, 0) AS override_mark FROM submissions",
    lambda s, d: inputs.submissions(s, d).select("_id", F.coalesce("marking_route", F.lit("PENDING")).alias("marking_route"), F.coalesce("override_mark", F.lit(0.0)).alias("override_mark")),
)
_simple("PF-8_preview", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS preview FROM documents", lambda s, d: inputs.table(s, d, "documents").select("doc_id", T.ellipsis(F.col("text")).alias("preview")))
_simple("PF-9_students", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'", lambda s, d: inputs.table(s, d, "customer").where("c_mktsegment = 'MACHINERY'").orderBy("c_name").select("c_custkey", "c_name"))
_simple(
    "PF-10_repair_candidates",
    "SELECT doc_id, regexp_matches(text, '[=√∑]') OR contains(text, '$') AS needs_repair FROM documents",
    lambda s, d: inputs.table(s, d, "documents").select("doc_id", (F.col("text").rlike("[=√∑]") | F.col("text").contains("$")).alias("needs_repair")),
)
_simple(
    "PF-12_content_id",
    r"SELECT doc_id, substr(regexp_replace(regexp_replace(lower(regexp_replace(source || ' Book.' || lang, '\.[^.]*$', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) || '-' || substr(sha256(text), 1, 16) AS book_id FROM documents",
    lambda s, d: inputs.table(s, d, "documents").select("doc_id", T.content_id(F.concat("source", F.lit(" Book."), "lang"), F.col("text")).alias("book_id")),
)
_simple(
    "PF-13_search",
    f"WITH {QUESTIONS} SELECT _id FROM questions WHERE contains(lower(question_text), 'red') OR contains(lower(topic_tag), 'red')",
    lambda s, d: inputs.questions(s, d).where(F.lower("question_text").contains("red") | F.lower("topic_tag").contains("red")).select("_id"),
)
_simple("SF-22_prefix_key", "SELECT doc_id, lower(trim(substr(text, 1, 60), chr(10) || chr(9) || ' ')) AS key FROM documents", lambda s, d: inputs.table(s, d, "documents").select("doc_id", T.prefix_key(F.col("text"), 60).alias("key")))
_simple(
    "SF-20_four_figures",
    "SELECT o_orderkey, CASE WHEN o_totalprice = 0 THEN 0.0 ELSE round(o_totalprice * pow(10.0, 3 - floor(log10(abs(o_totalprice))))) / pow(10.0, 3 - floor(log10(abs(o_totalprice)))) END AS shown FROM orders",
    lambda s, d: inputs.table(s, d, "orders").select("o_orderkey", T.four_figures(F.col("o_totalprice")).alias("shown")),
)
_simple(
    "SF-26_durations",
    "SELECT l_orderkey, l_linenumber, l_partkey, strftime(o_orderdate + INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%S') AS deadline, CAST(date_diff('second', o_orderdate, l_shipdate) AS BIGINT) AS seconds FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    lambda s, d: inputs.table(s, d, "lineitem").join(inputs.table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.date_format(F.col("o_orderdate") + F.make_dt_interval(mins=F.lit(30)), "yyyy-MM-dd'T'HH:mm:ss").alias("deadline"), (F.unix_timestamp("l_shipdate") - F.unix_timestamp("o_orderdate")).alias("seconds")),
)

_simple(
    "WN-2_chunk_scores",
    "SELECT doc_id, round(least(1.0, 0.5 * (doc_id % 10) / 10 + CASE WHEN regexp_matches(text, '[=%]') THEN 0.2 ELSE 0 END + CASE WHEN contains(text, '|') THEN 0.2 ELSE 0 END + CASE WHEN len(string_split(text, chr(10))) > 2 THEN 0.1 ELSE 0 END), 6) AS score FROM documents",
    lambda s, d: inputs.table(s, d, "documents").select("doc_id", F.round(T.chunk_score((F.col("doc_id") % 10) / 10, F.col("text").rlike("[=%]"), F.col("text").contains("|"), F.split("text", "\n")), 6).alias("score")),
)
_simple(
    "JN-3_zero_filled",
    f"WITH {SUBMISSIONS}, {QUESTIONS} SELECT q._id, count(s._id) AS n FROM questions q LEFT JOIN submissions s ON s.question_id = q._id GROUP BY 1",
    lambda s, d: analytics.question_accuracy(inputs.submissions(s, d), inputs.questions(s, d)).select(F.col("question_id").alias("_id"), "n"),
)
_simple(
    "JN-14_open_sections",
    f"WITH {SUBMISSIONS}, l AS (SELECT DISTINCT o_orderkey AS quiz_id, o_custkey % 150 AS student_id, l_partkey % 100 AS question_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT quiz_id, count(*) AS n FROM l WHERE NOT EXISTS (SELECT 1 FROM submissions s WHERE s.student_id = l.student_id AND s.question_id = l.question_id) GROUP BY 1",
    lambda s, d: _attempts(s, d)[1]
    .select(F.col("_id").alias("quiz_id"), (F.col("student_id") % 150).alias("student_id"), F.explode(F.array_distinct("question_ids")).alias("question_id"))
    .join(inputs.submissions(s, d).select("student_id", "question_id"), ["student_id", "question_id"], "left_anti")
    .groupBy("quiz_id")
    .agg(F.count("*").alias("n")),
)
_simple(
    "PF-11_display_names",
    "SELECT p_partkey, p_brand AS name FROM part",
    lambda s, d: inputs.table(s, d, "part").select("p_partkey", T.display_name(F.concat(F.lower("p_brand"), F.lit(""))).alias("name")),
)
_simple(
    "SF-15_inline_tables",
    "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: len(regexp_extract_all(x, '\\|')) >= 2)) >= 2 AS has_table FROM documents",
    lambda s, d: inputs.table(s, d, "documents").select("doc_id", T.has_inline_table(F.col("text")).alias("has_table")),
)
_simple(
    "SF-19_within_tolerance",
    "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_extendedprice - l_quantity * 2000) / greatest(abs(l_quantity * 2000), 1e-12) <= 0.02 AS near FROM lineitem",
    lambda s, d: inputs.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.within_tolerance(F.col("l_extendedprice"), F.col("l_quantity") * 2000).alias("near")),
)
_simple(
    "SF-11_unmangled",
    "SELECT p_partkey, '\\frac ' || p_name AS text FROM part",
    lambda s, d: inputs.table(s, d, "part").select("p_partkey", T.unmangle_latex(F.concat(F.lit("\x0crac "), "p_name")).alias("text")),
)
_simple(
    "SF-3_split_mcq",
    "SELECT p_partkey, 'Which is ' || p_name || '?' AS stem, p_type AS a, p_brand AS c FROM part",
    lambda s, d: inputs.table(s, d, "part")
    .select("p_partkey", "p_name", "p_type", "p_brand", T.split_mcq(F.concat(F.lit("Which is "), "p_name", F.lit("? A. "), "p_type", F.lit(" B. none C. "), "p_brand", F.lit(" D) all\nAnswer: A"))).alias("q"))
    .select("p_partkey", "q.stem", F.col("q.options")["A"].alias("a"), F.col("q.options")["C"].alias("c")),
)

_simple(
    "JN-4_attempts_with_students",
    f"""WITH {SUBMISSIONS}, l AS (SELECT DISTINCT o_orderkey, o_custkey % 150 AS student_id, l_partkey % 100 AS question_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
      s AS (SELECT DISTINCT student_id, question_id FROM submissions)
      SELECT l.o_orderkey AS quiz_id, coalesce(c_name, '') AS student, count(s.question_id) AS n_answered FROM l LEFT JOIN customer ON c_custkey = l.student_id LEFT JOIN s ON s.student_id = l.student_id AND s.question_id = l.question_id GROUP BY 1, 2""",
    lambda s, d: _attempts(s, d)[1]
    .select(F.col("_id").alias("quiz_id"), (F.col("student_id") % 150).alias("student_id"), F.explode(F.array_distinct("question_ids")).alias("question_id"))
    .join(inputs.table(s, d, "customer").select(F.col("c_custkey").alias("student_id"), "c_name"), "student_id", "left")
    .join(inputs.submissions(s, d).select("student_id", "question_id", F.lit(1).alias("hit")).distinct(), ["student_id", "question_id"], "left")
    .groupBy("quiz_id", F.coalesce("c_name", F.lit("")).alias("student"))
    .agg(F.count("hit").alias("n_answered")),
)
