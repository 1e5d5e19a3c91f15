"""The given tables as the operators' inputs."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(s: SparkSession, name: str) -> str:
    """A new folder below the warehouse, which all executors share."""
    return f"{s.conf.get('spark.sql.warehouse.dir').rstrip('/')}/textbank-{name}-{uuid4().hex}"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as _id, chapter_num, embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_id"), F.col("label").alias("chapter_num"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of searches: every row whose id is divisible by 50."""
    return vectors(spark, sf_dir).where("_id % 50 = 0").withColumnRenamed("_id", "query_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks of books: source is the book, doc_id the page."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("_id"), F.col("source").alias("book_id"), F.col("lang").alias("topic_tag"), "text", F.col("doc_id").cast("int").alias("page_start"), F.col("doc_id").cast("int").alias("page_end"))


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as submissions: a user answers question k, value scaled to a mark of 10 and a confidence."""
    e = table(spark, sf_dir, "events")
    confidence = F.least(F.col("value") / 500, F.lit(1.0))
    return e.select(
        F.col("event_id").alias("_id"),
        F.col("user_id").alias("student_id"),
        F.get_json_object("props", "$.k").cast("long").alias("question_id"),
        F.when(F.col("event_type") == "signup", F.lit(None)).otherwise(F.upper("event_type")).alias("marking_route"),
        F.col("ts").alias("submitted_at"),
        confidence.alias("auto_confidence"),
        (F.col("value") / 50).alias("auto_mark"),
        F.when(F.col("event_id") % 7 == 0, F.col("value") / 40).alias("override_mark"),
        (F.col("event_type") == "error").alias("is_flagged"),
        (F.col("event_id") % 11 != 0).alias("is_marked"),
    )


#: submissions() in SQL, as a common table expression.
SUBMISSIONS = """submissions AS (
  SELECT event_id AS _id, user_id AS student_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS question_id,
    CASE WHEN event_type <> 'signup' THEN upper(event_type) END AS marking_route, ts AS submitted_at,
    least(value / 500, 1.0) AS auto_confidence, value / 50 AS auto_mark, CASE WHEN event_id % 7 = 0 THEN value / 40 END AS override_mark,
    event_type = 'error' AS is_flagged, event_id % 11 <> 0 AS is_marked
  FROM events
)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a question bank."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("_id"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_type")).alias("question_text"),
        F.col("p_brand").alias("topic_tag"),
        F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard")), (F.col("p_size") % 3 + 1).cast("int")).alias("difficulty"),
        F.concat(F.lit("L"), (F.col("p_size") % 5 + 1).cast("string")).alias("bloom_level"),
        (F.col("p_size") % 10 + 1).cast("double").alias("max_marks"),
        (F.col("p_partkey") % 13).cast("int").alias("chapter_num"),
    )


#: questions() in SQL, as a common table expression.
QUESTIONS = """questions AS (
  SELECT p_partkey AS _id, p_name || ' ' || p_type AS question_text, p_brand AS topic_tag, (['easy', 'medium', 'hard'])[p_size % 3 + 1] AS difficulty,
    'L' || (p_size % 5 + 1) AS bloom_level, CAST(p_size % 10 + 1 AS DOUBLE) AS max_marks, CAST(p_partkey % 13 AS INTEGER) AS chapter_num
  FROM part
)"""


def quizzes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their lines as quizzes with an ordered array of question ids."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("question_ids"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_id"), F.col("o_custkey").alias("student_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderpriority") != "5-LOW", F.lit(30)).alias("time_limit_minutes"), F.when(F.col("o_orderstatus") == "F", "strict").otherwise("easy").alias("timing_mode"))
    return o.join(lines, "_id")
