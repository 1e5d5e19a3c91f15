"""What a review of whole tables found: queries on rows that the given tables lack, against their SQL."""

import tempfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import rows

from textbank.operators import analytics, chunking, common, curation, indexes, marking, retrieval, similarity, vector_index
from textbank.plans import registry


def held_against_sql(spark, folder, name, **tables):
    """Whether the query gives its SQL's rows on small tables (SQL that selects their rows)."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = registry.queries()[name](spark, str(folder)).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    return rows(got) == rows(want)


@pytest.mark.parametrize("name", ["DS-1_chapter_headings", "DS-5_latch", "DS-6_near_latch"])
def test_headings_of_odd_letters(spark, tmp_path, name):
    texts = ["ßa", "ﬁnd", "aΣ", "sİi", "abcカナdef", "word\nChapter 3: Preface\v", "ſa", "word\nChapter 4: Things \v12", "word\nChapter 6: Things .... 12\u2028"]
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts, 1))
    assert held_against_sql(spark, tmp_path, name, documents=f"SELECT i::BIGINT AS doc_id, t AS text, 'de' AS lang, 'b' AS source, 1::BIGINT AS n_chars FROM (VALUES {values}) v(i, t)".replace("\\v", "\v"))


def test_confidence_is_rounded_as_a_double(spark):
    scored = spark.createDataFrame([(i, c) for i, c in enumerate((0.125, 0.075, 0.135, 0.005, 1.0))], "_id int, confidence double").selectExpr("*", "'LOW' AS route", "0.0D AS auto_mark", "true AS is_flagged", "'' AS auto_feedback")
    got = [r["auto_feedback"] for r in marking.outcome(scored).orderBy("_id").collect()]
    assert got == [f"[Route:LOW Conf:{c:.2f}] " for c in (0.125, 0.075, 0.135, 0.005, 1.0)]


@pytest.mark.parametrize("build", [indexes.build_figures, indexes.build_tables, indexes.build_formulas])
def test_entries_of_a_chunk_are_told_apart_in_its_row(spark, build):
    chunks = spark.createDataFrame([(1, "b", "Figure 1.2 Bars\nx = 1 + 2\nx  = 1 + 2\ny = 3")], "_id long, book_id string, text string")
    texts = F.array(*[F.lit(x) for x in ("a picture of many bars", "A picture  of many bars", "another picture of bars")])
    tables = F.transform(texts, lambda x: F.concat(F.lit("| "), x, F.lit(" | 1 |\n| b | 2 |")))
    built = build(chunks.withColumns({"math_text": F.lit(""), "image_texts": texts, "table_texts": tables}))
    assert [r["place"] for r in built.orderBy("place").collect()] == [1, 2]
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the entries alone, by their ids


def test_rerank_tells_queries_of_one_text_apart(spark):
    ranked = spark.createDataFrame([(q, "mean of rows", "text", r, 10 * q + r, "the mean") for q in (1, 2) for r in (1, 2)], "query_id int, query string, kind string, rank int, _id int, text string")
    got = retrieval.rerank(ranked).orderBy("query_id", "rank").collect()
    assert [(r["new_rank"], r["blended"]) for r in got] == [(1, 0.75), (2, 0.5)] * 2


def test_search_of_all_cells_is_exact(spark, tmp_path):
    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.standard_normal((300, 8)))], "_id long, embedding array<float>")
    q = v.where("_id % 50 = 0").withColumnRenamed("_id", "query_id")
    vector_index.write_index(v, str(tmp_path / "index"))
    assert sorted(vector_index.search_index(q, str(tmp_path / "index"), 5, None).collect()) == sorted(retrieval.vector_topk(q, v, 5).collect())


def test_the_bank_is_compared_exactly(spark, monkeypatch):
    monkeypatch.setattr(similarity, "tables_for", None)  # signatures, which may miss a pair, are not called for
    monkeypatch.setattr(similarity, "AT_ONCE", 3)
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert registry.queries()["QB-6_against_bank"](spark, "/root/testdata/sf0.001").count() <= v
    assert held_against_sql(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "JN-10_best_in_bank", embeddings="SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")


def test_the_order_of_marks_decides_no_tenth_of_a_percent(spark):
    own = [0.1, 0.2, 0.3, 63.25, 0.4, -0.4, -0.3, -0.2, -0.1]
    marks = {1: (own, 220.0), 2: (sorted(own), 220.0), 3: (sorted(own, reverse=True), 220.0), 4: ([0.0], 0.0), 5: ([float("nan")], 1.0), 6: ([0.15], 100.0)}
    submissions = spark.createDataFrame([(s, s, m, None, True) for s, (each, _) in marks.items() for m in each], "student_id int, question_id int, auto_mark double, override_mark double, is_marked boolean").coalesce(1)
    questions = spark.createDataFrame([(s, most / len(each)) for s, (each, most) in marks.items()], "_id int, max_marks double")
    got = {r["student_id"]: r["pct"] for r in analytics.student_scores(submissions, questions).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 6)] == [28.8, 28.8, 28.8, None, 0.2] and np.isnan(got[5])


def test_candidates_of_buckets_are_scored_where_they_lie(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8)).tolist()
    v = spark.createDataFrame([(i, x[i % 300]) for i in range(400)] + [(900, None), (901, [0.0] * 8), (902, [1.0])], "_id long, embedding array<float>")
    q = v.where("_id % 50 = 0").withColumnRenamed("_id", "query_id")
    exact = sorted(retrieval.vector_topk(q, v, 5).where("query_id < 900").collect())
    for held in (4096, 16):  # every query looks into all four buckets but the opposite one of each table
        monkeypatch.setattr(retrieval, "BUCKET_HELD", held)
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
        found = retrieval.approximate_topk(q, v, 5, planes=2, tables=16)
        assert sorted(found.collect()) == exact
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan  # no row for each candidate


def test_the_first_of_similar_rows_is_kept_without_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((150, 6)), rng.standard_normal((1, 6)).repeat(40, axis=0)])
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)] + [(900, None), (901, [0.0] * 6)], "_id long, embedding array<double>").repartition(3)
    for threshold, block in ((0.3, 7), (0.8, 7), (0.8, 8192)):
        monkeypatch.setattr(similarity, "AT_FIRST", block)
        want = curation.keep_first_of_similar(v.select("_id"), retrieval.similar_pairs(v, None, threshold), common.cut)
        got = similarity.keep_first_apart(v, threshold).select("_id")
        assert sorted(got.collect()) == sorted(want.collect()) and {900, 901} <= {r[0] for r in got.collect()}
    monkeypatch.setattr(retrieval, "similar_pairs", None)  # their number grows with the square of the rows
    assert registry.queries()["QB-5_keep_first_of_similar"](spark, "/root/testdata/sf0.001").count() > 0


def test_queries_are_sent_once_to_all_rows(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "_id long, embedding array<double>")
    plan = retrieval.vector_topk(v.withColumnRenamed("_id", "query_id"), v, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # no row of two matrices


def test_of_two_similar_rows_one_visits_the_other(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "HELD", 20)
    x = np.random.default_rng(5).standard_normal((300, 6))
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.3, 1))
    found = retrieval.similar_pairs(v.withColumn("embedding", F.col("embedding").cast("array<float>")), None, 0.3)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == sorted(zip(a.tolist(), b.tolist(), strict=True))
    assert "unit" not in found._jdf.queryExecution().optimizedPlan().toString()  # vectors travel as they are, not as doubles


def test_redundant_parts_are_found_by_hashing(spark):
    told = [("a a a a b", "a"), ("a a a b", "a"), ("a b c", "c b a x"), ("", "a"), ("x y", ""), ("a a a a b b", "a")]
    frame = spark.createDataFrame(told, "part string, base string").coalesce(1)
    found = frame.select(chunking.redundant(F.col("part"), F.col("base")))
    assert [r[0] for r in found.collect()] == [True, False, True, True, False, False]
    assert "array_except" in found._jdf.queryExecution().optimizedPlan().toString()  # not each word against each


def test_sliding_counts_by_whole_milliseconds(spark, tmp_path):
    times = [f"2024-01-0{d} 00:{m}9:59.{x}" for d in (1, 2) for m in (0, 5) for x in ("999", "9994", "999499", "9995", "9996", "999999")] + ["2024-01-01 00:10:00", "2024-01-01 00:10:00.0005"]
    times += [f"1969-12-31 23:{x}" for x in ("40:00", "40:00.0005", "40:00.000501", "49:59.9995", "49:59.9994", "50:00.0006", "59:59.9996", "55:00")] + ["1970-01-01", "1970-01-01 00:00:00.0004"]
    values = ", ".join(f"({i}, TIMESTAMP '{t}')" for i, t in enumerate(times)) + ", (90, NULL), (91, NULL)"
    assert held_against_sql(spark, tmp_path, "SM-3_sliding_counts", events=f"SELECT i::BIGINT AS event_id, t AS ts, (i % 3)::BIGINT AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{\"k\": 1}}' AS props FROM (VALUES {values}) v(i, t)")
