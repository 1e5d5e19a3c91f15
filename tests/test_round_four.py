"""What a second review of whole tables found: queries on rows that the given tables lack, against their SQL, to the last digit."""

import duckdb
from pyspark.sql import functions as F

from textbank.functions import text as T
from textbank.operators import indexes
from textbank.plans import registry


def held_to_the_digit(spark, folder, name, **tables):
    """Rows that the query gives and its SQL does not, and the other way, on small tables (SQL that selects their rows)."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    frame, want = registry.queries()[name](spark, str(folder)), con.sql(registry.oracle_sql()[name])
    order = sorted(want.columns)
    got = sorted(repr(tuple(r)) for r in frame.select(*order).collect())
    ours = sorted(repr(tuple(r)) for r in want.select(*[f'"{c}"' for c in order]).fetchall())
    assert got == ours


#: Marks that are 28.75 in all; summed as doubles in this order they are less.
HALF = (97.07, 215.26, 154.42, 210.54, 103.24, 137.63, 173.03, 70.53, 214.55, 61.23)
EVENTS = "SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' AS ts, u::BIGINT AS user_id, 'view' AS event_type, v::DOUBLE AS value, '{\"k\": 1}' AS props FROM "
PART = "SELECT 1::BIGINT AS p_partkey, 'a' AS p_name, 'b' AS p_brand, 'c' AS p_type, 9 AS p_size, 1.0::DOUBLE AS p_retailprice"


def test_marks_are_summed_in_the_order_of_ids(spark, tmp_path):
    values = ", ".join(f"({7 * i + 1}, 1, {v})" for i, v in enumerate(HALF))
    held_to_the_digit(spark, tmp_path, "AG-11_student_scores", events=f"{EVENTS} (VALUES {values}) t(i, u, v)", part=PART)


def test_marks_of_many_places_are_summed_whole(spark, tmp_path):
    held_to_the_digit(spark, tmp_path, "AG-11_student_scores", events=f"{EVENTS} (SELECT i, i % 20 AS u, 300 * (hash(i) % 1000003) / 1000003 AS v FROM range(20000) t(i))", part=PART)


def test_a_submission_that_may_be_marked_is_not_pending(spark, tmp_path):
    held_to_the_digit(spark, tmp_path, "AG-11_student_scores", events=f"{EVENTS} (VALUES (NULL, 1, 5), (11, 1, 6), (3, 2, 7)) t(i, u, v)", part=PART)


def texts(*each):
    """SQL of documents that have these texts (SQL expressions)."""
    return " UNION ALL ".join(f"SELECT {i}::BIGINT AS doc_id, {t}::VARCHAR AS text, 'en' AS lang, 'b' AS source, 1::BIGINT AS n_chars" for i, t in enumerate(each))


def lines(*each):
    """SQL of a text of these lines (SQL expressions)."""
    return " || chr(10) || ".join(each)


def test_captions_keep_the_white_space_around_them(spark, tmp_path):
    odd = texts(
        "NULL", "''", "'   '", "chr(10)", "chr(11)", lines("'word.'", "''"), lines("'word.'", "''", "'  '"), "'word. '", lines("'Figure 1.2 Bars  '", "'x'"), lines("'a'", "''", "'  figure 3 x' || chr(13)", "'b'"),
        "chr(11) || 'Figure 3 x'", "'Fig. 3.4.5.' || chr(11)", "'Fig 3'", lines("'FIG.'", "'7 b'"), "'Figure' || chr(11) || '3'", "'fıgure 3'", "'FİGURE 4'", "'x' || chr(13) || 'Figure 5'", "'Figure 2 ' || chr(160)", "'Figure 2 ' || chr(133) || 'z'", "'Figure ' || chr(1635)",
    )
    held_to_the_digit(spark, tmp_path, "IX-15_caption", documents=odd)


def test_captions_of_very_many_numbers(spark, tmp_path):
    held_to_the_digit(spark, tmp_path, "IX-15_caption", documents=texts("'Fig. 1' || repeat('.1', 20000)"))


def test_captions_of_figures_are_stripped(spark):
    frame = spark.createDataFrame([(0, None), (1, ""), (2, "a\n\n  Figure 1.2 Bars \r\nx"), (3, "Figure 1")], "i int, t string")
    assert [r[0] for r in frame.orderBy("i").select(indexes.caption(F.col("t"))).collect()] == ["", "", "Figure 1.2 Bars", "Figure 1"]


def test_a_table_with_any_text_has_one_blank(spark, tmp_path):
    odd = texts("NULL", "''", "'   '", "chr(10)", "'???'", "'?'", "'|'", "'| ? |'", "'-- : --'", "chr(11)", "chr(28)", "chr(133)", "chr(160)", "chr(12288)", lines("'a | b'", "'? c'"), "'a'")
    held_to_the_digit(spark, tmp_path, "SF-14_table_html", documents=odd)


def test_empty_cells_of_a_table_are_blanks(spark):
    frame = spark.createDataFrame([(0, "| a | b |\n|---|---|\n|  | ? |"), (1, "| a | b |\n| 1 |"), (2, None), (3, "| a |  |\n| 1 | 2 |")], "i int, t string")
    assert [r[0] for r in frame.orderBy("i").select(T.table_html("t")["n_blanks"]).collect()] == [2, 1, 0, 0]
