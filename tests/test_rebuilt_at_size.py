"""What the rebuilding of an index moves, and its rows on odd texts against its SQL."""

import os

from pyspark.sql import functions as F
from test_round_three import held_against_sql

from textbank.operators import index_build
from textbank.plans import registry


def written(spark):
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    own = sc.statusStore().executorList(False)
    return sum(own.apply(i).totalShuffleWrite() for i in range(own.size()))


def documents(spark, n):
    line = "concat(sha2(concat('a', id, ' ', i), 512), sha2(concat('b', id, ' ', i), 512), sha2(concat('c', id, ' ', i), 512), sha2(concat('d', id, ' ', i), 512))"
    return spark.range(0, n, 1, 4).selectExpr("id AS doc_id", f"array_join(transform(sequence(1, 6), i -> {line}), '\\n') AS text", "'en' AS lang", "concat('s', id % 3) AS source", "1L AS n_chars")


def test_rebuilding_shuffles_only_texts_to_be_asked_about(spark, tmp_path):
    documents(spark, 600).write.parquet(f"{tmp_path}/documents.parquet")
    size = 600 * 6 * 512
    before = written(spark)
    built = registry.queries()["IX-28_rebuilt"](spark, str(tmp_path))
    assert built.count() == 3600 and built.where("table_summary = 'known'").count() == 1800
    assert written(spark) - before < 2.5 * size


def test_an_index_of_fallbacks_keeps_no_copy(spark):
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    chunks = spark.createDataFrame([(1, "b", "text")], "_id long, book_id string, text string").withColumn("table_texts", F.array(F.lit("| Name | Size |\n|---|---|\n| a | 3 |\n| b | 4 |")))
    before = set(os.listdir(folder))
    entries, new = index_build.build_index("tables", chunks)
    assert [(r["table_summary"], r["headers"]) for r in entries.collect()] == [("Name, Size", ["Name", "Size"])] and new is None
    assert set(os.listdir(folder)) == before and "normal" not in entries.columns


def test_rebuilt_on_odd_texts(spark, tmp_path):
    long = "x" * 320
    texts = ["one line\nONE  line\n\n  two", "One Line\ntwo\nthree", None, "", "\n\n", "tHree\n" + long + "A", long + "B\nfour", "four\nfive ü z", "FOUR", " | a | b"]
    values = ", ".join(f"({i}, {'NULL' if t is None else chr(39) + t + chr(39)})" for i, t in enumerate(texts, 1))
    assert held_against_sql(spark, tmp_path, "IX-28_rebuilt", documents=f"SELECT i::BIGINT AS doc_id, t AS text, 'de' AS lang, 'b' || i % 2 AS source, 1::BIGINT AS n_chars FROM (VALUES {values}) v(i, t)")
