"""Texts of which a row-by-row comparison would take too long."""

import time

from pyspark.sql import functions as F

from textbank.operators import chunking


def test_long_texts_are_held_against_long_tables(spark):
    frame = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("word"), i.cast("string"))), " ").alias("known"))
    text = F.concat_ws("\n", "known", F.lit("some new words here"), F.lit("word1 word2 word3 new"), F.lit("word1 word2 new new"), F.lit("word1 word1"))
    start = time.monotonic()
    (got,) = frame.select(chunking.drop_repeated_content(text, F.array("known")).alias("t")).collect()
    assert got["t"] == "some new words here\nword1 word2 new new\nword1 word1"
    assert time.monotonic() - start < 20
