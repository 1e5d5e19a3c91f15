"""Mined exercises by value: boxes, items, options over several lines, group stems, and what stands around them."""

import pytest
from pyspark.sql import functions as F

from textbank.operators import indexes


def mine(spark, text, tables=None, images=None, math=None):
    frame = spark.createDataFrame([(1, "b", text, tables, images, math)], "_id long, book_id string, text string, table_texts array<string>, image_texts array<string>, math_text string")
    return indexes.build_exercises(frame).orderBy("place").collect()


HOMEWORK = """Some prose before.
Example 5.3
Using the frequency table below,  compute
the expected value of X.
a. one
or more
b. two
Solution
Multiply each value by its probability.
Then sum.
Try It 5.3
How many pears are there in the other basket?
HOMEWORK
An introduction that is no exercise at all.
1.2 Data and Sampling of Things
Use the following information to answer the next two exercises: A survey of words.
1. What is the mean of all
these numbers?
a. the first
and more of it
b.
c. the third
2. What is their median, if there is one?
3. What is the mode of these numbers, then?
1.3 More of It
4. 12.5
5. What is the range of these numbers, then?
ACTIVITY: Toss a coin
ten times and write it down.
PRACTICE
1. What is the spread of these numbers here?"""


def test_exercises(spark):
    got = mine(spark, HOMEWORK, ["X | P(x)\n0 | 0.3", "", None, "second"], ["Bar chart of X", None], "  E(X) = \\sum x P(x) ")
    assert [(r["kind"], r["label"], r["stem"], r["solution"], r["options"]) for r in got] == [
        ("example", "Example 5.3", "Using the frequency table below, compute the expected value of X. a. one or more b. two", "Multiply each value by its probability. Then sum.", ["one or more", "two"]),
        ("try_it", "Try It 5.3", "How many pears are there in the other basket?", "", []),
        ("homework", "Homework 1.2 Q1", "A survey of words. What is the mean of all these numbers?", "", ["the first and more of it", "the third"]),
        ("homework", "Homework 1.2 Q2", "A survey of words. What is their median, if there is one?", "", []),
        ("homework", "Homework 1.2 Q3", "What is the mode of these numbers, then?", "", []),
        ("homework", "Homework 1.3 Q5", "What is the range of these numbers, then?", "", []),
        ("activity", "ACTIVITY: Toss a coin", "Toss a coin ten times and write it down.", "", []),
        ("practice", "Practice 1.3 Q1", "What is the spread of these numbers here?", "", []),
    ]
    assert {(r["table_markdown"], r["figure_desc"], r["math_text"]) for r in got} == {("X | P(x)\n0 | 0.3\n\nsecond", "Bar chart of X", "E(X) = \\sum x P(x)")}
    assert [r["inferred_qtype"] for r in got] == ["mcq", "short_answer", "mcq"] + ["short_answer"] * 5


def test_long_activity_ends(spark):
    text = "HOMEWORK\nGROUP PROJECT\n" + "\n".join(f"Do step {i} of the work" for i in range(39)) + "\nlast line of the box\nnot in the box\n1. Is this an item behind the box that ended?"
    got = mine(spark, text)
    assert [r["kind"] for r in got] == ["activity", "homework"] and got[0]["stem"].endswith("last line of the box")
    assert got[1]["stem"] == "Is this an item behind the box that ended?"


@pytest.mark.parametrize("text", [None, "", "no exercise here", "1. A numbered line outside of homework is none", "HOMEWORK\n1. 12\n2. $3"])
def test_no_exercises(spark, text):
    assert mine(spark, text) == []


def test_exercise_text(spark):
    rows = [("Example 5.3", "Compute it.", ["a", "b"] * 4, "m" * 700, "t" * 700, "f" * 500), (None, "Only a stem", None, "", None, "")]
    frame = spark.createDataFrame(rows, "label string, stem string, options array<string>, math string, tab string, fig string")
    got = [r[0] for r in frame.select(indexes.exercise_text(*map(F.col, frame.columns))).collect()]
    assert got == ["Example 5.3 — Compute it. — options: a | b | a | b | a | b — formulas: " + "m" * 600 + " — table: " + "t" * 600 + " — figure: " + "f" * 400, "Only a stem"]


def test_exercises_are_mined_in_the_row_of_their_chunk(spark):
    """A shuffle of all lines, and another of what each exercise carries, grew with the text and not with the exercises."""
    frame = spark.createDataFrame([(1, "b", HOMEWORK.replace("\n", "\r\n")), (2, "b", HOMEWORK.replace("\n", "\r"))], "_id long, book_id string, text string")
    built = indexes.build_exercises(frame)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and plan.count("ArrowEvalPython") == 1
    rows = built.orderBy("parent_chunk_id", "place").collect()
    assert [r["stem"] for r in rows[:8]] == [r["stem"] for r in rows[8:]] and len(rows) == 16
