"""Containment, golden evaluation, choice of chunks and gaps, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textbank.operators import analytics, containment, evaluation


def held(needles, docs):
    return {(k, i) for k, s in needles for i, t in docs if s is not None and s.strip(" ") and t is not None and s.lower() in t.lower()}


@pytest.mark.parametrize("block", [1 << 21, 40])
def test_containment(spark, monkeypatch, block):
    """Needles of one and two words, cut words, long ones, blank and null ones; as one automaton and in blocks."""
    monkeypatch.setattr(containment, "BLOCK_CHARS", block)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abAB é") for _ in range(rng.randrange(1, 6)))
    long = " ".join(word() for _ in range(1000))
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(80)] + [(90, "say alpha beta gamma delta"), (91, None), (92, ""), (None, "alpha"), (93, "x " + long + " y"), (90, "say alpha beta gamma delta")]
    needles = [("two", "alpha beta"), ("three", "ALPHA beta gamma"), ("cut", "lpha beta gamm"), ("long", long), ("blank", "  "), ("null", None), (None, "gamma"), ("again", "alpha beta"), ("none", "zzz"), ("space", " b")]
    needles += [(f"n{i}", word()) for i in range(30)]
    n = spark.createDataFrame(needles, "query_id string, needle string")
    d = spark.createDataFrame(docs, "_id long, text string").withColumns({c: F.lit(1) for c in ("no", "block", "part", "side")}).repartition(3)
    got = [tuple(r) for r in containment.containment(n, d).collect()]
    assert set(got) == held(needles, docs) and len(got) == len(set(got))
    assert ("cut", 90) in got and ("long", 93) in got
    for a, b in ((n.where("false"), d), (n, d.where("false")), (n.where("query_id = 'blank'"), d)):
        assert containment.containment(a, b).collect() == []


def test_no_nested_loop(spark):
    concepts = spark.createDataFrame([("Mean",), ("mode",), (None,), ("Mean",)], "concept string")
    questions = spark.createDataFrame([(1, "the MEANing of it"), (2, None)], "_id long, text string")
    found = analytics.uncovered_concepts(concepts, questions)
    assert sorted(str(r[0]) for r in found.collect()) == ["None", "mode"]
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_short_queries_are_judged(spark):
    queries = spark.createDataFrame([("a", "alpha beta"), ("b", "alpha beta gamma"), ("c", "lpha beta gamm"), ("d", "alpha beta x")], "query_id string, text string")
    docs = spark.createDataFrame([(1, "say Alpha beta gamma delta"), (2, "alpha beta")], "_id long, text string")
    judged, relevant = evaluation.judged_by_containment(queries, docs)
    assert {tuple(r) for r in relevant.collect()} == {("a", 1), ("a", 2), ("b", 1), ("c", 1)}
    assert {(r["query_id"], r["_id"], r["relevant"]) for r in judged.collect()} == {("b", 1, True)}


def test_expected_rows(spark):
    """By page and by a string in any field, as loops give them."""
    rows = [(1, 1, 3, "The Mean", "a"), (2, 4, None, "mode", "MEAN value"), (3, None, None, "median", None), (4, 9, 8, None, None), (5, 2, 2, "x", "y")]
    frame = spark.createDataFrame(rows, "_id long, page_start int, page_end int, text string, caption string")
    expected = spark.createDataFrame([("p", [2, 4, 4], None), ("s", None, ["mean", " "]), ("both", [9], ["n a", "DIAN"]), ("none", [], []), ("null", None, None)], "query_id string, pages array<int>, contains array<string>")
    got = {tuple(r) for r in evaluation.expected_rows(expected, frame, ["text", "caption"]).collect()}
    assert got == {("p", 1), ("p", 2), ("p", 5), ("s", 1), ("s", 2), ("both", 4), ("both", 1), ("both", 3)}


def test_golden_scores(spark):
    """Lists, the parents behind the text rows, the fused list and empty lists, with measures worked out by hand."""
    expected = spark.createDataFrame([("q", [5], ["mean"]), ("r", [99], None)], "query_id string, pages array<int>, contains array<string>")
    rows = spark.createDataFrame([(1, 5, "x"), (2, 6, "the mean"), (3, 7, "z"), (4, 8, "w")], "_id long, page_start int, text string").withColumn("page_end", F.col("page_start"))
    found = spark.createDataFrame([("q", "text", 3, 1), ("q", "text", 1, 2), ("q", "formula", 2, 1), ("q", "parent", 4, 1), ("r", "table", 4, 1)], "query_group string, kind string, _id long, place int")
    got = {(r["query_id"], r["specialist"]): r for r in evaluation.golden_scores(expected, found, rows, ["text"]).collect()}
    assert len(got) == 10
    assert (got["q", "text"]["mrr"], got["q", "text"]["n_returned"], got["q", "text"]["recall_at_k"]) == (0.5, 3, 0.5)
    assert (got["q", "formula"]["mrr"], got["q", "formula"]["ndcg_at_k"]) == (1.0, 1.0)
    fused = got["q", "fused"]  # 3, 1 (relevant), 4, 2 (relevant)
    assert (fused["hit_at_k"], fused["mrr"], fused["n_returned"], fused["recall_at_k"]) == (1.0, 0.5, 4, 1.0)
    assert fused["ndcg_at_k"] == pytest.approx((1 / 1.584963 + 1 / 2.321928) / (1 + 1 / 1.584963), abs=1e-5)
    assert got["q", "figure"]["n_returned"] == 0 and got["r", "fused"]["hit_at_k"] == 0 and got["r", "fused"]["recall_at_k"] == 0


def choose(chunks, limit, topic):
    source = [c for c in chunks if c[1] > 0] or chunks
    pool = [c for c in source if (topic or "").lower() in c[2].lower() and c[3] > 0.15]
    if not pool:
        return [(c[0], 1) for c in sorted(source)[:5]]
    by = {}
    for c in sorted(pool, key=lambda c: (-c[3], c[0])):
        by.setdefault(c[2], []).append(c)
    order = sorted(by, key=lambda t: (-by[t][0][3], t))
    out = [(by[t][i][0], i + 1) for i in range(limit) for t in order if i < len(by[t])]
    return out[:limit]


@pytest.mark.parametrize("topic", [None, "Al", "nothing"])
@pytest.mark.parametrize("chapters", [0, 3])
def test_diverse_selection(spark, topic, chapters):
    rng = random.Random(chapters)
    chunks = [(i, rng.randrange(chapters + 1), rng.choice(["algebra", "Calculus", "Total", ""]), rng.choice([0.0, 0.15, 0.2, 0.5, 0.9])) for i in range(60)]
    frame = spark.createDataFrame(chunks, "_id long, chapter_num int, topic_tag string, score double")
    got = [(r["_id"], r["turn"]) for r in analytics.diverse_selection(frame, 11, topic).collect()]
    assert sorted(got) == sorted(choose(chunks, 11, topic))
    assert "WindowGroupLimit" in analytics.round_robin(frame, "topic_tag", "score", 11)._jdf.queryExecution().toString()
    assert analytics.diverse_selection(frame.where("false"), 11, topic).collect() == []


def test_missing_pages(spark):
    rows = [("a", 0), ("a", 1), ("a", 4), ("a", 4), ("b", 7), ("c", None)]
    got = sorted(tuple(r) for r in analytics.missing_pages(spark.createDataFrame(rows, "book_id string, page long")).collect())
    assert got == [("a", 2, 3), ("a", 5, 7), ("b", 0, 6)]


@pytest.mark.parametrize("most", [500_000, 0])
def test_shared_triples(spark, monkeypatch, most):
    """Looked up in every task, and joined if there are too many."""
    monkeypatch.setattr(evaluation, "BROADCAST_ROWS", most)
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["a", "B", "c1", "d-e", "ü"]) for _ in range(n))
    queries, docs = [(f"q{i}", text(rng.randrange(9))) for i in range(12)] + [("null", None)], [(i, text(rng.randrange(30))) for i in range(40)] + [(99, None)]
    got = {(r["query_id"], r["_id"]): (r["shared"], r["n"]) for r in evaluation.shared_triples(spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(docs, "_id long, text string")).collect()}
    triples = lambda t: {tuple(w[i : i + 3]) for w in [re.findall("[a-z0-9]+", (t or "").lower())] for i in range(len(w) - 2)}
    want = {(q, d): (len(triples(a) & triples(b)), len(triples(a))) for q, a in queries for d, b in docs if triples(a) & triples(b)}
    assert got == want
