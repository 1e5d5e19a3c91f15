"""Operators on small tables with known answers."""

import pytest
from pyspark.sql import functions as F

from textbank.functions import text as T
from textbank.functions.vectors import cosine
from textbank.operators import chunking, cleaning, curation, evaluation, indexes, marking, retrieval, structure
from textbank.sources import tables


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    return [r[1] for r in df.select("i", column(F.col("c")).alias("v")).orderBy("i").collect()]


def test_clean(spark):
    noisy = "Donâ\u0080\u0099t".encode().decode("latin-1")
    got = values(spark, cleaning.clean, [noisy + " ﬁnd “x” — y.​", "dis-\n tribution", "A.\n\n17\n\nB", "1\n2\n3", "Line.\nLine.\nLINE.\nLine.", "", None, "The sum\nof it.\n\n\n\nNext  one  "])
    assert got[0] == "Don't find \"x\" -- y."
    assert got[1] == "distribution"
    assert got[2] == "A.\n\nB"
    assert got[3] == "1\n2\n3"
    assert got[4] == "Line.\nLine."
    assert got[5] == "" and got[6] is None
    assert got[7] == "The sum of it.\n\nNext one"


def test_noise_ratio(spark):
    got = values(spark, cleaning.noise_ratio, ["", "plain", "CC BY 4.0"])
    assert got[0] == 0 and got[1] == 0 and got[2] == 1


@pytest.mark.parametrize(
    ("nums", "accepted"),
    [([1, 1, 2, 12], [True, True, True, False]), ([4, 5, 9], [True, True, False]), ([12, 1, 2, 1], [True, True, True, False])],
)
def test_latch(spark, nums, accepted):
    df = spark.createDataFrame([("b", i, n, f"T{n}") for i, n in enumerate(nums)], "book_id string, page int, num int, title string")
    got = structure.latch_chapters(df).orderBy("page").collect()
    assert [r["accepted"] for r in got] == accepted


def test_chapter_heading(spark):
    got = values(spark, structure.chapter_heading, ["Chapter 3: Sampling and Data", "CHAPTER 4 | Normal Law", "5. Linear Models", "Chapter 2: Index", "Chapter 77: Far Out", None])
    assert [(h["num"], h["title"]) if h else None for h in got] == [(3, "Sampling and Data"), (4, "Normal Law"), (5, "Linear Models"), None, None, None]


def test_skip_blocks(spark):
    teaching = "KEY TERMS\n" + "\n".join(["The mean is defined as a sum", "The variance is a formula", "Hypothesis and regression"] * 3)
    numbered = "\n".join(f"{i}. Solve this" for i in range(1, 12))
    assert values(spark, structure.is_skip_block, ["Download for free at a site.", numbered, "  ", teaching, "Plain words of a lesson."]) == [True, True, True, False, False]


def test_recursive_split(spark):
    long = " ".join(f"Word{i} of a sentence." for i in range(600))
    df = spark.createDataFrame([(0, ""), (1, "short"), (2, long), (3, None)], "i int, c string")
    got = {r["i"]: r["v"] for r in df.select("i", chunking.recursive_split(1000, 100, 100)("c").alias("v")).collect()}
    assert got[0] == [] and got[3] == [] and got[1] == ["short"]
    assert all(100 <= len(p) <= 1000 for p in got[2])


def test_merge_small(spark):
    df = spark.createDataFrame([(["aaaaaaaaaa", "bb", "cccccccccc"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(chunking.merge_small(F.col("p"), 5, "-")).collect()] == [["aaaaaaaaaa-bb", "cccccccccc"], []]


def test_formulas(spark):
    df = spark.createDataFrame([("c", "b", "The mean of all is the sum over n of them. Prose with s = 2 and very many other words besides here.\nz = 3", "x = 1\nX=1\ny = 22")], "_id string, book_id string, text string, math_text string")
    got = [r["entry"] for r in indexes.split_formulas(df).orderBy("place").collect()]
    assert got == ["x = 1", "y = 22", "z = 3"]


def test_exercises(spark):
    text = "Example 1.2\nHow many apples are there in the basket?\nSolution\nThere are six.\nTry It 1.2\nHow many pears are there in the other one?\nHOMEWORK\n1. What is the mean of all these numbers?\na. one\nb. two"
    got = indexes.build_exercises(spark.createDataFrame([(1, "b", text)], "_id long, book_id string, text string")).orderBy("place").collect()
    assert [(r["kind"], r["inferred_qtype"]) for r in got] == [("example", "short_answer"), ("try_it", "short_answer"), ("homework", "mcq")]
    assert got[0]["solution"] == "There are six." and got[2]["options"] == ["one", "two"]


def test_enrichment(spark):
    df = spark.createDataFrame([(1, 2, '[{"i": 1, "concept_label": "mean", "formula_plain": "m", "variables": {"a": "b"}}, {"i": 9, "concept_label": "x"}]'), (2, 2, "no json")], "batch_id int, batch_size int, raw string")
    got = indexes.parse_enrichment(df).collect()
    assert [(r["batch_id"], r["i"], r["label"], r["variables"]) for r in got] == [(1, 1, "mean", {"a": "b"})]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_fuse(spark):
    rows = [("g", 1, 1, "a"), ("g", 1, 2, "b"), ("g", 2, 1, "c"), ("g", 2, 2, "b"), ("g", 2, 3, ""), ("g", 2, 4, None)]
    got = retrieval.fuse(spark.createDataFrame(rows, "query_group string, list_no int, rank int, _id string")).orderBy("rank").collect()
    assert [r["_id"] for r in got] == ["b", "a", "c"]


def test_approximate_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("_id"), "embedding")
    q = v.where("_id % 50 = 0").withColumnRenamed("_id", "query_id")
    exact = retrieval.vector_topk(q, v, 5).select("query_id", "_id")
    found = retrieval.approximate_topk(q, v, 5, planes=4).select("query_id", "_id")
    assert exact.join(found, ["query_id", "_id"]).count() >= 0.9 * exact.count()


def test_rerank(spark):
    rows = [("normal variance", "formula", 1, "a", "mean"), ("normal variance", "formula", 2, "b", "variance of the normal"), ("one", "formula", 1, "c", "x")]
    df = spark.createDataFrame(rows, "query string, kind string, rank int, _id string, formula_plain string")
    got = {r["_id"]: r["new_rank"] for r in retrieval.rerank(df).collect()}
    assert got == {"b": 1, "a": 2, "c": 1}


def test_intent(spark):
    assert values(spark, retrieval.classify_intent, ["compute the mean", "show the histogram formula", "why is it so", None]) == ["computational", "visual", "conceptual", "conceptual"]


def test_measures(spark):
    judged = spark.createDataFrame([("q", "t", 1, False), ("q", "t", 2, True), ("q", "t", 3, True)], "query_id string, specialist string, rank int, relevant boolean")
    pairs = spark.createDataFrame([("q", "t"), ("q", "none")], "query_id string, specialist string")
    totals = spark.createDataFrame([("q", 4)], "query_id string, total_relevant long")
    got = {r["specialist"]: r for r in evaluation.score_queries(judged, pairs, totals, 2).collect()}
    assert (got["t"]["hit_at_k"], got["t"]["recall_at_k"], got["t"]["mrr"]) == (1.0, 0.25, 0.5)
    assert got["t"]["ndcg_at_k"] == pytest.approx((1 / 1.584963) / (1 + 1 / 1.584963), abs=1e-5)
    assert got["none"]["mrr"] == 0 and got["none"]["n_returned"] == 0


def test_keep_first_of_similar(spark):
    rows = spark.createDataFrame([(i,) for i in range(6)], "_id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "a long, b long")
    got = sorted(r[0] for r in curation.keep_first_of_similar(rows, pairs, lambda d: d.checkpoint()).collect())
    assert got == [0, 2, 4]


def test_keep_first_of_long_chain(spark):
    n = 212  # more than 100 rounds
    rows = spark.range(n).withColumnRenamed("id", "_id")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    held = lambda d: spark.createDataFrame(d.toArrow())
    with pytest.raises(RuntimeError):
        curation.keep_first_of_similar(rows, pairs, held, max_rounds=3)
    got = sorted(r[0] for r in curation.keep_first_of_similar(rows, pairs, held).collect())
    assert got == list(range(0, n, 2))


def test_gate(spark):
    rows = [("What is the mean?", "short_answer", None), ("", "short_answer", None), ("Fill ____ in", "short_answer", None), ("Use Table 1.9 to find it.", "short_answer", None), ("See the figure below and explain.", "short_answer", None), ("Pick\nA. one\nB. one", "mcq", "A"), ("Pick\nA. one\nB. two", "mcq", "C"), ("It is the sum of", "short_answer", None), ("Is (x closed?", "short_answer", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_id int, question_text string, question_type string, correct_answer string")
    got = [r["reason"] for r in curation.rejection(df).orderBy("_id").collect()]
    assert got == [None, "empty", "placeholder", "source label", "figure missing", "repeated options", "key not among options", "truncated", "unbalanced delimiters"]


def test_marking_reply(spark):
    df = spark.createDataFrame([('{"mark": 3, "feedback": "ok"}',), ('{"mark": 9, "feedback": "\\alpha"} tail',), ("mark: 2.5 I think",), ("nothing",)], "raw string")
    got = [r[0] for r in df.select(T.marking_reply(F.col("raw"), F.lit(5))).collect()]
    assert [g["mark"] for g in got] == [3.0, 5.0, 2.5, None] and [g["parsed"] for g in got] == [True, True, True, False]


def test_objective(spark):
    q = "Pick\nA. mean\nB. mode"
    rows = [("b)", q, "mcq", "B", ""), ("mode", q, "mcq", "B", ""), ("A", q, "mcq", "", "The answer is B."), ("T", "x", "true_false", "True", ""), ("no", "x", "true_false", "", "It is not true"), ("x", q, "mcq", "", "")]
    df = spark.createDataFrame([(i, *r, 2.0) for i, r in enumerate(rows)], "_id int, answer_text string, question_text string, question_type string, correct_answer string, model_answer string, max_marks double")
    got = marking.mark_objective(df).orderBy("_id").collect()
    assert [r["auto_mark"] for r in got] == [2.0, 2.0, 0.0, 2.0, 2.0, 0.0] and [r["is_flagged"] for r in got] == [False] * 5 + [True]


def test_arithmetic(spark):
    df = spark.createDataFrame([("1+2*3",), ("sqrt(16)/2",), ("__import__('os')",), ("2**9999",), (None,), ("1/0",)], "e string")
    assert [r[0] for r in df.select(T.arithmetic("e")).collect()] == [7.0, 2.0, None, None, None, None]


def test_labels_and_options(spark):
    assert values(spark, T.generic_labels, ["Table 1.9 shows it.", "In Figure 2.3 we see", "Version 1.9 is out"]) == ["The table below shows it.", "In the figure below we see", "Version 1.9 is out"]
    assert values(spark, T.safe_csv, ["=1+1", " @x", "plain"]) == ["'=1+1", "' @x", "plain"]


def test_table_html(spark):
    got = values(spark, lambda c: T.table_html(c), ["| a | b |\n|---|---|\n| 1 | ? |", "no table"])
    assert got[0]["n_blanks"] == 1 and got[0]["html"].startswith("<table>") and got[1]["html"].startswith("<pre>")


def test_dump_restore_refresh(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "_id int, book_id string")
    tables.dump({"a": a, "none": a.where("false")}, f"{tmp_path}/dump")
    assert tables.restore(spark, f"{tmp_path}/dump", {"a": "_id int, book_id string", "none": "_id int"}, f"{tmp_path}/db") == ["a"]
    assert spark.read.parquet(f"{tmp_path}/db/a").count() == 2
    tables.refresh(a, f"{tmp_path}/books")
    tables.refresh(spark.createDataFrame([(7, "x")], "_id int, book_id string"), f"{tmp_path}/books")
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/books").select("_id").collect()) == [2, 7]
    tables.write_csv(spark.createDataFrame([("=x", 1)], "c string, n int"), f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).first()["c"] == "'=x"


def test_golden(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text('{"book_id": "b", "queries": [{"query": "mean", "expect": {"pages": [1]}}]}')
    assert tables.read_golden(spark, str(p)).first()["pages"] == [1]
    p.write_text('{"book_id": "b", "queries": []}')
    with pytest.raises(ValueError, match="no queries"):
        tables.read_golden(spark, str(p))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "p.txt").write_text("a\nb")
    assert tables.read_pages(spark, f"{tmp_path}/t", "text").first()["text"] == "a\nb"


@pytest.mark.parametrize("threshold", [0.3, 0.92])
def test_similar_pairs_against_all_pairs(spark, threshold, monkeypatch):
    """Clusters of near vectors, one of them with a third of all rows, unusable vectors, and several parts a cell."""
    import numpy as np

    monkeypatch.setattr(retrieval, "HELD", 16)
    monkeypatch.setattr(retrieval, "PIVOTS", 7)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(9, 12))
    v = np.concatenate([centres[rng.integers(0, 9, 120)] + 0.25 * rng.normal(size=(120, 12)), centres[0] + 0.2 * rng.normal(size=(60, 12))])
    rows = [(i, f"c{i % 2}", x.tolist()) for i, x in enumerate(v)] + [(900, "c0", None), (901, "c0", []), (902, "c1", [0.0] * 12)]
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    table = spark.createDataFrame(rows, "_id long, chapter string, embedding array<double>").repartition(5)
    for scope in ("chapter", None):
        got = {(r["a"], r["b"]): r["similarity"] for r in retrieval.similar_pairs(table, scope, threshold).collect()}
        want = {(a, b): float(unit[a] @ unit[b]) for a in range(180) for b in range(a + 1, 180) if unit[a] @ unit[b] >= threshold and (scope is None or a % 2 == b % 2)}
        assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want) and len(want) > 100
    assert retrieval.similar_pairs(table.where("false"), None, threshold).collect() == []


def test_vector_topk_in_blocks(spark, monkeypatch):
    """Blocks smaller than a scope, equal vectors, unusable ones, and struct ids."""
    import numpy as np

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 5)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    v[10:20] = v[3]
    rows = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)] + [(70, 0, None), (71, 1, [0.0] * 8)], "_id long, chapter int, embedding array<double>")
    queries = rows.where("_id % 7 = 0 OR _id = 70").withColumnRenamed("_id", "query_id")
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = lambda q, of: [i for _, i in sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in of)][:4]
    for scope, pre in (((), True), (("chapter",), True), (("chapter",), False)):
        got = {}
        for r in sorted(retrieval.vector_topk(queries, rows, 4, scope, pre).collect(), key=lambda r: r["rank"]):
            got.setdefault(r["query_id"], []).append(r["_id"])
        for q in range(0, 60, 7):
            if scope and pre:
                assert got[q] == near(q, range(q % 3, 60, 3))
            else:
                assert got.get(q, []) == [i for i in near(q, range(60)) if not scope or i % 3 == q % 3]


def test_latch_against_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = [(f"b{b}", p, rng.choice((1, 1, 2, 3, 4, 5, 9)), "T") for b in range(4) for p in range(60)]
    for rule in ("next", "near"):
        got = {(r["book_id"], r["page"]): r["accepted"] for r in structure.latch_chapters(spark.createDataFrame(rows, "book_id string, page int, num int, title string").repartition(3), rule).collect()}
        for b in range(4):
            current, restarted = None, False
            for book, page, num, _ in rows:
                if book != f"b{b}":
                    continue
                if rule == "near":
                    ok = current is None or current <= num <= current + 3
                else:
                    ok = current is None or num in (current, current + 1) or (num == 1 and not restarted)
                if ok:
                    restarted = restarted or (current is not None and num == 1 and current != 1)
                    current = num
                assert got[book, page] == ok


def test_limits_and_lockouts_against_loops(spark):
    """Histories of one key that make many batches; equal times among them."""
    import datetime
    import random

    from textbank.streaming import operators as streams

    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    hits = sorted((f"k{rng.randrange(3)}", start + datetime.timedelta(seconds=rng.randrange(4000)), rng.random() < 0.3) for _ in range(1500))
    table = spark.createDataFrame(hits, "key string, ts timestamp, ok boolean").repartition(4)
    limited = sorted((r["key"], r["ts"], r["limited"]) for r in streams.limit_hits(table.select("key", "ts"), 3, 60).collect())
    outcomes = sorted((r["key"], r["ts"], r["outcome"]) for r in streams.lockouts(table, 5, 120).collect())
    want_limited, want_outcomes = [], []
    for k in ("k0", "k1", "k2"):
        held, failures, until = [], 0, start
        for key, ts, ok in hits:
            if key != k:
                continue
            held = [h for h in held if (ts - h).total_seconds() < 60]
            want_limited.append((key, ts, len(held) >= 3))
            if len(held) < 3:
                held.append(ts)
            if ts < until:
                want_outcomes.append((key, ts, "rejected"))
            elif ok:
                failures = 0
                want_outcomes.append((key, ts, "success"))
            else:
                failures += 1
                want_outcomes.append((key, ts, "locked" if failures >= 5 else "failure"))
                if failures >= 5:
                    failures, until = 0, ts + datetime.timedelta(seconds=120)
    assert limited == sorted(want_limited) and outcomes == sorted(want_outcomes)


def test_validation_keeps_whole_texts(spark):
    from textbank.operators import chunking

    row = spark.createDataFrame([(" " + "x" * 10_000 + " ", "m" * 5000, None, "s" * 400, ["a", " a ", "", "b"], None, ["t"] * 40, 9, 3)], "text string, math_text string, chapter_title string, section_title string, table_texts array<string>, image_texts array<string>, key_terms array<string>, page_start int, page_end int")
    r = chunking.validate(row).first()
    assert (len(r["text"]), len(r["math_text"]), r["chapter_title"], len(r["section_title"]), r["table_texts"], r["image_texts"], r["key_terms"], r["page_start"], r["page_end"]) == (10_000, 4000, "Unknown", 300, ["a", "b"], [], ["t"], 3, 9)


def test_cleaning_of_long_runs(spark):
    """White space of 100,000 characters in a row costs no more than its length."""
    import time

    from textbank.operators import cleaning

    texts = ["a" + " " * 100_000 + "b", "a-" + "\n" * 100_000 + "B", "x\n" + " \n" * 50_000 + "y", "|" * 100_000 + " z", "1\n" * 50_000]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    table.select(cleaning.clean(F.col("t"))).collect()
    began = time.time()
    got = [r[0] for r in table.orderBy("i").select(cleaning.clean(F.col("t"))).collect()]
    assert time.time() - began < 20
    assert got[0] == "a b" and got[1].startswith("a-") and got[3] == texts[3] and got[4] == "1\n1"


def test_render_kinds(spark):
    formulas = spark.createDataFrame([(1, 2, "b = c", None, None, None), (1, 1, "a = b", "Mean", "The mean is a.", None), (2, 1, None, "", None, "x is y")], "query_group int, rank int, formula_latex string, concept_label string, context_sentence string, formula_plain string")
    got = {r["query_group"]: r["block"].split("\n") for r in retrieval.render_kind(formulas, "formula").collect()}
    assert got[1][1:] == ["- Mean: a = b   (The mean is a.)", "- formula: b = c"] and got[2][1:] == ["- formula: x is y"]
    figures = spark.createDataFrame([(1, 1, "bar", None, "size by year", "d" * 300, 3), (1, 2, None, "Figure 1.2 Ages", None, None, None)], "query_group int, rank int, figure_kind string, caption string, axis_summary string, description string, chapter_num int")
    block = retrieval.render_kind(figures, "figure").first()["block"].split("\n")
    assert block[1:] == ["- [bar] bar (Ch3, p.?) — size by year", "  Description: " + "d" * 280, "- [figure] Figure 1.2 Ages", "  Description: "]
    tables_ = spark.createDataFrame([(1, 1, None, "\n".join(f"| {i} |" for i in range(20)))], "query_group int, rank int, table_summary string, table_markdown string")
    assert retrieval.render_kind(tables_, "table").first()["block"].split("\n")[1:] == ["- table (Ch?, p.?)", *(f"| {i} |" for i in range(8))]


def test_clean_each(spark):
    """Each text of an array as it would be cleaned alone."""
    items = ["A line\nA line\nA line\nb́ end", "", None, "x\n\n12\n\n| | |\nof the\nsame", "CC BY 4.0 at the end"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "_id int, text string")
    alone = [r[0] for r in frame.orderBy("_id").select(cleaning.clean(F.col("text"))).collect()]
    rows = spark.createDataFrame([(1, items), (2, None), (3, [])], "_id int, own array<string>")
    got = {r["_id"]: r["own"] for r in cleaning.clean_rows(rows, [], ["own"]).collect()}
    assert got == {1: alone, 2: None, 3: []} and alone[0] == "A line\nA line\nb́ end".replace("b́", "b́")


def test_topk_without_a_broadcast(spark, monkeypatch):
    """Queries in more blocks than are broadcast give the same rows, dealt by part."""
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("_id"), "embedding", F.col("label").alias("chapter_num"))
    q = v.where("_id % 5 = 0").withColumnRenamed("_id", "query_id")
    rows = lambda frame: sorted(map(str, frame.collect()))
    for scope in ((), ("chapter_num",)):
        want = rows(retrieval.vector_topk(q, v, 4, scope))
        monkeypatch.setattr(retrieval, "MOST_BLOCKS", 0)
        monkeypatch.setattr(retrieval, "ROW_BLOCK", 50)
        found = retrieval.vector_topk(q, v, 4, scope)
        assert rows(found) == want
        monkeypatch.undo()
