"""Operators whose queries have no SQL, against plain Python over whole documents or by hand."""

import re

import pytest
from pyspark.sql import functions as F

from textbank.functions.text import concept_queries
from textbank.operators import chunking, cleaning, curation, quality, retrieval, structure


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("_id"), "text")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n \n "), (-4, "One two three four.\nOne two three four.\n\nfive"), (-5, "Ünïcode wörter ünïcode.\nÜnïcode wörter hier")], "_id long, text string")
    return rows.unionByName(odd).cache()


def by_id(frame, column):
    return {r["_id"]: r[column] for r in frame.collect()}


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def redundant(part, base, threshold=0.8):
    own, other = words(part), set(words(base))
    return not own or sum(w in other for w in own) / len(own) >= threshold


def test_paragraphs(docs):
    """CH-2."""
    got = by_id(docs.select("_id", chunking.paragraph_split(F.regexp_replace("text", r"\n", "\n\n"), 300).alias("parts")), "parts")
    for i, text in by_id(docs, "text").items():
        hard = [p[k : k + 300] for p in (x.strip(" \t\n\x0b\f\r") for x in re.sub("\n", "\n\n", text or "").split("\n\n")) if p for k in range(0, len(p), 300)]
        want = []
        for p in hard:
            if want and len(want[-1]) + 2 + len(p) <= 300:
                want[-1] += "\n\n" + p
            else:
                want.append(p)
        assert got[i] == want, i


def test_redundancy(docs):
    """CH-9, CH-10 and CH-11."""
    first = lambda t: (t or "").split("\n")[0]
    rest = lambda t: "\n".join((t or "").split("\n")[1:])
    texts = docs.where("text IS NOT NULL")
    t = F.col("text")
    lines = F.split(t, "\n")
    found = texts.select(
        "_id", "text", chunking.redundant(F.get(lines, 0), F.array_join(F.slice(lines, 2, F.size(lines)), "\n")).alias("redundant"),
        chunking.embedding_text(t, F.slice(lines, 1, 2), F.array(F.lit("A chart of quite other things")), F.lit("x = y")).alias("embedding"),
        chunking.drop_repeated_content(t, F.filter(lines, lambda x, i: i % 3 == 0)).alias("kept"), chunking.drop_repeated_math(F.concat(F.get(lines, 0), F.lit(" zq")), t, F.array(t)).alias("math"),
    ).collect()
    for r in found:
        text = r["text"]
        own = text.split("\n")
        assert r["redundant"] == redundant(first(text), rest(text)), r["_id"]
        parts = [text] + [p[:cap] for p, cap in (("\n".join(own[:2]), 1500), ("A chart of quite other things", 1200), ("x = y", 800)) if not redundant(p, text)]
        assert r["embedding"] == "\n\n".join(parts), r["_id"]
        known = {w for x in own[::3] for w in words(x)}
        kept = "\n".join(x for x in own if not (len(words(x)) >= 3 and sum(w in known for w in words(x)) >= 0.75 * len(words(x))))
        assert r["kept"] == (kept if kept.strip(" \t\n\x0b\f\r") else text), r["_id"]
        math = own[0] + " zq"
        assert r["math"] == ("" if redundant(math, text, 0.92) else math), r["_id"]


def test_noisiest(docs):
    """CL-18: the noisiest rows of all, in order, with beginnings before and after."""
    noisy = docs.withColumn("text", F.when(F.col("_id") % 7 == 0, F.concat(F.lit("\x01​CC BY 4.0\n"), "text")).otherwise(F.col("text")))
    rows = noisy.select("_id", "text", cleaning.noise_ratio(F.col("text")).alias("ratio"), cleaning.clean(F.col("text")).alias("cleaned")).collect()
    want = sorted(((-round(r["ratio"], 6), r["_id"], r["text"][:300], r["cleaned"][:300]) for r in rows if r["ratio"] and round(r["ratio"], 6) > 0.005))[:10]
    got = cleaning.noisiest(noisy).collect()
    assert [(-r["noise"], r["_id"], r["before"], r["after"]) for r in got] == want and len(want) == 10


def test_descriptions(spark):
    """DS-19."""
    rows = [(1, 0, "TEXT: some words "), (1, 1, "chart: bars of it"), (1, 2, "NO_CHART here"), (1, 3, "plain"), (1, 4, "text:more"), (2, 0, "TEXT:"), (2, 1, None)]
    got = {r["_id"]: (r["extra_text"], r["image_texts"]) for r in structure.triage_descriptions(spark.createDataFrame(rows, "_id int, pos int, description string")).collect()}
    assert got == {1: ("some words\nmore", ["bars of it", "plain"]), 2: ("", [])}


def test_issues(spark):
    """QC-6."""
    summary = spark.createDataFrame([("a", 2, 0, 90.0), ("b", 0, 1, 40.0), ("c", 0, 0, 100.0), ("d", None, None, None)], "book_id string, n_missing int, n_blank int, pct double")
    rules = [("FAIL", "pages are missing", F.col("n_missing") > 0), ("WARN", "pages are blank", F.col("n_blank") > 0), ("WARN", "half", F.col("pct") < 50)]
    assert sorted(tuple(r) for r in quality.issues(summary, rules).collect()) == [("a", "FAIL", "pages are missing"), ("b", "WARN", "half"), ("b", "WARN", "pages are blank")]


def test_concept_queries(spark):
    """RT-11."""
    rows = [("What is the mean, roughly, of it?", "The mean is a sum."), ("short", "SHORT"), (None, None), ("x" * 400, "y" * 300), ("Explain the median of data.", "")]
    got = [r[0] for r in spark.createDataFrame(rows, "q string, r string").select(concept_queries(F.col("q"), F.col("r"))).collect()]
    assert got == [["What is the mean, roughly, of it?", "What is the mean", "The mean is a sum."], ["short"], [], ["x" * 300, "x" * 400, "y" * 200], ["Explain the median of data.", "Explain the median of data"]]


def test_routed_retrieval(spark):
    """RT-10: lists by intent, fused over a group's queries, capped, with parents of specialist rows."""
    axis = lambda i: [1.0 if j == i else 0.0 for j in range(6)]
    mix = lambda i, j, w: [w * a + (1 - w) * b for a, b in zip(axis(i), axis(j), strict=True)]
    schema = "_id string, embedding array<double>, chapter_num int, parent_chunk_id string"
    index = lambda rows: spark.createDataFrame(rows, schema)
    indexes = {
        "text": index([("t1", axis(0), 1, None), ("t2", mix(0, 1, 0.6), 1, None), ("t3", axis(1), 1, None), ("t9", axis(0), 2, None), ("p1", axis(5), 1, None), ("p2", axis(4), 1, None)]),
        "formula": index([("f1", axis(0), 1, "p1"), ("f2", axis(1), 1, "t1"), ("f3", mix(0, 1, 0.9), 1, "p2"), ("f4", axis(3), 1, None)]),
        "figure": index([("g1", axis(0), 1, "t3")]),
        "table": index([("b1", axis(0), 1, None)]),
    }
    queries = spark.createDataFrame([("g", 1, "what is it", axis(0), 1), ("g", 2, "compute the variance", mix(0, 1, 0.55), 1), ("h", 3, "read the histogram", axis(0), 1)], "query_group string, query_id int, query string, embedding array<double>, chapter_num int")
    got = {(r["query_group"], r["kind"], r["place"]): r["_id"] for r in retrieval.routed_retrieve(queries, indexes, k=4).collect()}
    # Two text rows a query of g: t1, t2 and t2, t1 (t1 came first); the formulas of the computational one; f3 and f1 have parents that are no hits.
    assert [got.get(("g", "text", i)) for i in (1, 2, 3)] == ["t1", "t2", None]
    assert [got.get(("g", "formula", i)) for i in (1, 2, 3, 4)] == ["f3", "f1", "f2", None]
    assert [got.get(("g", "parent", i)) for i in (1, 2, 3)] == ["p2", "p1", None]
    assert ("g", "figure", 1) not in got and got["h", "figure", 1] == "g1" and got["h", "table", 1] == "b1" and ("h", "formula", 1) not in got
    assert [got.get(("h", "text", i)) for i in (1, 2, 3, 4)] == ["t1", "t2", "p1", "p2"]


def test_fallback_questions(spark):
    """QB-23: more items than sentences, all forms, terms chosen by sentence or in turn."""
    text = "The sample mean is a number that tells the centre of data. Is this a question that should be left out of here? See Figure 2 for the shape of the whole distribution now. Too short. The spread of the data around its centre is told by the variance!"
    rows = [(1, text, "Data", ["Centre", "figure", " variance. ", "centre"]), (2, "80.", "T", None), (3, None, "T", ["x"])]
    frame = spark.createDataFrame(rows, "_id int, text string, topic_tag string, key_terms array<string>")
    a, b = "The sample mean is a number that tells the centre of data.", "The spread of the data around its centre is told by the variance!"
    got = {r["place"]: r for r in curation.fallback_questions(frame, "short_answer", 5).collect()}
    assert [got[i]["model_answer"] for i in range(5)] == [a, b, a, b, a]
    assert got[1]["question_text"] == "What does the source state about Centre in Data?" and got[0]["max_marks"] == 2.0
    mcq = {r["place"]: r for r in curation.fallback_questions(frame, "mcq", 2).collect()}
    assert mcq[0]["question_text"].split("\n") == ["Which of the following best describes Centre in the context of Data?", f"A. {a}", "B. Centre only applies when every data value is identical.", "C. Centre is unrelated to probability or sampling.", "D. Centre eliminates the need to interpret data in context."]
    assert [r["question_text"] for r in curation.fallback_questions(frame, "true_false", 2).orderBy("place").collect()] == [a, b + "."]
    assert curation.fallback_questions(frame, "mcq", 0).collect() == []
    with pytest.raises(ValueError, match="a question is"):
        curation.fallback_questions(frame, "essay", 1)
    turns = frame.where("_id = 1").withColumn("key_terms", F.array(F.lit("alpha"), F.lit("beta (b)"))).withColumn("text", F.lit("Words that are of no use to anyone stand in this line. Other words that are of use to nobody stand in this one."))
    assert [r["question_text"] for r in curation.fallback_questions(turns, "short_answer", 3).orderBy("place").collect()] == [f"What does the source state about {t} in Data?" for t in ("alpha", "beta (b", "alpha")]


def test_distractors(spark):
    """QB-3: missing options in order, the model answer as the missing key, none that repeats the right text."""
    wrong = "It removes the need to check the conditions or assumptions of the method."
    rows = [
        (1, "Which?", {"C": "given"}, "The correct answer is B. because", None, "Data"),
        (2, "Which?\nA. one\nB. two\nC. three\nD. four", None, "C. three", None, "Data"),
        (3, "Which?", None, wrong, None, None),
        (4, "Which?", {"B": "two"}, None, "D", "Data"),
    ]
    frame = spark.createDataFrame(rows, "_id int, question_text string, options map<string,string>, model_answer string, correct_answer string, topic_tag string")
    got = {r["_id"]: r for r in curation.normalise_mcq(frame).collect()}
    first = "It applies only when every observed value in {} is identical."
    assert got[1]["correct_answer"] == "B" and got[1]["filled"] == ["A", "D"] and got[1]["options"] == {"A": first.format("Data"), "B": "because", "C": "given", "D": wrong}
    assert got[2]["correct_answer"] == "C" and got[2]["filled"] == [] and got[2]["options"]["D"] == "four"
    third = ["It reverses the interpretation of the relationship described in the question.", "It treats a sample result as if it were always the exact population value."]
    assert got[3]["correct_answer"] == "A" and got[3]["options"] == {"A": wrong, "B": first.format("this topic"), "C": third[0], "D": third[1]}
    assert got[4]["options"] == {"A": first.format("Data"), "B": "two", "C": wrong, "D": curation.NO_ANSWER}
    assert got[4]["question_text"] == "\n".join(["Which?", *(f"{x}. {got[4]['options'][x]}" for x in "ABCD")])
