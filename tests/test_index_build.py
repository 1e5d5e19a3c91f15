"""Indexes built step by step, and tables written by bucket."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from textbank.operators import index_build
from textbank.sources import keyed, tables

SCHEMA = "_id string, book_id string, text string, math_text string, table_texts array<string>, image_texts array<string>"


def chunks(spark, changed=False):
    rows = [(f"c{i}", "b1" if i < 8 else "b2", "Some prose of this chunk about the mean value.", f"x = {i % 6}\ny_{i} = 3", [f"| Name | Size {i} of it |\n| a | 1 |"], [f"A bar chart of the number {i} of all"]) for i in range(12)]
    if changed:
        rows[3] = ("c3", "b1", rows[3][2], "x = 3\nnew = formula", *rows[3][4:])
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def teller(folder, reply):
    """An enricher that leaves a file for each call."""

    def ask(texts):
        import json
        import os
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump(texts, f)
        if any("y_5" in t for t in texts) and os.path.exists(f"{folder}/../fail"):
            raise OSError("the service is down")
        return "Here: " + json.dumps([reply(i, t) for i, t in enumerate(texts, 1)])

    return ask


def asked(folder):
    found = [json.load(open(f)) for f in glob.glob(f"{folder}/*")]
    for f in glob.glob(f"{folder}/*"):
        os.rename(f, f"{folder}/../seen-{os.path.basename(f)}")
    return found


def test_formulas_step_by_step(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    ask = teller(str(calls), lambda i, t: {"i": i, "concept_label": f"L {t}", "formula_plain": "" if "= 2" in t else f"P {t}", "variables": {"x": "size"}})
    embedder = lambda texts: [[] if "y_7" in t else [float(len(t)), 1.0] for t in texts]
    path, cache = f"{tmp_path}/index", f"{tmp_path}/cache"

    def build(frame, books=None):
        entries, new = index_build.build_index("formulas", frame, keyed.read_keyed(spark, cache), ask, embedder, 5)
        keyed.upsert_keyed(new, cache, buckets=4)
        tables.refresh(entries, path, of=books)
        return {(r["book_id"], r["parent_chunk_id"], r["formula_latex"]): r for r in spark.read.parquet(path).collect()}

    first = build(chunks(spark))
    different = {f"x = {i}" for i in range(6)} | {f"y_{i} = 3" for i in range(12)}
    calls_made = asked(calls)
    assert sorted(map(len, calls_made)) == [3, 5, 5, 5] and {t for c in calls_made for t in c} == different
    assert len(first) == 23 and ("b1", "c7", "y_7 = 3") not in first  # no vector, no entry
    r = first["b1", "c1", "x = 1"]
    assert (r["concept_label"], r["formula_plain"], r["variables"], r["embedding"]) == ("L x = 1", "P x = 1", {"x": "size"}, [float(len("L x = 1: P x = 1")), 1.0])
    assert first["b1", "c2", "x = 2"]["formula_plain"] == "x = 2"  # an empty reply leaves the fallback

    files = set(glob.glob(f"{path}/book_id=b2/*.parquet"))
    assert build(chunks(spark)) .keys() == first.keys() and asked(calls) == []
    second = build(chunks(spark, changed=True).where("book_id = 'b1'"), ["b1"])
    assert asked(calls) == [["new = formula"]]
    assert ("b1", "c3", "new = formula") in second and ("b1", "c3", "y_3 = 3") not in second and len(second) == 23
    files = set(glob.glob(f"{path}/book_id=b2/*.parquet"))
    third = build(chunks(spark).where("book_id = 'b1'").withColumns({"math_text": F.lit(None).cast("string"), "text": F.lit("plain words")}), ["b1"])
    assert {k[0] for k in third} == {"b2"} and set(glob.glob(f"{path}/book_id=b2/*.parquet")) == files


def test_a_failed_call_is_made_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    (tmp_path / "fail").touch()
    ask = teller(str(calls), lambda i, t: {"i": i, "concept_label": t, "formula_plain": t})
    entries, new = index_build.build_index("formulas", chunks(spark), None, ask, None, 6)
    assert new.count() == 12 and entries.where("concept_label = ''").count() > 0
    asked(calls)
    os.remove(tmp_path / "fail")
    entries, more = index_build.build_index("formulas", chunks(spark), new, ask, None, 6)
    assert more.count() == 6 and len(asked(calls)) == 1 and entries.where("concept_label = ''").count() == 0


@pytest.mark.parametrize(("index", "reply", "column", "value", "other"), [
    ("tables", {"table_summary": "Sizes"}, "table_summary", "Sizes", "Name, Size 0 of it"),
    ("figures", {"kind": "Bar", "axis_summary": "x"}, "figure_kind", "bar", "other"),
])
def test_other_kinds(spark, tmp_path, index, reply, column, value, other):
    (tmp_path / "c").mkdir()
    ask = teller(str(tmp_path / "c"), lambda i, t: {"i": i, **reply})
    entries, new = index_build.build_index(index, chunks(spark), None, ask)
    assert {r[column] for r in entries.collect()} == {value} and new.count() == 12
    plain, nothing = index_build.build_index(index, chunks(spark).where("_id = 'c0'"))
    assert [r[column] for r in plain.collect()] == [other] and nothing is None
    with pytest.raises(ValueError, match="no index"):
        index_build.build_index("nothing", chunks(spark))
    assert index_build.build_index(index, chunks(spark).where("false"), new, ask)[0].collect() == []


def test_keyed_table(spark, tmp_path):
    """Buckets without new rows keep their files, the same batch twice changes nothing, and gaps in batch numbers do not matter."""
    path = f"{tmp_path}/t"
    rows = lambda ids, v: spark.createDataFrame([(i, v, k) for k, i in enumerate(ids)], "_id long, value string, at int")
    assert keyed.read_keyed(spark, path) is None
    write = keyed.upsert_batches(path, order="at", buckets=16)
    write(rows([*range(100), None], "a"), 0)
    files = lambda: set(glob.glob(f"{path}/bucket_of_16=*/*.parquet"))
    before = files()
    for number in (7, 7):
        write(rows([5, 5, 200], "b").withColumn("value", F.concat("value", F.col("at").cast("string"))), number)
    assert len(files() - before) <= 2 and len(before - files()) <= 2
    got = {r["_id"]: r["value"] for r in keyed.read_keyed(spark, path).collect()}
    assert got == {i: "a" for i in (*range(100), None)} | {5: "b1", 200: "b2"}
    keyed.upsert_keyed(rows([1], "c"), path, buckets=3)  # the table keeps its own number of buckets
    assert keyed.read_keyed(spark, path).where("_id = 1").collect()[0]["value"] == "c" and keyed.read_keyed(spark, path).count() == 102
