"""Ordered work over pieces: one book over 16 of them gives what a loop gives."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from textbank.operators import chunking, folds, structure
from textbank.streaming import operators as streams

PIECES = 16


def no_piece_holds(frame, key, most):
    """The greatest share of a key's rows that lies in one partition is at most `most`."""
    by = frame.groupBy(key, F.spark_partition_id().alias("p")).count().collect()
    for k in {r[key] for r in by}:
        own = [r["count"] for r in by if r[key] == k]
        if k == "hot":
            assert max(own) <= most * sum(own)


def latch_loop(nums, rule):
    current, restarted, out = None, False, []
    for num in nums:
        if rule == "near":
            ok = current is None or current <= num <= current + 3
        else:
            ok = current is None or num in (current, current + 1) or (num == 1 and not restarted)
        if ok:
            restarted = restarted or (rule == "next" and current is not None and num == 1 and current != 1)
            current = num
        out.append(ok)
    return out


@pytest.mark.parametrize("rule", ["next", "near"])
def test_latch(spark, rule):
    rng = random.Random(3)
    rows = [("hot", p, rng.choice((1, 1, 2, 3, 4, 5, 9, 6, 7)), "T") for p in range(900)] + [(f"b{b}", p, rng.choice((1, 2, 3, 50)), "T") for b in range(5) for p in range(9)] + [(None, 1, 2, "T"), (None, 2, 3, None)]
    frame = spark.createDataFrame(rows, "book_id string, page int, num int, title string").repartition(5)
    found = structure.latch_chapters(frame, rule, PIECES)
    no_piece_holds(found, "book_id", 0.25)
    got = {(r["book_id"], r["page"]): r["accepted"] for r in found.collect()}
    for book in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == book]
        assert [got[book, p] for _, p, *_ in own] == latch_loop([n for *_, n, _ in own], rule)
    assert structure.latch_chapters(frame.where("false"), rule).collect() == []


def pack_loop(pages, size):
    segment = block = length = 0
    out, pending = [], []

    def flush():
        nonlocal block, length, pending
        if pending:
            out.append((segment, block, pending[0][0], pending[-1][0], "\n".join(t for _, t in pending)))
            block += 1
        pending, length = [], 0

    for page, text, boundary in pages:
        if boundary:
            flush()
            segment, block = segment + 1, 0
        pending.append((page, text or ""))
        length += len(text or "")
        if length >= size:
            flush()
    flush()
    return out


@pytest.mark.parametrize("boundary", [0, 0.02, 0.5])
def test_packing(spark, boundary):
    """With few boundaries a piece has none, and its map is a table of steps."""
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", "x", "ab" * rng.randrange(1, 9), "y" * 120])
    rows = [("hot", p, text(), rng.random() < boundary) for p in range(800)] + [("b", p, text(), False) for p in range(7)] + [("c", 1, None, None)]
    frame = spark.createDataFrame(rows, "book_id string, page long, text string, boundary boolean").repartition(3)
    got = structure.pack_pages(frame, 50, PIECES).collect()
    for book in ("hot", "b", "c"):
        want = pack_loop([r[1:] for r in rows if r[0] == book], 50)
        assert sorted(tuple(r)[1:] for r in got if r["book_id"] == book) == want
    assert structure.pack_pages(frame.where("false"), 50).collect() == []


def test_packing_maps():
    """A run's summary gives what stepping through it gives, from every length."""
    rng = random.Random(8)
    for _ in range(300):
        size = rng.randrange(1, 12)
        fold = folds.packing(size)
        run, values = fold.begin(), [(rng.choice([0, 0, 1, 2, 5, 30]), rng.random() < 0.05) for _ in range(rng.randrange(12))]
        for v in values:
            run = fold.add(run, v)
        summary = fold.close(run)
        for length in range(size):
            state = (3, 4, length)
            for v in values:
                state, _ = fold.step(state, v)
            assert fold.apply((3, 4, length), summary) == state
        assert len(summary[2]) <= size


def test_carried(spark):
    rng = random.Random(6)
    pages = [("hot", p, rng.choice(["", "1.2 A Section Title\nmore", "3.4 Another Section", None])) for p in range(600)]
    heads = [("hot", p, p // 50 + 1, f"Chapter {p}", rng.random() < 0.8) for p in range(0, 600, 37)]
    frame = spark.createDataFrame(pages, "book_id string, page int, text string").repartition(4)
    found = structure.carry_forward(frame, spark.createDataFrame(heads, "book_id string, page int, num int, title string, accepted boolean"), PIECES)
    no_piece_holds(found, "book_id", 0.25)
    got = {r["page"]: (r["chapter_num"], r["chapter_title"], r["section_title"]) for r in found.collect()}
    num = title = None
    section = "Introduction"
    by_page = {p: (n, t) for _, p, n, t, ok in heads if ok}
    for _, page, text in pages:
        if page in by_page:
            (num, title), section = by_page[page], "Introduction"
        if text:
            section = text.split("\n")[0].split(" ", 1)[1]
        assert got[page] == (num, title, section)


def test_numbers(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.random()) for i in range(1000)]
    found = folds.numbered(spark.createDataFrame(rows, "g string, _id long, x double").repartition(3), ["g"], [F.desc("x"), "_id"], "place", PIECES)
    no_piece_holds(found, "g", 0.25)
    for g in ("hot", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        assert sorted((r["place"], r["_id"]) for r in found.collect() if r["g"] == g) == [(i, r[1]) for i, r in enumerate(own, 1)]


def test_quota(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), "x" * rng.choice([10, 1500, 1600]), rng.choice([0.1, 0.5, 0.9])) for i in range(200)] + [(200, "a", None, 0.9)]
    got = {r["_id"] for r in chunking.semantic_quota(spark.createDataFrame(rows, "_id long, source string, text string, teaching_density double"), "source").where("chosen").collect()}
    want = set()
    for g in ("a", "b", None):
        own = [r for r in rows if r[1] == g]
        long = sorted((r for r in own if r[2] and len(r[2]) >= 1500), key=lambda r: (-r[3], r[0]))
        want |= {r[0] for r in long[: -(-len(own) * 20 // 100)]}
    assert got == want


@pytest.mark.parametrize("gap", [0.5, 40])
def test_limits_and_lockouts(spark, gap):
    """One key over 16 pieces: with short gaps the state is never forgotten and pieces run again, with long ones it is."""
    rng = random.Random(4)
    start, at, rows = datetime.datetime(2024, 1, 1), 0.0, []
    for _ in range(700):
        at += rng.choice([0.0, gap, gap * rng.random()])
        rows.append(("hot", start + datetime.timedelta(seconds=round(at, 3)), rng.random() < 0.1))
    rows += [(f"k{i % 9}", start + datetime.timedelta(seconds=i), False) for i in range(200)] + [(None, datetime.datetime(1960, 1, 1), True)]
    table = spark.createDataFrame(rows, "key string, ts timestamp, ok boolean").repartition(4)
    limits, outcomes = streams.limit_hits(table, 3, 60, PIECES), streams.lockouts(table, 4, 90, PIECES)
    no_piece_holds(limits, "key", 0.25)
    got_limits = sorted(str(tuple(r)) for r in limits.collect())
    got_outcomes = sorted(str(tuple(r)) for r in outcomes.collect())
    want_limits, want_outcomes = [], []
    for key in {r[0] for r in rows}:
        held, failures, until = [], 0, datetime.datetime(1900, 1, 1)
        for _, ts, ok in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            held = [h for h in held if (ts - h).total_seconds() < 60]
            want_limits.append(str((key, ts, len(held) >= 3)))
            if len(held) < 3:
                held.append(ts)
            if ts < until:
                outcome = "rejected"
            elif ok:
                failures, outcome = 0, "success"
            else:
                failures, outcome = failures + 1, "failure"
                if failures >= 4:
                    failures, until, outcome = 0, ts + datetime.timedelta(seconds=90), "locked"
            want_outcomes.append(str((key, ts, outcome)))
    assert got_limits == sorted(want_limits) and got_outcomes == sorted(want_outcomes)
