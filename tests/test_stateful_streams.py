"""Streams whose state ends: rows as the batch forms give them, and no state left after a pause."""

import datetime
import random

import pytest

from textbank.streaming import operators as streams
from textbank.streaming import stateful

START = datetime.datetime(2024, 1, 1)


@pytest.fixture
def run(spark, tmp_path):
    """Runs a stream over batches of rows, one file each, and gives its rows and the rows of state after each batch."""
    before = spark.conf.get(stateful._PROVIDER)

    def of(batches, schema, make):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        q = make(stream).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(240)
        return spark.table("found").collect(), [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]

    yield of
    spark.conf.set(stateful._PROVIDER, before)


def same(got, want):
    assert sorted(str(tuple(r)) for r in got) == sorted(str(tuple(r)) for r in want)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


#: A row so late moves the watermark past all states but its own.
LATER = at(10**6)


def test_limits(spark, run):
    rng = random.Random(1)
    hits = [[(f"k{rng.randrange(4)}", at(t)) for t in sorted(rng.randrange(100 * b, 100 * b + 100) for _ in range(60))] for b in range(3)]
    got, states = run([*hits, [("later", LATER)]], "key string, ts timestamp", lambda s: stateful.limit_hits(s, 3, 60))
    table = spark.createDataFrame([r for b in hits for r in b], "key string, ts timestamp")
    same([r for r in got if r["key"] != "later"], streams.limit_hits(table, 3, 60).collect())
    assert max(states) >= 4 and states[-1] == 1


def test_lockouts(spark, run):
    rng = random.Random(2)
    tries = [[(f"k{rng.randrange(4)}", at(t), rng.random() < 0.1) for t in sorted(rng.randrange(200 * b, 200 * b + 200) for _ in range(60))] for b in range(3)]
    schema = "key string, ts timestamp, ok boolean"
    got, states = run([*tries, [("later", LATER, True)]], schema, lambda s: stateful.lockouts(s, 4, 90, 3600))
    same([r for r in got if r["key"] != "later"], streams.lockouts(spark.createDataFrame([r for b in tries for r in b], schema), 4, 90).collect())
    assert {r["outcome"] for r in got} == {"success", "failure", "locked", "rejected"} and max(states) > 0 and states[-1] == 0


def test_changes(spark, run):
    rng = random.Random(3)
    told = [[(rng.randrange(5), at(t), rng.choice(["started", "running", "running", "done"]), rng.choice(["m", "n"])) for t in rng.sample(range(100 * b, 100 * b + 100), 40)] for b in range(3)]
    schema = "job_id long, ts timestamp, status string, message string"
    got, states = run([*told, [(99, LATER, "x", "x")]], schema, lambda s: stateful.changes(s, idle=3600))
    table = spark.createDataFrame([r for b in told for r in b], schema)
    same([r for r in got if r["job_id"] != 99], streams.changes(table, "job_id", ["status", "message"]).select("job_id", "ts", "status", "message").collect())
    assert max(states) >= 5 and states[-1] == 1


def test_a_pause_forgets(spark, run):
    """Failures before a long pause do not count with those behind it."""
    tries = [[("k", at(i), False) for i in range(3)], [("other", at(5000), False)], [("other", at(5001), False)], [("k", at(9000 + i), False) for i in range(3)]]
    got, _ = run(tries, "key string, ts timestamp, ok boolean", lambda s: stateful.lockouts(s, 4, 90, 600))
    assert {r["outcome"] for r in got} == {"failure"}
