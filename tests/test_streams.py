"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from textbank.sources import keyed
from textbank.streaming import marking as stream_marking
from textbank.streaming import operators as streams
from textbank.streaming import stateful


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """events by time in a few files, read as a batch or as a stream of one file at a time."""
    path = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    for i, (a, b) in enumerate([(0, 300), (300, 600), (600, 10**9)]):
        e.where((F.col("event_id") >= a) & (F.col("event_id") < b)).coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.parquet(path)
    return batch, lambda: spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(autouse=True)
def state_store(spark):
    """Streams with timers set another state store for the session."""
    before = spark.conf.get(stateful._PROVIDER)
    yield
    spark.conf.set(stateful._PROVIDER, before)


def drain(spark, df, name, mode="append", path=None):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def same(a, b, columns):
    key = lambda df: sorted(str(tuple(r)) for r in df.select(*columns).collect())
    assert key(a) == key(b)


def test_limits(spark, events, tmp_path):
    batch, stream = events
    hits = lambda df: df.select((F.col("user_id") % 3).alias("key"), "ts")
    same(streams.limit_hits(hits(batch), 3, 3600), drain(spark, stateful.limit_hits(hits(stream()), 3, 3600, "40 days"), "limits", path=str(tmp_path)), ["key", "ts", "limited"])


def test_lockouts(spark, events, tmp_path):
    batch, stream = events
    hits = lambda df: df.select((F.col("user_id") % 3).alias("key"), "ts", (F.col("event_type") == "signup").alias("ok"))
    same(streams.lockouts(hits(batch), 4, 7200), drain(spark, stateful.lockouts(hits(stream()), 4, 7200, 10**7, "40 days"), "lockouts", path=str(tmp_path)), ["key", "ts", "outcome"])


def test_changes(spark, events, tmp_path):
    batch, stream = events
    jobs = lambda df: df.select((F.col("user_id") % 7).alias("job_id"), "ts", F.col("event_type").alias("status"), F.lit("m").alias("message"))
    same(streams.changes(jobs(batch), "job_id", ["status", "message"], final=("purchase",)), drain(spark, stateful.changes(jobs(stream()), ("purchase",), 10**7, "40 days"), "changes", path=str(tmp_path)), ["job_id", "ts", "status"])


def test_counts(spark, events, tmp_path):
    batch, stream = events
    same(streams.tumbling_counts(batch, "event_type"), drain(spark, streams.tumbling_counts(stream(), "event_type", delay="40 days"), "counts", "complete", str(tmp_path)), ["start", "kind", "n"])


def test_once_only(spark, events, tmp_path):
    batch, stream = events
    got = drain(spark, streams.once_only(stream().select("user_id", "event_type", "ts"), ["user_id", "event_type"], delay="40 days"), "once", path=str(tmp_path))
    same(streams.once_only(batch.select("user_id", "event_type", "ts"), ["user_id", "event_type"]), got, ["user_id", "event_type"])


def test_last_drafts(spark, events, tmp_path):
    batch, stream = events
    same(streams.last_drafts(batch, ["user_id"], "value"), drain(spark, streams.last_drafts(stream(), ["user_id"], "value"), "drafts", "complete", str(tmp_path)), ["user_id", "value"])


def test_expiry_timer(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "2024-01-01 00:10:00", False), (2, "2024-01-01 00:00:00", "2024-01-01 00:10:00", False), (2, "2024-01-01 00:05:00", "2024-01-01 00:10:00", True), (3, "2024-01-01 02:00:00", "2024-01-01 03:00:00", False)]
    df = spark.createDataFrame(rows, "attempt_id long, ts string, deadline_at string, finished boolean").withColumns({c: F.col(c).cast("timestamp") for c in ("ts", "deadline_at")})
    for i in (1, 3):
        df.where("attempt_id < 3" if i == 1 else "attempt_id = 3").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drain(spark, streams.expire_idle_stream(stream), "expiry", path=f"{tmp_path}/c")
    assert [r["attempt_id"] for r in got.collect()] == [1]


def test_upsert_batches(spark, events, tmp_path):
    batch, stream = events
    q = stream().select((F.col("event_id") % 50).alias("_id"), "value", "event_id").writeStream.foreachBatch(keyed.upsert_batches(f"{tmp_path}/t", order="event_id", buckets=4)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = batch.groupBy((F.col("event_id") % 50).alias("_id")).agg(F.max("event_id").alias("event_id"))
    same(last, keyed.read_keyed(spark, f"{tmp_path}/t"), ["_id", "event_id"])


QUESTIONS = "_id long, question_text string, question_type string, correct_answer string, model_answer string, rubric string, max_marks double"


def marker(folder):
    def ask(row):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        if row["answer_text"] == "fail":
            raise OSError("the marker is away")
        return '{"mark": 3, "feedback": "half"}'

    return ask


def test_marking_of_arrivals(spark, tmp_path):
    """Submissions in two files, one read twice and one id in both: outcomes once, as the batch gives them, and no marker asked again."""
    calls = tmp_path / "calls"
    calls.mkdir()
    questions = spark.createDataFrame([(1, "Which?\nA. x\nB. y\nC. z", "mcq", "B", None, None, 2.0), (2, "Is it?", "true_false", None, "No, it is not", None, 1.0), (3, "Why is it so?", "short_answer", None, "because of gravity", "gravity and mass", 6.0)], QUESTIONS)
    rows = [(1, 1, "b"), (2, 1, "c"), (3, 2, "false"), (4, 3, "of gravity"), (5, 3, "fail"), (6, 9, "x"), (7, 3, None), (8, 3, "because of gravity and mass"), (9, None, "x")]
    frame = spark.createDataFrame(rows, "_id long, question_id long, answer_text string")
    embedder = lambda texts: [[1.0, 0.0] if "because" in t else [0.0, 1.0] for t in texts]
    for part in ("_id < 5", "_id > 3"):
        frame.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    arriving = lambda: spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = lambda c: stream_marking.mark_stream(arriving(), questions, f"{tmp_path}/t", f"{tmp_path}/{c}", marker(calls), embedder, 4).trigger(availableNow=True).start().awaitTermination(200)
    run("c1")
    got = {r["_id"]: (r["auto_mark"], r["is_flagged"], r["auto_feedback"]) for r in keyed.read_keyed(spark, f"{tmp_path}/t").collect()}
    assert got == {
        1: (2.0, False, "[Route:HIGH Conf:1.00] Correct."),
        2: (0.0, False, "[Route:HIGH Conf:1.00] Not correct."),
        3: (1.0, False, "[Route:HIGH Conf:1.00] Correct."),
        4: (3.0, True, "[Route:LOW Conf:0.20] half"),
        5: (0.0, True, "Marking failed: the marker is away"),
        6: (0.0, True, "Marking failed: question not found"),
        7: (3.0, True, "[Route:LOW Conf:0.00] half"),
        8: (6.0, False, "[Route:HIGH Conf:1.00] Full marks."),
        9: (0.0, True, "Marking failed: question not found"),
    }
    asked = len(list(calls.iterdir()))
    assert asked == 3
    files = set((tmp_path / "t").rglob("*.parquet"))
    run("c1")  # goes on where it ended
    run("c2")  # and from the start, as after a lost checkpoint
    assert len(list(calls.iterdir())) == asked and keyed.read_keyed(spark, f"{tmp_path}/t").count() == 9
    assert set((tmp_path / "t").rglob("*.parquet")) == files
    batch = {r["_id"]: (r["auto_mark"], r["is_flagged"], r["auto_feedback"]) for r in stream_marking.mark(frame, questions, marker(calls), embedder).collect()}
    assert batch == got
