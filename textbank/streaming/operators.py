"""Streams of submissions, attempts, drafts and job messages.

Functions that only aggregate or join take a batch or a stream alike. The
stateful ones are batch forms here; their streams, whose state ends, are in
stateful.py and expire_idle_stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from textbank.operators.folds import Fold, composed


def once_only(rows: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each key; on a stream, among rows that come within the delay (beyond it, append_new() of the sources keeps a table unique)."""
    if rows.isStreaming:
        return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    first = rows.groupBy(*keys).agg(F.min(F.struct(ts, *[c for c in rows.columns if c not in (*keys, ts)])).alias("r"))
    return first.select(*keys, "r.*")


def sliding_counts(rows: DataFrame, key: str, ts: str = "ts", width: str = "60 seconds", slide: str = "10 seconds", delay: str = "60 seconds") -> DataFrame:
    """start, key, n: hits of each key in each sliding window."""
    own = rows.withWatermark(ts, delay) if rows.isStreaming else rows
    return own.groupBy(F.window(ts, width, slide).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "key", "n")


def tumbling_counts(rows: DataFrame, kind: str, ts: str = "ts", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """start, kind, n: rows of each kind in each hour."""
    own = rows.withWatermark(ts, delay) if rows.isStreaming else rows
    return own.groupBy(F.window(ts, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def last_drafts(rows: DataFrame, keys: list[str], value: str, ts: str = "ts") -> DataFrame:
    """The latest value of each key; of equal times the greatest."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(ts, value)).alias(value), F.max(ts).alias(ts))


def lateness(submissions: DataFrame, deadlines: DataFrame, keys: list[str], grace: int = 30, ts: str = "ts") -> DataFrame:
    """submissions with late_by_seconds and accepted, by a static table of deadlines (keys, deadline_at, timing_mode); without a deadline all are accepted."""
    own = submissions.withWatermark(ts, f"{grace} seconds") if submissions.isStreaming else submissions
    late = F.greatest(F.lit(0), F.coalesce(F.unix_timestamp(ts) - F.unix_timestamp("deadline_at"), F.lit(0)))
    return own.join(deadlines, keys, "left").withColumn("late_by_seconds", late.cast("long")).withColumn("accepted", ~F.coalesce((F.col("timing_mode") == "strict") & (F.col("late_by_seconds") > grace), F.lit(False)))


def idle_sessions(heartbeats: DataFrame, key: str, gap: str = "10 minutes", ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """key, start, last, n: runs of heartbeats without a pause as long as the gap; a run that has ended is stale."""
    own = heartbeats.withWatermark(ts, delay) if heartbeats.isStreaming else heartbeats
    return own.groupBy(F.col(key).alias("key"), F.session_window(ts, gap).alias("w")).agg(F.max(ts).alias("last"), F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), "last", "n")


def stale(heartbeats: DataFrame, key: str, now: Column, seconds: int = 600, ts: str = "ts") -> DataFrame:
    """key, last of those that have not been heard of for so long."""
    return heartbeats.groupBy(F.col(key).alias("key")).agg(F.max(ts).alias("last")).where(F.unix_timestamp(now) - F.unix_timestamp("last") > seconds)


# The sliding limit: a hit over the limit is flagged and not recorded. held has the times of the last unlimited hits, `most` at most.
def _limit(times: list[float], held: list[float], most: int, seconds: float) -> tuple[list[bool], list[float]]:
    over = []
    for t in times:
        held = [h for h in held if h > t - seconds]
        over.append(len(held) >= most)
        if not over[-1]:
            held.append(t)
    return over, held


LIMITED = "key string, ts timestamp, limited boolean"


def limit_hits(rows: DataFrame, most: int, seconds: int = 60, pieces: int | None = None) -> DataFrame:
    """key, ts, limited for each hit (key, ts): whether the key had `most` unlimited hits in the time before it.

    A key's hits lie over as many pieces as they need; the state is `most` times.
    It is forgotten after a pause of `seconds`, so that a piece is rarely run again.
    """

    def step(held: list[float], values: tuple) -> tuple:
        over, held = _limit([values[0].timestamp()], held, most, seconds)
        return held, (over[0],)

    own = rows.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return composed(own, ["key"], ["ts"], Fold(["ts"], "limited boolean", list, step), pieces)


# The lockout: the tenth failure in a row locks for five minutes and starts the count afresh.
def _lockout(hits: list[tuple[float, bool]], failures: int, until: float, most: int, seconds: float) -> tuple[list[str], int, float]:
    out = []
    for t, ok in hits:
        if t < until:
            out.append("rejected")
        elif ok:
            failures = 0
            out.append("success")
        else:
            failures += 1
            if failures >= most:
                failures, until = 0, t + seconds
                out.append("locked")
            else:
                out.append("failure")
    return out, failures, until


OUTCOMES = "key string, ts timestamp, outcome string"


def lockouts(rows: DataFrame, most: int = 10, seconds: int = 300, pieces: int | None = None) -> DataFrame:
    """key, ts, outcome of each login attempt (key, ts, ok): success, failure, locked, or rejected while locked.

    Of attempts at one time, failures come first. A key's attempts lie over as many
    pieces as they need; the state is the failures in a row and the end of the
    lock, which a success or a lock that has run out makes one and the same.
    """

    def step(state: tuple, values: tuple) -> tuple:
        out, failures, until = _lockout([(values[0].timestamp(), bool(values[1]))], *state, most, seconds)
        return (failures, until if out[0] in ("locked", "rejected") else never), (out[0],)

    never = float("-inf")
    own = rows.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return composed(own, ["key"], ["ts", "ok"], Fold(["ts", "ok"], "outcome string", lambda: (0, never), step), pieces).drop("ok")


def expire_idle(attempts: DataFrame, now: Column, grace: int = 30) -> DataFrame:
    """attempt_id, expired_at of strict attempts under way whose deadline and grace have passed by now."""
    over = (F.col("status") == "in_progress") & (F.col("timing_mode") == "strict") & (F.unix_timestamp(now) - F.unix_timestamp("deadline_at") > grace)
    return attempts.where(F.coalesce(over, F.lit(False))).select("attempt_id", F.col("deadline_at").alias("expired_at"))


def expire_idle_stream(rows: DataFrame, grace: int = 30, delay: str = "10 seconds") -> DataFrame:
    """expire_idle on a stream of attempt messages (attempt_id, ts, deadline_at, finished): a timer at deadline and grace fires unless the attempt finishes."""

    def of(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (deadline,) = state.get
            state.remove()
            yield pd.DataFrame({"attempt_id": [key[0]], "expired_at": [pd.Timestamp(deadline, unit="s")]})
            return
        pdf = pd.concat(list(batches))
        if pdf["finished"].any():
            if state.exists:
                state.remove()
        else:
            deadline = pdf["deadline_at"].max().timestamp()
            state.update((deadline,))
            state.setTimeoutTimestamp(max(int((deadline + grace) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"attempt_id": [], "expired_at": []})

    own = rows.withWatermark("ts", delay)
    return own.groupBy("attempt_id").applyInPandasWithState(of, "attempt_id long, expired_at timestamp", "deadline double", "append", GroupStateTimeout.EventTimeTimeout)


def changes(rows: DataFrame, key: str, values: list[str], ts: str = "ts", final: tuple[str, ...] = ("done", "failed")) -> DataFrame:
    """Rows of a job's messages where a value differs from the message before, up to the first final status."""
    own = Window.partitionBy(key).orderBy(ts, *values)
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.col(v).eqNullSafe(F.lag(v).over(own))
    ended = F.coalesce(F.max(F.col(values[0]).isin(*final).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.row_number().over(own) == 1
    return rows.withColumn("emit_", (first | differs) & (ended == 0)).where("emit_").drop("emit_")
