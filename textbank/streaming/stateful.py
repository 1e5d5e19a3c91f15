"""Streams with a state for each key that ends: values with timers in event time.

Each has a batch twin in operators.py that gives the same rows. A key's state goes
once the watermark has passed the time up to which it can matter; late rows,
behind the watermark, are dropped by Spark. They run on the RocksDB state store,
which these functions set for the session, as Spark has no other for timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from textbank.streaming.operators import LIMITED, OUTCOMES, _limit, _lockout

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fading(StatefulProcessor):
    """A value state for each key that goes at the time step names, unless rows come before.

    step(state, rows sorted by time) gives the rows to put out, the next state and
    the seconds since the epoch from when on it does not matter; a None state goes
    at once. Of a batch a key's rows are held together, to be sorted by time.
    """

    schema, order, out = "", ["ts"], ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def step(self, key: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple | None, float]:
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803  Spark's names
        state = self.state.get() if self.state.exists() else None
        out, state, until = self.step(key, state, pd.concat(list(rows)).sort_values(self.order, kind="stable"))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
            self.handle.registerTimer(int(until * 1000) + 1)
        yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803  Spark's names
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _run(rows: DataFrame, key: str, processor: Fading) -> DataFrame:
    rows.sparkSession.conf.set(_PROVIDER, _ROCKS)
    return rows.groupBy(key).transformWithStateInPandas(processor, processor.out, "append", "eventTime")


def _seconds(times: pd.Series) -> list[float]:
    return [t.timestamp() for t in times]


class Limits(Fading):
    schema, out = "held array<double>", LIMITED

    def __init__(self, most: int, seconds: float):
        self.most, self.seconds = most, seconds

    def step(self, key: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple | None, float]:
        over, held = _limit(_seconds(rows["ts"]), list(state[0]) if state else [], self.most, self.seconds)
        return pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy(), "limited": over}), (held,) if held else None, max(held, default=0) + self.seconds


def limit_hits(rows: DataFrame, most: int, seconds: int = 60, delay: str = "60 seconds") -> DataFrame:
    """The hits (key, ts) of a stream with limited, as the batch form gives them; a key's times are kept until the last of them is `seconds` old."""
    own = rows.withWatermark("ts", delay).select(F.col("key").cast("string").alias("key"), "ts").where("key IS NOT NULL")
    return _run(own, "key", Limits(most, seconds))


class Locks(Fading):
    schema, order, out = "failures int, until double", ["ts", "ok"], OUTCOMES

    def __init__(self, most: int, seconds: float, idle: float):
        self.most, self.seconds, self.idle = most, seconds, idle

    def step(self, key: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple | None, float]:
        times = _seconds(rows["ts"])
        failures, until = state or (0, float("-inf"))
        out, failures, until = _lockout([(t, bool(ok)) for t, ok in zip(times, rows["ok"], strict=True)], failures, until, self.most, self.seconds)
        last = times[-1]
        found = pd.DataFrame({"key": key[0], "ts": rows["ts"].to_numpy(), "outcome": out})
        if failures == 0 and until <= last:
            return found, None, last
        return found, (failures, until), until if failures == 0 else max(until, last + self.idle)


def lockouts(rows: DataFrame, most: int = 10, seconds: int = 300, idle: int = 86_400, delay: str = "60 seconds") -> DataFrame:
    """The attempts (key, ts, ok) of a stream with their outcome, as the batch form gives them.

    A success or the end of a lock ends a key's state; failures without either are
    forgotten after `idle` seconds without an attempt.
    """
    own = rows.withWatermark("ts", delay).select(F.col("key").cast("string").alias("key"), "ts", F.coalesce("ok", F.lit(False)).alias("ok")).where("key IS NOT NULL")
    return _run(own, "key", Locks(most, seconds, idle))


class Changes(Fading):
    schema, order, out = "status string, message string, ended boolean", ["ts", "status", "message"], "job_id long, ts timestamp, status string, message string"

    def __init__(self, final: tuple[str, ...], idle: float):
        self.final, self.idle = final, idle

    def step(self, key: tuple, state: tuple | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, tuple | None, float]:
        last, ended = ((state[0], state[1]), state[2]) if state else (None, False)
        out = []
        for r in rows.itertuples(index=False):
            if not ended and (r.status, r.message) != last:
                out.append((key[0], r.ts, r.status, r.message))
            last, ended = (r.status, r.message), ended or r.status in self.final
        return pd.DataFrame(out, columns=["job_id", "ts", "status", "message"]), (*last, bool(ended)), _seconds(rows["ts"])[-1] + self.idle


def changes(rows: DataFrame, final: tuple[str, ...] = ("done", "failed"), idle: int = 86_400, delay: str = "60 seconds") -> DataFrame:
    """The messages (job_id, ts, status, message) of a stream that differ from the one before, up to the first final status; a job is forgotten after `idle` seconds without a message."""
    own = rows.withWatermark("ts", delay).select("job_id", "ts", "status", "message").where("job_id IS NOT NULL")
    return _run(own, "job_id", Changes(final, idle))
