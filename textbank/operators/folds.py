"""Folds over the rows of a key in order, by pieces of bounded size.

Rows are range-partitioned by key and order, so that a key of any size lies over
as many pieces as it needs. Each piece is read once to learn where its last key
stands at its end. Only a piece of one key throughout passes on what it was
given; it is summarised as a map of states, and the driver, which holds one small
summary a piece, composes the maps from piece to piece. A fold whose states are
too many to map is run from the state known so far, and again wherever that
state turns out to be another. Then every piece is replayed from its true state.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType

from textbank.operators.common import cut

#: Arrow types of columns that a fold adds.
TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


@dataclass
class Fold:
    """What is done to a key's rows: step(state, values of columns) gives the next state and the values of the added columns.

    With begin, add and apply the fold can be composed: add(begin(), values)
    gathers a run of rows, close makes a small summary of what was gathered, and
    apply(state, summary) is the state behind the run. Without, pieces are run
    again until their states agree.
    """

    columns: list[str]
    added: str
    start: Callable[[], Any]
    step: Callable[[Any, tuple], tuple[Any, tuple]]
    begin: Callable[[], Any] | None = None
    add: Callable[[Any, tuple], Any] | None = None
    apply: Callable[[Any, Any], Any] | None = None
    close: Callable[[Any], Any] = lambda summary: summary


def pieces(rows: DataFrame, keys: list[str], order: list[str | Column], n: int | None = None) -> DataFrame:
    """rows sorted by keys and order over contiguous partitions, kept in the checkpoint folder. Rows equal in both are in one piece."""
    by = [*keys, *order]
    return cut((rows.repartitionByRange(n, *by) if n else rows.repartitionByRange(*by)).sortWithinPartitions(*by))


def composed(rows: DataFrame, keys: list[str], order: list[str | Column], fold: Fold, n: int | None = None) -> DataFrame:
    """rows with the columns that the fold adds, each key's rows taken in the given order; n pieces, or as many as shuffles have.

    A null in a key is a key like others, and comes first in an order.
    """
    spark = rows.sparkSession
    added = spark.createDataFrame([], fold.added).schema
    sorted_ = pieces(rows, keys, order, n)
    read = sorted_.select(*keys, *fold.columns)
    width = len(keys)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                yield row[:width], row[width:]

    def look(given: dict[int, Any]) -> Callable:
        """Per piece: its first and last key, and either the summary of a piece of one key or the state at the end of its last key."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            no = TaskContext.get().partitionId()
            if given and no not in given:
                return
            first = last = state = summary = None
            for key, values in runs(batches):
                if first is None:
                    first = last = key
                    state, summary = given.get(no, fold.start()), fold.begin() if fold.begin else None
                elif key != last:
                    last, state, summary = key, fold.start(), None
                state, _ = fold.step(state, values)
                if summary is not None:
                    summary = fold.add(summary, values)
            if first is not None:
                summary = None if summary is None else fold.close(summary)
                yield pa.record_batch([pa.array([no], pa.int32()), pa.array([pickle.dumps((first, last, state, summary))], pa.binary())], names=["piece", "seen"])

        return of

    def seen(given: dict[int, Any]) -> dict[int, tuple]:
        found = read.mapInArrow(look(given), "piece int, seen binary").collect()
        return {r["piece"]: pickle.loads(bytes(r["seen"])) for r in found}  # noqa: S301  made above

    every = seen({})
    order_ = sorted(every)
    used: dict[int, Any] = {}
    while True:
        carried, before = {}, None
        for no in order_:
            first, last, state, summary = every[no]
            if before is not None and before[0] == first:
                carried[no] = before[1]
                if first == last and fold.apply:
                    state = fold.apply(before[1], summary)
            before = last, state
        again = {no: s for no, s in carried.items() if every[no][0] == every[no][1] and s != used.get(no, fold.start())}
        if fold.apply or not again:
            break
        every |= seen(again)
        used |= again

    names = sorted_.columns

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId()
        last, state = None, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*keys, *fold.columns)]
            out = []
            for row in zip(*columns, strict=True):
                key, values = row[:width], row[width:]
                if key != last:
                    state = carried[no] if last is None and no in carried else fold.start()
                    last = key
                state, more = fold.step(state, values)
                out.append(more)
            own = [pa.array([x[i] for x in out], TYPES[f.dataType.simpleString()]) for i, f in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*names, *added.names])

    return sorted_.mapInArrow(replay, StructType([*sorted_.schema, *added]))


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "place", n: int | None = None) -> DataFrame:
    """rows with their number from 1 among the rows of their key; counts of pieces are the offsets."""
    count = lambda k, _: k + 1
    return composed(rows, keys, order, Fold([], f"{name} bigint", int, lambda k, _: (k + 1, (k + 1,)), int, count, lambda k, m: k + m), n)


def carried_last(rows: DataFrame, keys: list[str], order: list[str | Column], columns: dict[str, str], n: int | None = None) -> DataFrame:
    """rows with, for each of columns, the last value that is not null so far, under the name it maps to."""
    own = list(columns)
    types = dict(rows.select(*own).dtypes)
    keep = lambda old, new: tuple(a if b is None else b for a, b in zip(old, new, strict=True))
    nothing = lambda: (None,) * len(own)
    return composed(rows, keys, order, Fold(own, ", ".join(f"{columns[c]} {types[c]}" for c in own), nothing, lambda s, v: (keep(s, v),) * 2, nothing, keep, keep), n)


def latch(rule: str, numbers: list[int]) -> Fold:
    """Whether a heading's number is accepted after the last accepted one; numbers are all that occur, so that a piece is mapped from each."""

    def step(state: tuple, values: tuple) -> tuple:
        current, restarted = state
        (num,) = values
        if current is None:
            ok = True
        elif rule == "next":
            ok = num in (current, current + 1) or (num == 1 and not restarted)
        else:
            ok = current <= num <= current + 3
        if ok:
            restarted = restarted or (rule == "next" and current is not None and num == 1 and current != 1)
            current = num
        return (current, restarted), (ok,)

    def add(states: dict, values: tuple) -> dict:
        behind = {s: step(s, values)[0] for s in set(states.values())}
        return {s: behind[x] for s, x in states.items()}

    every = [(None, False), *((x, r) for x in numbers for r in (False, True))]
    return Fold(["num"], "accepted boolean", lambda: (None, False), step, lambda: {s: s for s in every}, add, lambda s, m: m[s])


def packing(size: int) -> Fold:
    """Segment and block of each page: a block is full with `size` characters, and a boundary opens a segment and a block.

    The state is (segment, block, characters in the open block). Where the first
    block of a run of pages ends depends on the characters it starts with, in
    steps; behind it all is fixed, so a run's map is a table of these steps.
    """

    def step(state: tuple, values: tuple) -> tuple:
        segment, block, length = state
        n, boundary = values
        if boundary:
            segment, block, length = segment + 1, 0, 0
        own = segment, block
        length += n
        return (segment, block + 1, 0) if length >= size else (segment, block, length), own

    def add(run: tuple, values: tuple) -> tuple:
        """run: lengths before the first boundary, number of boundaries, state behind the last of them."""
        lengths, boundaries, state = run
        if values[1] or boundaries:
            boundaries += bool(values[1])
            state = step((0, *state[1:]), values)[0]
        else:
            lengths.append(values[0])
        return lengths, boundaries, state

    def close(run: tuple) -> tuple:
        lengths, boundaries, known = run
        n, at = len(lengths), [0, *accumulate(lengths)]
        # From the last page on: full blocks and characters left over if a block begins at the page.
        blocks, left = [0] * (n + 1), [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            end = bisect_left(at, at[i] + size, i + 1)
            blocks[i], left[i] = (1 + blocks[end], left[end]) if end <= n else (0, at[n] - at[i])
        steps: list[tuple[int, int, int]] = []
        for end in range(1, n + 1):
            if not steps or steps[-1][0] < min(at[end], size):
                steps.append((min(at[end], size), 1 + blocks[end], left[end]))
        return boundaries, known, [x for x in steps if x[0] > 0], at[n]

    def apply(state: tuple, run: tuple) -> tuple:
        boundaries, known, steps, total = run
        segment, block, length = state
        if boundaries:
            return (segment + boundaries, *known[1:])
        i = bisect_left(steps, (size - length,))
        return (segment, block, length + total) if i == len(steps) else (segment, block + steps[i][1], steps[i][2])

    return Fold(["length_", "boundary"], "segment bigint, block bigint", lambda: (0, 0, 0), step, lambda: ([], 0, (0, 0, 0)), add, apply, close)
