"""Keyed state over ordered rows: one step function for tables and for streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Kernel:
    """What one key's rows do to its state.

    ``step(state, row)`` gets the last state (None at first) and the values of
    ``inputs``, and returns the next state and the values of ``outputs``.
    ``inputs`` and ``state`` are column lists in DDL; every state value may be null.
    ``pack`` makes a state of Python's values into those columns, ``unpack`` the way
    back; a table's replay keeps it as it is.

    A kernel with timers names the input that is its ``clock`` in ms: ``due(state)``
    is when the next timer rings, or null, and ``ring(state)`` the state after it and
    what it says, which is a row without an order.  Timers ring before a row of
    their time.
    """

    inputs: str
    state: str
    outputs: str
    step: Callable[[tuple | None, tuple], tuple[tuple, tuple]]
    pack: Callable[[tuple | None], tuple] = lambda state: state
    unpack: Callable[[tuple], tuple | None] = lambda state: state
    clock: str | None = None
    due: Callable[[tuple | None], int | None] = lambda state: None
    ring: Callable[[tuple], tuple[tuple, tuple]] = lambda state: (state, ())

    def rung(self, state: tuple | None, until: int | None) -> tuple[tuple | None, list[tuple]]:
        """The state after all timers up to a time, and what they say."""
        out = []
        while self.clock and until is not None and (at := self.due(state)) is not None and at <= until:
            state, told = self.ring(state)
            out.append(told)
        return state, out


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(",")]


def _plain(values) -> tuple:
    """Values as Python has them, missing ones as None, arrays as lists."""
    return tuple(v.tolist() if isinstance(v, np.ndarray) else None if v is None or v is pd.NA or v != v else v for v in values)


def _ddl(key: str, order: str, kernel: Kernel, rows: DataFrame) -> str:
    types = dict(rows.dtypes)
    return f"{key} {types[key]}, {order} {types[order]}, {kernel.outputs}"


def replay(rows: DataFrame, key: str, order: str, kernel: Kernel, late_ms: int = 0, spread: bool = False) -> DataFrame:
    """key, order and the kernel's outputs for every row, and for every timer up to ``late_ms`` before the table's last time.

    Spark sorts each key's rows and they pass through a task as a stream, so a
    task holds one state, however many rows a key has.  ``order`` is unique in a
    key; rows without a key go.  ``spread`` keeps all of spark.sql.shuffle.partitions
    as tasks, for kernels whose cost a row's bytes do not tell.
    """
    read, made = _names(kernel.inputs), _names(kernel.outputs)
    result = [key, order, *made]
    clock = read.index(kernel.clock) if kernel.clock else 0
    last_ms = rows.agg(F.max(kernel.clock)).first()[0] if kernel.clock else None
    until = None if last_ms is None else last_ms - late_ms

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for frame in frames:
            out = []
            for k, o, *values in frame.itertuples(index=False, name=None):
                if k != last:
                    out += [(last, None, *told) for told in kernel.rung(state, until)[1]]
                    last, state = k, None
                values = _plain(values)
                if kernel.clock:
                    state, rung = kernel.rung(state, values[clock])
                    out += [(k, None, *told) for told in rung]
                state, told = kernel.step(state, values)
                out.append((k, o, *told))
            yield _frame(out, result, order)
        out = [(last, None, *told) for told in kernel.rung(state, until)[1]]
        if out:
            yield _frame(out, result, order)

    tasks = [int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if spread else []
    sorted_rows = rows.select(key, order, *read).where(f"{key} is not null").repartition(*tasks, key).sortWithinPartitions(key, order)
    return sorted_rows.mapInPandas(run, _ddl(key, order, kernel, rows))


def _frame(out: list[tuple], columns: list[str], order: str) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=columns)
    return frame.astype({order: "object"}) if frame[order].isna().any() else frame


def stream(rows: DataFrame, key: str, order: str, kernel: Kernel, late_ms: int = 0) -> DataFrame:
    """The same over a streaming table; a micro-batch's rows of a key are sorted, later batches follow on its state.

    A row that comes after later ones in an earlier batch is stepped when it comes,
    as the devices' own order of arrival is.  State has the kernel's few values.
    Timers ring when the watermark, ``late_ms`` behind the last time, passes them.
    """
    read, made, timed = _names(kernel.inputs), _names(kernel.outputs), kernel.clock is not None
    result = [key, order, *made]
    clock = read.index(kernel.clock) if timed else 0

    def run(group: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = kernel.unpack(_plain(held.get)) if held.exists else None
        out = []
        if not held.hasTimedOut:
            for o, *values in pd.concat(frames)[[order, *read]].sort_values(order).itertuples(index=False, name=None):
                values = _plain(values)
                if timed:
                    state, rung = kernel.rung(state, values[clock])
                    out += [(group[0], None, *told) for told in rung]
                state, told = kernel.step(state, values)
                out.append((group[0], o, *told))
        if timed:
            passed = held.getCurrentWatermarkMs()
            state, rung = kernel.rung(state, passed)
            out += [(group[0], None, *told) for told in rung]
        held.update(kernel.pack(state))
        if timed and (at := kernel.due(state)) is not None:
            held.setTimeoutTimestamp(max(at, passed + 1))
        yield _frame(out, result, order)

    wanted = rows.select(key, order, *read).where(f"{key} is not null")
    if timed:
        wanted = wanted.withColumn("_at", F.timestamp_millis(kernel.clock)).withWatermark("_at", f"{late_ms} milliseconds")
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return wanted.groupBy(key).applyInPandasWithState(run, _ddl(key, order, kernel, rows), kernel.state, "append", timeout)
