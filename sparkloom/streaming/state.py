"""Stateful operators over streams of (key, ts, ...) rows, with event time taken from the rows.

Batch counterparts are window expressions in operators/ordered.py. Rows of a key within a micro-batch
are handled in time order; rows later than the watermark are dropped by the engine before they come here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _keyed(stream: DataFrame, key: str, out: str, state: str, step: Callable, start: tuple, keep_s: int) -> DataFrame:
    """Runs step(state, row) -> (state, output row) over each key's rows in time order; idle keys are forgotten."""

    def run(name: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now, rows, last = held.get if held.exists else start, [], None
        for batch in batches:
            for row in batch.sort_values("ts").to_dict("records"):
                now, told = step(now, row)
                rows.append((name[0], *told))
                last = row["ts"] if last is None else max(last, row["ts"])
        held.update(now)
        after = int(last.timestamp() * 1000) + keep_s * 1000
        held.setTimeoutTimestamp(max(after, held.getCurrentWatermarkMs() + 1000))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in out.split(", ")])

    return stream.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def sliding_limit(stream: DataFrame, key: str, most: int, span_s: int = 60, watermark: str = "10 minutes") -> DataFrame:
    """(key, ts, admitted, delay_s): a row is admitted if fewer than `most` were admitted in the span before it, else told how long to wait."""

    def step(state: tuple, row: dict) -> tuple:
        at = row["ts"].timestamp()
        log = [t for t in state[0] if t > at - span_s]
        if len(log) < most:
            return ((log + [at],), (row["ts"], True, 0.0))
        return ((log,), (row["ts"], False, log[0] + span_s - at))

    return _keyed(stream.withWatermark("ts", watermark), key, f"{key} string, ts timestamp, admitted boolean, delay_s double", "log array<double>", step, ([],), span_s)


def anchored_windows(stream: DataFrame, key: str, most: int, span_s: int, watermark: str = "10 minutes") -> DataFrame:
    """(key, ts, n, over): number of the row in a window that starts at the key's first row after the window before, and whether it exceeds a limit."""

    def step(state: tuple, row: dict) -> tuple:
        start, n = state
        at = row["ts"].timestamp()
        start, n = (at, 1) if start is None or at >= start + span_s else (start, n + 1)
        return ((start, n), (row["ts"], n, n > most))

    return _keyed(stream.withWatermark("ts", watermark), key, f"{key} string, ts timestamp, n long, over boolean", "start double, n long", step, (None, 0), span_s)


def back_off(stream: DataFrame, key: str, base_s: float, cap_s: float, watermark: str = "10 minutes") -> DataFrame:
    """(key, ts, failures, wait_s): failures in a row and the doubling wait after each row with its `success`."""

    def step(state: tuple, row: dict) -> tuple:
        n = 0 if row["success"] else state[0] + 1
        return ((n,), (row["ts"], n, min(cap_s, base_s * 2.0 ** (n - 1)) if n else 0.0))

    return _keyed(stream.withWatermark("ts", watermark), key, f"{key} string, ts timestamp, failures long, wait_s double", "n long", step, (0,), int(cap_s))


def consensus(stream: DataFrame, key: str, needed: int = 3, span_s: int = 3600, watermark: str = "10 minutes") -> DataFrame:
    """(key, ts, adjustment): +1 or -1 once each side has so many signals (`positive`) within the span, positives first; applied once per side."""

    def step(state: tuple, row: dict) -> tuple:
        at = row["ts"].timestamp()
        ups, downs = ([t for t in side if t > at - span_s] for side in state[:2])
        (ups if row["positive"] else downs).append(at)
        up, down, told = state[2], state[3], 0
        if len(ups) >= needed and not up:
            up, told = True, 1
        elif len(downs) >= needed and not down:
            down, told = True, -1
        return ((ups, downs, up, down), (row["ts"], told))

    return _keyed(stream.withWatermark("ts", watermark), key, f"{key} string, ts timestamp, adjustment int", "ups array<double>, downs array<double>, up boolean, down boolean", step, ([], [], False, False), span_s)


def daily_counters(stream: DataFrame, key: str, watermark: str = "1 day") -> DataFrame:
    """Requests and units by key and day."""
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day").alias("day"), key).agg(F.count("*").alias("requests"), F.sum("cost_units").alias("units"))


def fan_out(stream: DataFrame, endpoints: DataFrame, key: str) -> DataFrame:
    """Every event with every enabled endpoint of its key that takes its type and severity."""
    takes = F.array_contains("event_types", F.col("type")) | (F.size("event_types") == 0)
    return stream.join(endpoints.where("enabled"), key).where(takes & (F.col("severity") >= F.col("least_severity")))


def latest_sink(stream: DataFrame, path: str, every: str = "5 seconds"):
    """Writes each micro-batch over the last one; what comes between two triggers is dropped."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").json(path)

    return stream.writeStream.foreachBatch(put).trigger(processingTime=every).outputMode("append")
