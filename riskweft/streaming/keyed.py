"""Sessions, alerts with memory, and joins of two streams; each runs on tables as well."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskweft.operators.rolling import neighbours
from riskweft.roles import require_columns

RAISED, CLEARED = "raised", "cleared"
JOINS = ("inner", "left_outer")


def _watched(rows: DataFrame, time: str, late: str) -> DataFrame:
    if not rows.isStreaming:
        return rows
    # A watermark needs a timestamp with a zone; the session's zone should be UTC.
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def sessions(rows: DataFrame, by: Sequence[str], time: str, gap: str, late: str = "1 hour", value: str | None = None) -> DataFrame:
    """One row per key and session: rows of a key that follow each other within ``gap``.

    Start, end (of the last row, and ``gap`` later), count, and total and maximum of ``value``.  Rows
    without a time are in no session.  On a stream a session is sent once no row can prolong it;
    rows later than ``late`` are dropped.
    """
    require_columns(rows, [*by, time, *([value] if value else [])])
    rows = _watched(rows, time, late).filter(F.col(time).isNotNull())
    made = [F.count(F.lit(1)).alias("n"), F.max(time).cast("timestamp_ntz").alias("last_row")]
    if value:
        made += [F.sum(value).alias("total"), F.max(value).alias("highest")]
    found = rows.groupBy(F.session_window(time, gap), *by).agg(*made)
    return found.select(
        *by, F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "last_row",
        F.col("session_window.end").cast("timestamp_ntz").alias("session_end"), "n", *(["total", "highest"] if value else []),
    )


def _mark(value: Column, raise_at: float, clear_at: float) -> Column:
    return F.when(value >= raise_at, 1).when(value <= clear_at, 0)


def alert_changes(
    rows: DataFrame, by: str, time: str, value: str, raise_at: float, clear_at: float, late: str = "1 hour"
) -> DataFrame:
    """(key, time, change, value): when each key's alert was raised and when it was cleared.

    An alert is raised by a value of ``raise_at`` or more and stays, whatever lies between, until a
    value of ``clear_at`` or less clears it.  Rows of one time are taken by rising value; rows without
    key, time or value are left out.

    A table is answered by comparing each row that can change a state with the one before it, in
    sorted blocks.  On a stream a key's rows wait in its state until the watermark has passed them, so
    that they are taken in the order of their times however they arrive; an event-time timer wakes a
    key whose rows have become final.  Rows later than ``late`` are dropped.
    """
    if clear_at >= raise_at:
        raise ValueError("clear_at must lie below raise_at")
    require_columns(rows, [by, time, value])
    rows = rows.select(F.col(by).alias("key"), F.col(time).alias("time"), F.col(value).cast("double").alias("value"))
    rows = rows.filter("key IS NOT NULL AND time IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
    mark = _mark(F.col("value"), raise_at, clear_at)
    if not rows.isStreaming:
        marked = rows.withColumn("mark", mark).filter("mark IS NOT NULL")
        marked = neighbours(marked, {"before": "mark"}, ["time", "value"], by=["key"])
        changed = marked.filter(F.col("mark") != F.coalesce("before", F.lit(0)))
        change = F.when(F.col("mark") == 1, RAISED).otherwise(CLEARED)
        return changed.select(F.col("key").alias(by), F.col("time").cast("timestamp_ntz").alias(time), change.alias("change"), "value")
    kind = rows.schema["key"].dataType.simpleString()
    watched = _watched(rows, "time", late)
    found = watched.groupBy("key").applyInPandasWithState(
        _follow(raise_at, clear_at), f"key {kind}, time timestamp, change string, value double",
        "raised boolean, micros array<bigint>, values array<double>", "append", GroupStateTimeout.EventTimeTimeout,
    )
    return found.select(F.col("key").alias(by), F.col("time").cast("timestamp_ntz").alias(time), "change", "value")


def _follow(raise_at: float, clear_at: float):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        raised, waiting = False, []
        if state.exists:
            held = state.get
            raised, waiting = bool(held[0]), list(zip(held[1] or [], held[2] or []))
        passed = state.getCurrentWatermarkMs() * 1000
        for rows in batches:
            micros = rows["time"].astype("datetime64[us]").astype("int64")
            waiting += [(int(t), float(v)) for t, v in zip(micros, rows["value"]) if t > passed]
        waiting.sort()
        done = [x for x in waiting if x[0] <= passed]
        waiting = waiting[len(done) :]
        out = []
        for t, v in done:
            if v >= raise_at and not raised:
                out.append((key[0], t, RAISED, v))
                raised = True
            elif v <= clear_at and raised:
                out.append((key[0], t, CLEARED, v))
                raised = False
        state.update((raised, [t for t, _ in waiting], [v for _, v in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000 + 1, passed // 1000 + 1))
        table = pd.DataFrame(out, columns=["key", "time", "change", "value"])
        table["time"] = pd.to_datetime(table["time"], unit="us")
        yield table

    return run


def join_within(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, within: str, late: str = "1 hour",
    how: str = "inner", prefix: str = "next_",
) -> DataFrame:
    """Rows of ``left`` with the rows of ``right`` of the same key that follow within ``within``, both ends included.

    Columns of ``right`` get ``prefix``.  With ``left_outer`` a row without a follower is kept; on a stream
    it is sent when the watermarks of both sides show that none can come any more, so every order of
    arrival within ``late`` gives the rows that the tables give.  Both sides' states are dropped as the
    watermarks pass.  A null key or time meets nothing.
    """
    if how not in JOINS:
        raise ValueError(f"how must be one of {JOINS}")
    require_columns(left, [*by, left_time])
    require_columns(right, [*by, right_time])
    a = _watched(left, left_time, late)
    b = _watched(right, right_time, late)
    b = b.select(*[F.col(c).alias(f"{prefix}{c}") for c in right.columns])
    after = F.col(f"{prefix}{right_time}")
    meets = (after >= F.col(left_time)) & (after <= F.col(left_time) + F.expr(f"INTERVAL {within}"))
    for c in by:
        meets = meets & (F.col(c) == F.col(f"{prefix}{c}"))
    return a.join(b, meets, how)
