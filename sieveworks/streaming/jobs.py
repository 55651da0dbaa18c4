"""Jobs under watch: spans of work from a log of events, with a timer that fails a job which falls silent.

A job's events count in the order of (time, id). An event opens a span if none is open. A span ends as ``complete`` at a final
event, or as ``failed`` once more than ``limit`` passes without an event; its end is then the last event's time plus ``limit``.
Only events up to the watermark (the newest time seen, less ``late``) are settled: later ones wait, as one before them may still
come. So the order in which events arrive within the watermark changes nothing, and the stream's spans are those of the table.

A span is told once, when it ends; one that is still open is not told. Between calls a job's state is its open span and the
events that wait; a job without either has no state. Watermarks are whole milliseconds.

Cases: rows without a time are left out; a null job is a job; null values add nothing; equal rows are events of their own; equal
times go by id; events later than the watermark are left out by the stream. A job's spans are a sequence, so its waiting events
are one state: those of ``late``, not of its history. The table form sorts a job's events in one task, and spills.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "started long, last long, n long, total double, kind string, at array<long>, ids array<long>, kinds array<string>, amounts array<double>"
_OUT = "started long, ended long, n_events long, total double, last_kind string, outcome string"


def _shaped(events: DataFrame, key: str, time: str, event_id: str, kind: str, value: str) -> DataFrame:
    c = F.col
    return events.where(c(time).isNotNull()).select(
        c(key), c(time).cast("timestamp").alias("_time"), F.unix_micros(c(time).cast("timestamp")).alias("at"), c(event_id).cast("long").alias("id"),
        c(kind).cast("string").alias("kind"), F.coalesce(c(value).cast("double"), F.lit(0.0)).alias("amount"),
    )


def _timed(spans: DataFrame, kind: str) -> DataFrame:
    put = lambda c: F.timestamp_micros(c).cast(kind)
    return spans.withColumns({"started": put("started"), "ended": put("ended")})


def _step(open_: tuple | None, waiting: list[tuple], settled: int, final: tuple[str, ...], limit: int) -> tuple[tuple | None, list[tuple], list[tuple]]:
    """(open span, events that still wait, spans that ended) after all events up to ``settled``; a span is (started, last, n, total, kind)."""
    waiting.sort(key=lambda e: (e[0], e[1] is not None, e[1] or 0))
    ended, done = [], 0
    for at, _, kind, amount in waiting:
        if at > settled:
            break
        done += 1
        if open_ and at - open_[1] > limit:
            ended.append((open_[0], open_[1] + limit, *open_[2:], "failed"))
            open_ = None
        open_ = (open_[0], at, open_[2] + 1, open_[3] + amount, kind) if open_ else (at, at, 1, amount, kind)
        if kind in final:
            ended.append((*open_, "complete"))
            open_ = None
    if open_ and open_[1] + limit < settled:
        ended.append((open_[0], open_[1] + limit, *open_[2:], "failed"))
        open_ = None
    return open_, waiting[done:], ended


def watched(events: DataFrame, key: str, time: str, event_id: str, kind: str, value: str, final: tuple[str, ...], limit_s: int, late_s: int) -> DataFrame:
    """Ended spans of a stream of events: ``key, started, ended, n_events, total, last_kind, outcome``, for append mode."""
    limit = limit_s * 1_000_000

    def run(job: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_, waiting = None, []
        if state.exists:
            *held, at, ids, kinds, amounts = state.get
            open_ = tuple(held) if held[2] else None
            waiting = list(zip(at, ids, kinds, amounts, strict=True))
        for frame in () if state.hasTimedOut else frames:
            ids = [None if pd.isna(x) else int(x) for x in frame["id"]]
            waiting += zip(frame["at"].tolist(), ids, frame["kind"].tolist(), frame["amount"].tolist(), strict=True)
        watermark = state.getCurrentWatermarkMs()
        open_, waiting, ended = _step(open_, waiting, watermark * 1000, final, limit)
        if open_ or waiting:
            state.update((*(open_ or (0, 0, 0, 0.0, "")), *([e[i] for e in waiting] for i in range(4))))
            # The timer rings when the watermark has passed it: at the next event that waits, or when the silence is too long.
            due = min([-(-e[0] // 1000) for e in waiting[:1]] + [(s[1] + limit) // 1000 + 1 for s in [open_] if s])
            state.setTimeoutTimestamp(max(due - 1, watermark + 1))
        elif state.exists:
            state.remove()
        if ended:
            yield pd.DataFrame([(*job, *x) for x in ended], columns=[key, "started", "ended", "n_events", "total", "last_kind", "outcome"])

    rows = _shaped(events, key, time, event_id, kind, value).withWatermark("_time", f"{late_s} seconds")
    schema = f"`{key}` {events.schema[key].dataType.simpleString()}, {_OUT}"
    return _timed(rows.groupBy(key).applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout), events.schema[time].dataType.simpleString())


def spans(events: DataFrame, key: str, time: str, event_id: str, kind: str, value: str, final: tuple[str, ...], limit_s: int, late_s: int) -> DataFrame:
    """The same spans of a table, as of its newest time less ``late_s``."""
    c = F.col
    rows = _shaped(events, key, time, event_id, kind, value)
    newest = rows.agg(F.max("at")).first()[0]
    settled, limit = ((newest or 0) // 1000 - late_s * 1000) * 1000, limit_s * 1_000_000
    order = Window.partitionBy(key).orderBy("at", "id")
    before, last = F.lag("at").over(order), F.lag("kind").over(order)
    ends = lambda k: F.coalesce(k.isin(*final), F.lit(False))
    rows = rows.where(c("at") <= settled).withColumn("_first", (before.isNull() | ends(last) | (c("at") - before > limit)).cast("int"))
    rows = rows.withColumn("_span", F.sum("_first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    newest_kind = F.max(F.struct("at", F.struct("id"), "kind"))
    out = rows.groupBy(key, "_span").agg(F.min("at").alias("started"), newest_kind.alias("_l"), F.count("*").alias("n_events"), F.sum("amount").alias("total"))
    out = out.select(key, "started", c("_l.at").alias("ended"), "n_events", "total", c("_l.kind").alias("last_kind"))
    out = out.withColumn("outcome", F.when(ends(c("last_kind")), "complete").otherwise("failed"))
    out = out.withColumn("ended", c("ended") + F.when(c("outcome") == "failed", limit).otherwise(0))
    return _timed(out.where((c("outcome") == "complete") | (c("ended") < settled)), events.schema[time].dataType.simpleString())
