"""Spans of jobs: the stream in any order within the watermark, the table, and a plain loop agree."""

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq

from sieveworks.streaming import events as stream
from sieveworks.streaming import jobs

SMALL = "/root/testdata/sf0.001"
HOW = ("user_id", "ts", "event_id", "event_type", "value", ("purchase",), 12 * 3600, 6 * 3600)
ZERO = dt.datetime(2024, 1, 1)


def plain(rows, limit=dt.timedelta(hours=12), late=dt.timedelta(hours=6)):
    rows = [r for r in rows if r["ts"] is not None]
    if not rows:
        return []
    newest = max(r["ts"] for r in rows)
    until = newest.replace(microsecond=newest.microsecond // 1000 * 1000) - late
    out = []
    for job in {r["user_id"] for r in rows}:
        span = []
        mine = sorted((r for r in rows if r["user_id"] == job and r["ts"] <= until), key=lambda r: (r["ts"], r["event_id"]))
        told = lambda span, end, how: (job, span[0]["ts"], end, len(span), round(sum(r["value"] or 0 for r in span), 4), span[-1]["event_type"], how)  # noqa: B023, E731
        for r in mine:
            if span and r["ts"] - span[-1]["ts"] > limit:
                out.append(told(span, span[-1]["ts"] + limit, "failed"))
                span = []
            span.append(r)
            if r["event_type"] == "purchase":
                out.append(told(span, r["ts"], "complete"))
                span = []
        if span and span[-1]["ts"] + limit < until:
            out.append(told(span, span[-1]["ts"] + limit, "failed"))
    return sorted(out, key=str)


def collected(df):
    return sorted(((*r[:4], round(r[4], 4), *r[5:]) for r in df.collect()), key=str)


def streamed(spark, folder, files):
    live = jobs.watched(stream.source(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files_a_batch=files), *HOW)
    stream.run_once(live, f"{folder}/out", "append", f"{folder}/log")
    return collected(spark.read.parquet(f"{folder}/out").drop("batch"))


def test_stream_in_any_order_equals_table(spark, tmp_path):
    rows = pq.read_table(f"{SMALL}/events.parquet")
    listed = rows.to_pylist()
    want = plain(listed)
    assert {x[6] for x in want} == {"complete", "failed"} and len(want) > 100
    assert collected(jobs.spans(spark.read.parquet(f"{SMALL}/events.parquet").repartition(7), *HOW)) == want
    rng = random.Random(5)
    for name, each in (("late", 8), ("whole", 50)):  # a delay of under six hours; and all at once in any order
        order = sorted(range(len(listed)), key=lambda i: listed[i]["ts"] + dt.timedelta(hours=rng.random() * (5.9 if name == "late" else 900)))
        (tmp_path / name / "in").mkdir(parents=True)
        for n in range(50):
            pq.write_table(rows.take(order[n * len(order) // 50 : (n + 1) * len(order) // 50]), f"{tmp_path}/{name}/in/{n:02}.parquet")
            stamp = 1_700_000_000 + 60 * n
            os.utime(f"{tmp_path}/{name}/in/{n:02}.parquet", (stamp, stamp))
        assert streamed(spark, f"{tmp_path}/{name}", each) == want, name


def test_odd_events(spark, tmp_path):
    at = lambda h: None if h is None else ZERO + dt.timedelta(hours=h)
    cells = [(1, 1, 0, "view", 1.0), (2, 1, 12, "view", None), (3, 1, 24.5, "purchase", 2.0), (4, 2, 3, "purchase", 1.0), (5, 2, 3, "view", 1.0), (5, 2, 3, "view", 1.0),
             (6, None, 5, None, 1.0), (7, None, None, "purchase", 1.0), (8, 3, 60, "view", 1.0), (9, 4, 53.5, "purchase", 1.0), (10, 4, 54.5, "purchase", 1.0)]
    rows = [dict(event_id=i, user_id=u, ts=at(h), event_type=k, value=v, ended="x", kind="y") for i, u, h, k, v in cells]
    schema = pa.schema([("event_id", pa.int64()), ("user_id", pa.int64()), ("ts", pa.timestamp("us")), ("event_type", pa.string()), ("value", pa.float64()), ("ended", pa.string()), ("kind", pa.string())])
    (tmp_path / "in").mkdir()
    pq.write_table(pa.Table.from_pylist(rows, schema), f"{tmp_path}/in/a.parquet")
    want = plain(rows)
    assert len(want) == 6
    assert collected(jobs.spans(spark.read.parquet(f"{tmp_path}/in"), *HOW)) == want
    assert streamed(spark, str(tmp_path), 1) == want


def test_no_events(spark):
    empty = spark.createDataFrame([], "event_id long, user_id long, ts timestamp, event_type string, value double")
    assert jobs.spans(empty, *HOW).count() == 0
