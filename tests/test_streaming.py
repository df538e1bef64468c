"""Stateful streaming across micro-batches equals the batch operators."""

from __future__ import annotations

import datetime
import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tarmac.operators import sequences as S
from tarmac.sources import fixture
from tarmac.streaming import streams as Z


@pytest.fixture(scope="module")
def day_files():
    """The small events table split into one file per day, written in time order."""
    t = pq.read_table(f"{SF_SMALL}/events.parquet").to_pandas()
    t["day"] = t["ts"].dt.date
    d = tempfile.mkdtemp(prefix="tarmac-stream-days-", dir="/tmp")
    for i, (day, part) in enumerate(sorted(t.groupby("day"), key=lambda kv: kv[0])):
        path = os.path.join(d, f"events-{i:03d}.parquet")
        pq.write_table(pa.Table.from_pandas(part.drop(columns=["day"]).sort_values("ts"), preserve_index=False), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return d


def test_turnaround_state_carries_across_batches(spark, day_files):
    stream = Z.read_schedule_stream(spark, day_files, max_files=1, glob="events-*.parquet")
    got = Z.run_to_table(Z.stream_turnaround(stream), "turnaround_days", ["flight_id"])
    fl = fixture.flights_from_events(spark.read.parquet(day_files))
    exp = S.propagate_turnaround(fl)
    cols = ["flight_id", "delay_minutes", "actual_time"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, exp.select(*cols).collect()))


def test_hourly_windows_across_batches(spark, day_files):
    stream = Z.read_schedule_stream(spark, day_files, max_files=3, glob="events-*.parquet")
    got = Z.run_to_table(Z.stream_hourly_load(stream), "hourly_days", ["window_start"])
    fl = fixture.flights_from_events(spark.read.parquet(day_files))
    exp = fl.groupBy(F.date_trunc("hour", "scheduled_time").cast("timestamp_ntz").alias("window_start")).agg(
        F.count(F.lit(1)).alias("flights"), F.sum("delay_minutes").alias("total_delay"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exp.collect()))


@pytest.fixture(scope="module")
def shuffled_files(day_files):
    """The same files, five of 30 days each at random, so flights of an aircraft arrive out of order."""
    t = pq.read_table(f"{SF_SMALL}/events.parquet").to_pandas().sample(frac=1.0, random_state=3)
    d = tempfile.mkdtemp(prefix="tarmac-stream-shuffled-", dir="/tmp")
    for i in range(5):
        path = os.path.join(d, f"events-{i}.parquet")
        pq.write_table(pa.Table.from_pandas(t.iloc[i::5], preserve_index=False), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return d


def _flights(spark, path):
    return Z.flights_from_events(spark.read.schema(Z.EVENT_SCHEMA).parquet(path)).withColumn("event_time", Z.event_time(F.col("scheduled_time")))


def test_turnaround_out_of_order_equals_batch(spark, shuffled_files):
    stream = Z.read_schedule_stream(spark, shuffled_files, glob="events-*.parquet")
    got = Z.run_to_table(Z.stream_turnaround(stream, watermark="60 days"), "turnaround_shuffled", ["flight_id"])
    exp = S.propagate_turnaround(fixture.flights_from_events(spark.read.parquet(shuffled_files)))
    cols = ["flight_id", "delay_minutes", "actual_time"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, exp.select(*cols).collect()))


def test_sessions_out_of_order_equal_batch(spark, shuffled_files):
    stream = Z.read_schedule_stream(spark, shuffled_files, glob="events-*.parquet")
    got = Z.run_to_table(Z.stream_aircraft_sessions(stream, watermark="60 days"), "sessions_shuffled", ["aircraft_id", "session_start"]).filter("flights > 0")
    times = {}
    for r in _flights(spark, shuffled_files).select("aircraft_id", "scheduled_time").collect():
        times.setdefault(r[0], []).append(r[1])
    exp, gap = [], datetime.timedelta(hours=4)
    for a, ts in times.items():
        ts.sort()
        start, n = ts[0], 0
        for t, after in zip(ts, [*ts[1:], None]):
            n += 1
            if after is None or after > t + gap:
                exp.append((a, start, t + gap, n))
                start, n = after, 0
    assert sorted(map(tuple, got.collect()), key=str) == sorted(exp, key=str)


def test_counted_and_late_are_all_rows(spark, shuffled_files):
    """Five batches at random with a watermark of two days: most rows are late, none is lost."""
    stream = lambda: Z.read_schedule_stream(spark, shuffled_files, glob="events-*.parquet")
    every = _flights(spark, shuffled_files)
    total = every.count()
    hourly = Z.run_to_table(Z.stream_hourly_load(stream(), "2 days"), "hourly_late", ["window_start"])
    late = Z.late_rows(stream(), "hourly_late", "2 days", Z.window_end())
    assert 0 < late.count() < total and hourly.agg(F.sum("flights")).first()[0] + late.count() == total
    assert set(late.columns) == set(every.columns) and late.select("flight_id").distinct().count() == late.count()
    turned = Z.run_to_table(Z.stream_turnaround(stream(), "2 days"), "turnaround_late", ["flight_id"])
    late = Z.late_rows(stream(), "turnaround_late", "2 days")
    assert turned.count() + late.count() == total
    assert turned.join(late, "flight_id").isEmpty()
