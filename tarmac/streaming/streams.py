"""Structured Streaming variants (Z1-Z6). Each has a batch twin, which is its oracle.

Sources are ``readStream`` over the events parquet (schema given, no inference); the flight view
is a stateless projection, so it applies to a stream unchanged. Event time is the scheduled
time; watermarks need a TIMESTAMP column, so the NTZ time is cast for windowing only.

Sinks write under the shared checkpoint folder (``spark.checkpoint.dir``) with one checkpoint
location per run, so a restarted query resumes exactly once. Aggregations use ``update`` mode
through ``foreachBatch``: every micro-batch appends the windows it changed, tagged with the
batch id, and the final table keeps the latest version of each window. That includes the last
open windows, which append mode would withhold until the watermark passes them. Rows that come after
their window or place has closed are not lost: ``late_rows`` returns them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tarmac.session import checkpoint_dir
from tarmac.sources.fixture import flights_from_events

EPOCH = "1970-01-01 00:00:00"
EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_schedule_stream(spark: SparkSession, sf_dir: str, max_files: int = 1, glob: str = "events*.parquet") -> DataFrame:
    """The flight view over a stream of event files (``max_files`` new files per micro-batch)."""
    ev = (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files)
          .option("pathGlobFilter", glob).parquet(sf_dir))
    return flights_from_events(ev).withColumn("event_time", event_time(F.col("scheduled_time")))


def event_time(ntz):
    """Wall-clock NTZ time as an instant read in UTC, whatever the session time zone."""
    return F.timestamp_seconds(F.timestamp_diff("SECOND", F.lit(EPOCH).cast("timestamp_ntz"), ntz))


def wall_clock(ts):
    """Inverse of ``event_time`` (for window bounds)."""
    return F.timestamp_add("SECOND", F.unix_seconds(ts), F.lit(EPOCH).cast("timestamp_ntz"))


def _run_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that timers and list state need, for queries started inside; the setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_to_table(stream: DataFrame, name: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Run ``stream`` over everything available, then return the latest version of each key."""
    spark = stream.sparkSession
    base = _run_dir(spark, name)
    out = f"{base}/data"

    def sink(batch: DataFrame, batch_id: int) -> None:
        # one folder a batch, overwritten: a retried batch replaces its rows
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    with _keyed_state(spark):
        q = (stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint")
             .trigger(availableNow=True).start())
    q.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # no batch ran
        return spark.createDataFrame([], stream.schema)
    res = spark.read.parquet(out)
    if not keys:
        return res.drop("batch_id")
    latest = res.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return res.join(latest, [*keys, "batch_id"]).drop("batch_id")


# Z1
def stream_hourly_load(fl_stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    w = F.window("event_time", "1 hour")
    return (fl_stream.withWatermark("event_time", watermark)
            .groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("flights"), F.sum("delay_minutes").alias("total_delay"))
            .select(wall_clock(F.col("w.start")).alias("window_start"), "flights", "total_delay"))


# Z2
def stream_runway_sliding(fl_stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    w = F.window("event_time", "1 hour", "15 minutes")
    return (fl_stream.withWatermark("event_time", watermark)
            .groupBy("base_airport", "runway", w.alias("w")).agg(F.count(F.lit(1)).alias("flights"))
            .select("base_airport", "runway", wall_clock(F.col("w.start")).alias("window_start"), "flights"))


# Keyed state with event-time timers
MICROS = 1_000_000
SESSION_OUT = "aircraft_id string, session_start_us long, session_end_us long, flights long"
TURN_OUT = "flight_id string, aircraft_id string, scheduled_us long, delay_minutes double, actual_us long"


def micros(ntz):
    """Wall-clock NTZ time as microseconds, the form in which state holds times."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), ntz)


def from_micros(us):
    return F.timestamp_add("MICROSECOND", us, F.lit(EPOCH).cast("timestamp_ntz"))


def _timer_at(handle, us: int | None) -> None:
    """One timer, at the first millisecond at which ``us`` has passed."""
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    if us is not None:
        handle.registerTimer(-(-us // 1000))


class _Sessions(StatefulProcessor):
    """Open sessions of an aircraft as (start, end, flights); a session that the watermark has passed can't
    grow and leaves the state. Changed sessions are sent on, a start that merged into another with 0 flights."""

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle):
        self.handle = handle
        self.open = handle.getListState("open", "start_us long, end_us long, flights long")

    def handleInputRows(self, key, rows, timerValues):
        held = [tuple(map(int, r)) for r in self.open.get()] if self.open.exists() else []
        before = set(held)
        new = [(int(t), int(t) + self.gap, 1) for pdf in rows for t in pdf["scheduled_us"]]
        merged: list[tuple[int, int, int]] = []
        for start, end, n in sorted(held + new):
            if merged and start <= merged[-1][1]:
                s, e, m = merged[-1]
                merged[-1] = (s, max(e, end), m + n)
            else:
                merged.append((start, end, n))
        self._keep(merged)
        starts = {s for s, _, _ in merged}
        out = [x for x in merged if x not in before] + [(s, e, 0) for s, e, _ in held if s not in starts]
        yield pd.DataFrame({"aircraft_id": [key[0]] * len(out), "session_start_us": [x[0] for x in out], "session_end_us": [x[1] for x in out], "flights": [x[2] for x in out]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self._keep([x for x in (tuple(map(int, r)) for r in self.open.get()) if x[1] > passed] if self.open.exists() else [])
        yield pd.DataFrame({"aircraft_id": pd.Series([], dtype=str), "session_start_us": pd.Series([], dtype="int64"), "session_end_us": pd.Series([], dtype="int64"), "flights": pd.Series([], dtype="int64")})

    def _keep(self, sessions):
        if sessions:
            self.open.put(sessions)
        elif self.open.exists():
            self.open.clear()
        _timer_at(self.handle, min((x[1] for x in sessions), default=None))

    def close(self):
        pass


def _seconds(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


# Z3
def stream_aircraft_sessions(fl_stream: DataFrame, gap: str = "4 hours", watermark: str = "4 hours") -> DataFrame:
    """Sessions of an aircraft's flights no more than ``gap`` apart, the latest version of each by start.

    State holds open sessions only. ``flights`` is 0 where an earlier flight moved a session's start:
    such rows replace the old version and are no sessions.
    """
    rows = fl_stream.withWatermark("event_time", watermark).select("aircraft_id", "event_time", micros(F.col("scheduled_time")).alias("scheduled_us"))
    out = rows.groupBy("aircraft_id").transformWithStateInPandas(_Sessions(_seconds(gap) * MICROS), SESSION_OUT, "update", "EventTime")
    return out.select("aircraft_id", from_micros(F.col("session_start_us")).alias("session_start"), from_micros(F.col("session_end_us")).alias("session_end"), "flights")


class _Turnaround(StatefulProcessor):
    """Flights of an aircraft in scheduled order, whatever order they arrive in.

    Flights that the watermark has not passed stay in an ordered buffer; whenever a flight joins them, it and
    those after it are computed anew from the last final one and sent on. The watermark makes flights final:
    the buffer keeps only later ones, and the state the actual time of the last final flight.
    """

    def __init__(self, turn_minutes: int):
        self.turn = turn_minutes * 60 * MICROS

    def init(self, handle):
        self.handle = handle
        self.last = handle.getValueState("last", "actual_us long")
        self.waiting = handle.getListState("waiting", "scheduled_us long, flight_id string, delay double, actual_us long")

    def _fold(self, flights, last):
        for s, i, d, a in flights:
            if last is not None and last + self.turn > s:
                d, a = d + (last + self.turn - s) / 60 / MICROS, last + self.turn
            last = a
            yield i, s, d, a

    def _held(self):
        return [(int(s), i, float(d), int(a)) for s, i, d, a in self.waiting.get()] if self.waiting.exists() else []

    def _last(self):
        return int(self.last.get()[0]) if self.last.exists() else None

    def _frame(self, key, out):
        return pd.DataFrame({"flight_id": pd.Series([x[0] for x in out], dtype=object), "aircraft_id": pd.Series([key[0]] * len(out), dtype=object), "scheduled_us": pd.Series([x[1] for x in out], dtype="int64"),
                             "delay_minutes": pd.Series([x[2] for x in out], dtype="float64"), "actual_us": pd.Series([x[3] for x in out], dtype="int64")})

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(s), i, float(d), int(a)) for pdf in rows for s, i, d, a in zip(pdf["scheduled_us"], pdf["flight_id"], pdf["delay_minutes"], pdf["actual_us"])]
        flights = sorted(self._held() + new)
        self._keep(flights)
        first = min(new)[:2]
        yield self._frame(key, [x for x in self._fold(flights, self._last()) if (x[1], x[0]) >= first])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        flights = sorted(self._held())
        final = [x for x in flights if x[0] <= passed]
        if final:
            *_, (_, _, _, actual) = self._fold(final, self._last())
            self.last.update((actual,))
        self._keep(flights[len(final):])
        yield self._frame(key, [])

    def _keep(self, flights):
        if flights:
            self.waiting.put(flights)
        elif self.waiting.exists():
            self.waiting.clear()
        _timer_at(self.handle, flights[0][0] if flights else None)

    def close(self):
        pass


# Z4
def stream_turnaround(fl_stream: DataFrame, watermark: str = "1 day", turn_minutes: int = 45) -> DataFrame:
    """W3 per aircraft as a stateful operator; the latest version of each flight is its result.

    Flights may arrive out of order by up to ``watermark``; later ones are for ``late_rows``.
    """
    rows = fl_stream.withWatermark("event_time", watermark).select("flight_id", "aircraft_id", "event_time", "delay_minutes",
                                                                   micros(F.col("scheduled_time")).alias("scheduled_us"), micros(F.col("actual_time")).alias("actual_us"))
    out = rows.groupBy("aircraft_id").transformWithStateInPandas(_Turnaround(turn_minutes), TURN_OUT, "update", "EventTime")
    return out.select("flight_id", "aircraft_id", from_micros(F.col("scheduled_us")).alias("scheduled_time"), "delay_minutes", from_micros(F.col("actual_us")).alias("actual_time"))


def late_rows(fl_stream: DataFrame, name: str, watermark: str, closes=None) -> DataFrame:
    """The rows of the stream that a stateful operator with this watermark drops, with all their columns.

    ``closes`` is the time at which a row's place closes: its event time (default) or its window's end. A
    batch drops what closed by the watermark that the batch before it ran with, so the bound is the
    largest event time two batches back, less the delay. Each batch notes its largest event time in a
    folder of its own; a retried batch finds the same notes and replaces its rows.
    """
    spark = fl_stream.sparkSession
    base = _run_dir(spark, f"late-{name}")
    marked = fl_stream.withColumn("_closes", F.col("event_time") if closes is None else closes)
    schema, delay = marked.schema, _seconds(watermark)
    notes = "largest timestamp, batch long"

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.agg(F.max("event_time").alias("largest"), F.lit(batch_id).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{base}/notes/{batch_id}")
        late = batch.limit(0)
        if batch_id >= 2:
            seen = spark.read.schema(notes).parquet(*[f"{base}/notes/{i}" for i in range(batch_id - 1)])
            bound = seen.agg((F.max("largest") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(delay))).alias("_bound"))
            late = batch.join(F.broadcast(bound), F.col("_closes") <= F.col("_bound")).drop("_bound")
        late.write.mode("overwrite").parquet(f"{base}/data/batch_id={batch_id}")

    q = marked.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/data")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).drop("_closes")
    return spark.read.schema(schema).parquet(f"{base}/data/*").drop("_closes")


def window_end(hours: int = 1):
    """End of the hourly window of ``event_time``: when Z1 and Z6 close a row's window."""
    return F.window("event_time", f"{hours} hour")["end"]


# Z5
def stream_weather_join(fl_stream: DataFrame, weather: DataFrame) -> DataFrame:
    from tarmac.operators.joins import weather_join

    return weather_join(fl_stream, weather).select("flight_id", "weather_hour", "weather_condition", "capacity_reduction_factor")


# Z6
def stream_alerts(fl_stream: DataFrame, threshold_delay: float = 30.0) -> DataFrame:
    """Hourly windows whose mean delay exceeds the threshold (rule of A35, per window)."""
    w = F.window("event_time", "1 hour")
    return (fl_stream.withWatermark("event_time", "1 hour").groupBy(w.alias("w"))
            .agg(F.avg("delay_minutes").alias("avg_delay"), F.count(F.lit(1)).alias("flights"))
            .select(wall_clock(F.col("w.start")).alias("window_start"), "avg_delay", "flights",
                    (F.col("avg_delay") > threshold_delay).alias("alert")))
