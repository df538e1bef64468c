"""Registered streaming queries (Z1-Z6): run to completion (availableNow), compared with their batch twins."""

from __future__ import annotations

from tarmac.plans.catalog_rows import TURNAROUND
from tarmac.plans.oracle import WEATHER, with_flights
from tarmac.plans.registry import register
from tarmac.sources import fixture
from tarmac.streaming import streams as Z


def _stream(spark, d):
    return Z.read_schedule_stream(spark, d)


@register("stream_hourly_load", with_flights("""
SELECT date_trunc('hour', scheduled_time) AS window_start, count(*) AS flights, sum(delay_minutes) AS total_delay
FROM flights GROUP BY 1
"""))
def _z1(spark, d):
    return Z.run_to_table(Z.stream_hourly_load(_stream(spark, d)), "hourly_load", ["window_start"])


@register("stream_runway_sliding", with_flights("""
SELECT base_airport, runway, ws AS window_start, count(*) AS flights FROM (
  SELECT base_airport, runway, time_bucket(INTERVAL 15 MINUTE, scheduled_time) - to_minutes(CAST(15 * k AS BIGINT)) AS ws
  FROM flights, (SELECT range AS k FROM range(4))) GROUP BY 1, 2, 3
"""))
def _z2(spark, d):
    return Z.run_to_table(Z.stream_runway_sliding(_stream(spark, d)), "runway_sliding", ["base_airport", "runway", "window_start"])


@register("stream_aircraft_sessions", with_flights("""
, o AS (SELECT aircraft_id, scheduled_time,
    CASE WHEN lag(scheduled_time) OVER w IS NULL OR scheduled_time > lag(scheduled_time) OVER w + INTERVAL 4 HOUR THEN 1 ELSE 0 END AS brk
  FROM flights WINDOW w AS (PARTITION BY aircraft_id ORDER BY scheduled_time)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY aircraft_id ORDER BY scheduled_time ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT aircraft_id, min(scheduled_time) AS session_start, max(scheduled_time) + INTERVAL 4 HOUR AS session_end, count(*) AS flights
FROM s GROUP BY aircraft_id, sid
"""))
def _z3(spark, d):
    return Z.run_to_table(Z.stream_aircraft_sessions(_stream(spark, d)), "aircraft_sessions", ["aircraft_id", "session_start"]).filter("flights > 0")


@register("stream_turnaround", with_flights(TURNAROUND + """
SELECT flight_id, aircraft_id, scheduled_time, delay AS delay_minutes, act AS actual_time FROM rec
""", recursive=True))
def _z4(spark, d):
    return Z.run_to_table(Z.stream_turnaround(_stream(spark, d)), "turnaround", ["flight_id"])


@register("stream_weather_join", with_flights("""
SELECT f.flight_id, f.weather_hour, coalesce(w.weather_condition, 'Clear') AS weather_condition,
  coalesce(w.capacity_reduction_factor, 1.0) AS capacity_reduction_factor
FROM (SELECT *, date_trunc('hour', scheduled_time) AS weather_hour FROM flights) f LEFT JOIN weather w USING (weather_hour)
""", WEATHER))
def _z5(spark, d):
    wx = fixture.weather(spark, d)
    return Z.run_to_table(Z.stream_weather_join(_stream(spark, d), wx), "weather_join", [], mode="append")


@register("stream_alerts", with_flights("""
SELECT date_trunc('hour', scheduled_time) AS window_start, avg(delay_minutes) AS avg_delay, count(*) AS flights,
  avg(delay_minutes) > 30.0 AS alert FROM flights GROUP BY 1
"""))
def _z6(spark, d):
    return Z.run_to_table(Z.stream_alerts(_stream(spark, d)), "alerts", ["window_start"])
