"""Registered feature / window / join / sequence queries with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import features as FE
from tarmac.operators import joins as J
from tarmac.operators import sequences as S
from tarmac.plans.oracle import WEATHER, with_flights
from tarmac.plans.registry import register
from tarmac.sources import fixture


def _fl(spark, d):
    return fixture.flights(spark, d)


@register("schedule_features", with_flights("""
SELECT flight_id, count(*) OVER (PARTITION BY base_airport, date, hour) AS hourly_flight_count,
  count(*) OVER (PARTITION BY base_airport, date, hour, runway) AS runway_hourly_count, is_peak_hour, is_high_impact
FROM flights
"""))
def _sf(spark, d):
    return FE.add_schedule_features(_fl(spark, d)).select(
        "flight_id", "hourly_flight_count", "runway_hourly_count", "is_peak_hour", "is_high_impact")


@register("rolling_delay", with_flights("""
SELECT flight_id, avg(delay_minutes) OVER w AS rolling_delay_mean, coalesce(stddev_samp(delay_minutes) OVER w, 0.0) AS rolling_delay_std
FROM flights WINDOW w AS (PARTITION BY base_airport ORDER BY scheduled_time, flight_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
"""))
def _rd(spark, d):
    return FE.rolling_delay(_fl(spark, d)).select("flight_id", "rolling_delay_mean", "rolling_delay_std")


@register("traffic_density", with_flights("""
SELECT flight_id, count(*) OVER (PARTITION BY hour) AS hourly_traffic_density,
  count(*) OVER (PARTITION BY runway, hour) AS runway_utilization
FROM flights
"""))
def _td(spark, d):
    return FE.traffic_density(_fl(spark, d)).select("flight_id", "hourly_traffic_density", "runway_utilization")


_MODEL_COLS = ["flight_id", "month", "is_weekend", "is_morning_peak", "is_evening_peak", "is_night", "is_congested_airport",
               "is_large_aircraft", "is_high_impact_int", "peak_category_numeric", "runway_utilization", "weather_score",
               "airline_reputation", "crew_rest_risk", "connecting_count", "capacity_category", "hourly_flights",
               "is_congested_hour", "is_runway_congested", "dest_bom", "dest_del"]


@register("model_features", with_flights("""
, f1 AS (SELECT *, count(*) OVER (PARTITION BY base_airport, date, hour) AS hourly_flight_count,
    count(*) OVER (PARTITION BY base_airport, date, hour, runway) AS runway_hourly_count,
    count(*) OVER (PARTITION BY origin, hour) AS hourly_flights FROM flights),
q AS (SELECT quantile_cont(hourly_flight_count, 0.75) AS qh, quantile_cont(runway_hourly_count, 0.75) AS qr FROM f1)
SELECT flight_id, CAST(month(scheduled_time) AS INTEGER) AS month,
  CAST(day_of_week IN (5, 6) AS INTEGER) AS is_weekend, CAST(hour IN (6, 7, 8, 9) AS INTEGER) AS is_morning_peak,
  CAST(hour IN (18, 19, 20, 21) AS INTEGER) AS is_evening_peak, CAST(hour IN (22, 23, 0, 1, 2, 3, 4, 5) AS INTEGER) AS is_night,
  CAST(substr(origin, 1, 3) IN ('BOM', 'DEL') AS INTEGER) AS is_congested_airport,
  CAST(coalesce(capacity, 0) > 250 AS INTEGER) AS is_large_aircraft, CAST(is_high_impact AS INTEGER) AS is_high_impact_int,
  CASE peak_category WHEN 'super_peak' THEN 4 WHEN 'peak' THEN 3 WHEN 'moderate' THEN 2 WHEN 'low' THEN 1 ELSE 2 END AS peak_category_numeric,
  coalesce(hourly_flights / runway_capacity, 0.5) AS runway_utilization, 0 AS weather_score,
  CASE airline WHEN 'AI' THEN 0.82 WHEN '6E' THEN 0.78 WHEN 'UK' THEN 0.70 WHEN 'SG' THEN 0.72 WHEN 'G8' THEN 0.68
    WHEN 'QP' THEN 0.65 WHEN 'I5' THEN 0.66 WHEN '9W' THEN 0.70 WHEN 'VT' THEN 0.74 WHEN 'IX' THEN 0.69 ELSE 0.65 END::DOUBLE AS airline_reputation,
  0 AS crew_rest_risk, 0 AS connecting_count,
  CASE WHEN capacity > 0 AND capacity <= 150 THEN 'Small' WHEN capacity > 150 AND capacity <= 200 THEN 'Medium'
    WHEN capacity > 200 AND capacity <= 250 THEN 'Large' WHEN capacity > 250 AND capacity <= 350 THEN 'XLarge' END AS capacity_category,
  hourly_flights, CAST(hourly_flight_count > qh AS INTEGER) AS is_congested_hour,
  CAST(runway_hourly_count > qr AS INTEGER) AS is_runway_congested,
  CAST(substr(destination, 1, 3) = 'BOM' AS INTEGER) AS dest_bom, CAST(substr(destination, 1, 3) = 'DEL' AS INTEGER) AS dest_del
FROM f1, q
"""))
def _mf(spark, d):
    return FE.delay_model_features(_fl(spark, d)).select(*_MODEL_COLS)


@register("anomaly_features", with_flights(r"""
SELECT flight_id, CAST(dayofyear(scheduled_time) AS INTEGER) AS day_of_year, CAST(delay_minutes > 0 AS INTEGER) AS is_delayed,
  CASE WHEN delay_minutes <= 0 THEN 'On_Time' WHEN delay_minutes <= 15 THEN 'Minor' WHEN delay_minutes <= 30 THEN 'Moderate'
    WHEN delay_minutes <= 60 THEN 'Major' ELSE 'Severe' END AS delay_category,
  capacity / max(capacity) OVER () AS capacity_utilization, CAST(congestion_factor > 1.5 AS INTEGER) AS high_congestion,
  regexp_extract(aircraft_type, '([A-Za-z0-9]{1,4})', 1) AS aircraft_family,
  CAST(regexp_extract(aircraft_type, '([A-Za-z0-9]{1,4})', 1) IN ('A330','A350','A380','B747','B767','B777','B787') AS INTEGER) AS is_wide_body,
  CAST(contains(upper(aircraft_type), 'A320') AS INTEGER) AS is_a320_family,
  CAST(contains(upper(aircraft_type), 'B777') AS INTEGER) AS is_b777_family,
  avg(delay_minutes) OVER w AS rolling_delay_mean, coalesce(stddev_samp(delay_minutes) OVER w, 0.0) AS rolling_delay_std,
  count(*) OVER (PARTITION BY hour) AS hourly_traffic_density, count(*) OVER (PARTITION BY runway, hour) AS runway_utilization
FROM flights WINDOW w AS (PARTITION BY base_airport ORDER BY scheduled_time, flight_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
"""))
def _af(spark, d):
    return FE.anomaly_features(_fl(spark, d)).select(
        "flight_id", "day_of_year", "is_delayed", "delay_category", "capacity_utilization", "high_congestion", "aircraft_family",
        "is_wide_body", "is_a320_family", "is_b777_family", "rolling_delay_mean", "rolling_delay_std",
        "hourly_traffic_density", "runway_utilization")


TURNAROUND = """
, seq AS (SELECT flight_id, aircraft_id, scheduled_time, delay_minutes, actual_time,
    row_number() OVER (PARTITION BY aircraft_id ORDER BY scheduled_time, flight_id) AS rn FROM flights),
rec AS (
  SELECT aircraft_id, rn, flight_id, scheduled_time, delay_minutes AS delay, actual_time AS act FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.aircraft_id, s.rn, s.flight_id, s.scheduled_time,
    CASE WHEN r.act + INTERVAL 45 MINUTE > s.scheduled_time
      THEN s.delay_minutes + epoch(r.act + INTERVAL 45 MINUTE - s.scheduled_time) / 60.0 ELSE s.delay_minutes END,
    CASE WHEN r.act + INTERVAL 45 MINUTE > s.scheduled_time THEN r.act + INTERVAL 45 MINUTE ELSE s.actual_time END
  FROM rec r JOIN seq s ON s.aircraft_id = r.aircraft_id AND s.rn = r.rn + 1)
"""


@register("propagate_turnaround", with_flights(TURNAROUND + """
SELECT flight_id, aircraft_id, scheduled_time, delay AS delay_minutes, act AS actual_time FROM rec
""", recursive=True))
def _pt(spark, d):
    return S.propagate_turnaround(_fl(spark, d))


@register("propagate_turnaround_max", with_flights("""
, seq AS (SELECT *, row_number() OVER (PARTITION BY aircraft_id ORDER BY scheduled_time, flight_id) - 1 AS i FROM flights),
v AS (SELECT *, max(epoch(actual_time) // 60 - i * 45) OVER (PARTITION BY aircraft_id ORDER BY scheduled_time, flight_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM seq),
a AS (SELECT *, TIMESTAMP '1970-01-01 00:00:00' + to_minutes(CAST(best + i * 45 AS BIGINT)) AS na FROM v)
SELECT flight_id, aircraft_id, scheduled_time, delay_minutes + greatest(0.0, epoch(na - actual_time) / 60.0) AS delay_minutes,
  na AS actual_time FROM a
"""))
def _ptm(spark, d):
    return S.propagate_turnaround(_fl(spark, d), mode="max")


@register("trailing_hour_load", with_flights("""
SELECT flight_id, count(*) OVER (PARTITION BY base_airport, runway, date ORDER BY epoch(scheduled_time) // 60
  RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS trailing_hour_load
FROM flights
"""))
def _thl(spark, d):
    return S.trailing_hour_load(_fl(spark, d)).select("flight_id", "trailing_hour_load")


@register("propagate_runway_congestion", with_flights("""
, ld AS (SELECT *, count(*) OVER (PARTITION BY base_airport, runway, date ORDER BY epoch(scheduled_time) // 60
    RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) / runway_capacity AS util FROM flights),
seq AS (SELECT *, row_number() OVER (PARTITION BY base_airport, runway, date ORDER BY scheduled_time, flight_id) AS rn FROM ld),
rec AS (
  SELECT base_airport, runway, date, rn, flight_id, util, delay, CASE WHEN delay > 0 THEN delay * 0.1 ELSE 0.0 END AS acc
  FROM (SELECT *, delay_minutes AS delay FROM seq WHERE rn = 1)
  UNION ALL
  SELECT base_airport, runway, date, rn, flight_id, util, nd,
    CASE WHEN nd > 0 THEN a2 + nd * 0.1 ELSE a2 END
  FROM (
    SELECT s.base_airport, s.runway, s.date, s.rn, s.flight_id, s.util,
      CASE WHEN s.util > 0.8 AND r.acc > 0 THEN s.delay_minutes + floor(least(60.0, r.acc * 0.3 * s.util)) ELSE s.delay_minutes END AS nd,
      CASE WHEN s.util > 0.8 AND r.acc > 0 THEN r.acc + least(60.0, r.acc * 0.3 * s.util) ELSE greatest(0.0, r.acc * 0.8) END AS a2
    FROM rec r JOIN seq s ON s.base_airport = r.base_airport AND s.runway = r.runway AND s.date = r.date AND s.rn = r.rn + 1))
SELECT flight_id, delay AS delay_minutes, util AS runway_utilization FROM rec
""", recursive=True))
def _prc(spark, d):
    return S.propagate_runway_congestion(_fl(spark, d))


@register("weather_join", with_flights("""
SELECT f.flight_id, f.weather_hour, coalesce(w.weather_condition, 'Clear') AS weather_condition,
  coalesce(w.visibility_km, 10.0) AS visibility_km, coalesce(w.wind_speed_kts, 5) AS wind_speed_kts,
  coalesce(w.precipitation_mm, 0.0) AS precipitation_mm, coalesce(w.capacity_reduction_factor, 1.0) AS capacity_reduction_factor,
  coalesce(w.landing_restrictions, false) AS landing_restrictions, coalesce(w.takeoff_restrictions, false) AS takeoff_restrictions,
  coalesce(w.crosswind_runway_closure, false) AS crosswind_runway_closure
FROM (SELECT *, date_trunc('hour', scheduled_time) AS weather_hour FROM flights) f LEFT JOIN weather w USING (weather_hour)
""", WEATHER))
def _wj(spark, d):
    fl = _fl(spark, d)
    return J.weather_join(fl, fixture.weather_from_flights(fl)).select(
        "flight_id", "weather_hour", *J.WEATHER_DEFAULTS)


@register("nearest_slot", with_flights("""
SELECT flight_id, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(
  CASE WHEN s - (s // 900) * 900 > 450 THEN (s // 900) * 900 + 900 ELSE (s // 900) * 900 END AS BIGINT)) AS slot
FROM (SELECT flight_id, CAST(epoch(actual_time) AS BIGINT) AS s FROM flights)
"""))
def _ns(spark, d):
    return _fl(spark, d).select("flight_id", J.nearest_slot(F.col("actual_time")).alias("slot"))


@register("off_peak_flights", with_flights("""
SELECT flight_id, hour, delay_minutes FROM flights WHERE hour NOT IN (7, 8, 9, 19, 20, 21, 6, 10, 18, 22)
"""))
def _op(spark, d):
    return J.off_peak_anti(_fl(spark, d)).select("flight_id", "hour", "delay_minutes")


@register("topk_airline_flights", with_flights("""
SELECT flight_id, airline FROM flights WHERE airline IN (
  SELECT airline FROM flights GROUP BY airline ORDER BY count(*) DESC, airline LIMIT 3)
"""))
def _tk(spark, d):
    return J.topk_semi(_fl(spark, d), "airline", 3).select("flight_id", "airline")


WAKE_SQL = """
, cat AS (SELECT flight_id, base_airport, runway, scheduled_time,
    CASE aircraft_type WHEN 'A320' THEN 'Medium' WHEN 'A321' THEN 'Medium' WHEN 'A330' THEN 'Heavy' WHEN 'A350' THEN 'Heavy'
      WHEN 'B737' THEN 'Medium' WHEN 'B777' THEN 'Heavy' WHEN 'B787' THEN 'Heavy' WHEN 'ATR72' THEN 'Light' WHEN 'Q400' THEN 'Light'
      ELSE 'Medium' END AS category FROM flights),
lg AS (SELECT *, lag(flight_id) OVER w AS leader_id, lag(scheduled_time) OVER w AS leader_time, lag(category) OVER w AS leader_category
       FROM cat WINDOW w AS (PARTITION BY base_airport, runway ORDER BY scheduled_time, flight_id)),
sep AS (SELECT * FROM (VALUES ('Heavy','Heavy',4),('Heavy','Medium',5),('Heavy','Light',6),('Medium','Heavy',3),
    ('Medium','Medium',3),('Medium','Light',5),('Light','Heavy',3),('Light','Medium',3),('Light','Light',3)) t(l, f, m))
SELECT flight_id, base_airport, runway, leader_id, leader_category, category,
  epoch(scheduled_time - leader_time) / 60.0 AS gap_minutes, m AS required_minutes,
  epoch(scheduled_time - leader_time) / 60.0 < m AS violation
FROM lg LEFT JOIN sep ON sep.l = lg.leader_category AND sep.f = lg.category WHERE leader_id IS NOT NULL
"""


@register("wake_separation_check", with_flights(WAKE_SQL))
def _wake(spark, d):
    return J.wake_separation_check(_fl(spark, d))


@register("turnaround_violations", with_flights("""
SELECT flight_id, aircraft_id, prev_id, gap_minutes FROM (
  SELECT flight_id, aircraft_id, lag(flight_id) OVER w AS prev_id,
    epoch(scheduled_time - lag(scheduled_time) OVER w) / 60.0 AS gap_minutes
  FROM flights WINDOW w AS (PARTITION BY aircraft_id ORDER BY scheduled_time, flight_id))
WHERE prev_id IS NOT NULL AND gap_minutes < 45
"""))
def _tv(spark, d):
    return J.turnaround_violations(_fl(spark, d))


@register("first_30_by_time", with_flights("""
SELECT flight_id, airline, scheduled_time, runway FROM flights ORDER BY scheduled_time, flight_id LIMIT 30
"""))
def _f30(spark, d):
    return _fl(spark, d).orderBy("scheduled_time", "flight_id").limit(30).select("flight_id", "airline", "scheduled_time", "runway")


@register("multi_key_sort_top20", with_flights("""
SELECT flight_id, delay_minutes, congestion_factor FROM flights
ORDER BY delay_minutes DESC, congestion_factor ASC, flight_id LIMIT 20
"""))
def _mks(spark, d):
    return _fl(spark, d).orderBy(F.col("delay_minutes").desc(), F.col("congestion_factor").asc(), "flight_id").limit(20).select(
        "flight_id", "delay_minutes", "congestion_factor")


@register("distinct_routes", with_flights("SELECT DISTINCT origin, destination, runway FROM flights"))
def _dr(spark, d):
    return _fl(spark, d).select("origin", "destination", "runway").distinct()


@register("sample_flights", with_flights("SELECT flight_id, delay_minutes, hour FROM flights ORDER BY md5(flight_id), flight_id LIMIT 200"))
def _sample(spark, d):
    """T4: at most 200 flights for charts, in the order of a hash of their id."""
    return _fl(spark, d).select("flight_id", "delay_minutes", "hour").orderBy(F.md5("flight_id"), "flight_id").limit(200)
