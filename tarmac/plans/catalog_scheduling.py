"""Registered scheduling queries (K*) with DuckDB twins; the allocators are rows-only + invariant tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import scheduling as K
from tarmac.plans.oracle import WEATHER, with_flights
from tarmac.plans.registry import register
from tarmac.sources import fixture


def _fl(spark, d):
    return fixture.flights(spark, d)


IMPROVE = """(least(0.40, greatest(0.10, 0.25
  + CASE WHEN coalesce(is_high_impact, false) THEN 0.10 ELSE 0.0 END
  + CASE WHEN coalesce(congestion_factor, 1.0) < 1.3 THEN 0.05 WHEN coalesce(congestion_factor, 1.0) > 1.7 THEN -0.05 ELSE 0.0 END
  + CASE WHEN coalesce(peak_category, 'moderate') = 'low' THEN 0.08 WHEN coalesce(peak_category, 'moderate') = 'super_peak' THEN -0.10 ELSE 0.0 END
  + CASE WHEN coalesce(runway_efficiency, 1.0) > 0.85 THEN 0.03 ELSE 0.0 END)))"""

GIVEN_GREEDY = f"""
, g0 AS (SELECT *, scheduled_time + to_minutes(CAST(15 * (minute(scheduled_time) % 3) AS BIGINT)) AS optimized_time,
    hour NOT IN (7, 8, 9, 19, 20, 21) AS can_improve,
    CAST(coalesce(is_high_impact, false) AS INTEGER) * 1000 + coalesce(congestion_factor, 1.0) * 100
      + CAST(delay_minutes > 30 AS INTEGER) * 50 AS optimization_priority FROM flights),
g1 AS (SELECT *, greatest(0.0, epoch(optimized_time - scheduled_time) / 60.0) AS time_shift_delay FROM g0),
g2 AS (SELECT *, CASE WHEN can_improve AND delay_minutes > 0
    THEN greatest(0.0, delay_minutes - delay_minutes * {IMPROVE} + time_shift_delay)
    ELSE delay_minutes + time_shift_delay END AS optimized_delay FROM g1),
g3 AS (SELECT *, CASE WHEN delay_minutes > 0 THEN greatest(0.0, (delay_minutes - optimized_delay) / delay_minutes)
    WHEN time_shift_delay = 0 THEN 0.0 ELSE -0.1 END AS optimization_score FROM g2)
"""


def _given_greedy(fl):
    df = K.optimization_priority(fl).withColumns({
        "optimized_time": F.timestamp_add("MINUTE", (F.minute("scheduled_time") % 3) * 15, F.col("scheduled_time")),
        "can_improve": ~F.col("hour").isin(7, 8, 9, 19, 20, 21),
    })
    return K.optimized_delay(df)


@register("optimized_delay", with_flights(GIVEN_GREEDY + """
SELECT flight_id, optimization_priority, time_shift_delay, optimized_delay, optimization_score FROM g3
"""))
def _od(spark, d):
    return _given_greedy(_fl(spark, d)).select(
        "flight_id", "optimization_priority", "time_shift_delay", "optimized_delay", "optimization_score")


@register("optimization_summary", with_flights(GIVEN_GREEDY + """
SELECT *, CASE WHEN original_total_delay > 0 THEN least(0.35, greatest(0.0,
  (original_total_delay - optimized_total_delay) / original_total_delay)) ELSE 0.0 END AS optimization_improvement FROM (
  SELECT sum(delay_minutes) AS original_total_delay, sum(optimized_delay) AS optimized_total_delay,
    count(*) FILTER (WHERE optimization_score > 0) AS flights_improved, count(*) AS total_flights FROM g3)
"""))
def _os(spark, d):
    return K.optimization_summary(_given_greedy(_fl(spark, d)))


@register("greedy_slot_allocation")
def _greedy(spark, d):
    return K.greedy_slot_allocation(_fl(spark, d)).select(
        "flight_id", "optimized_time", "optimized_runway", "can_improve", "optimized_delay", "optimization_score")


@register("slot_penalty", with_flights("""
, p AS (SELECT flight_id, TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(CASE WHEN s - (s // 900) * 900 > 450
      THEN (s // 900) * 900 + 900 ELSE (s // 900) * 900 END AS BIGINT)) AS preferred_slot,
    coalesce(congestion_factor, 1.0)
      * coalesce(CASE peak_category WHEN 'super_peak' THEN 3.0 WHEN 'peak' THEN 2.0 WHEN 'moderate' THEN 1.0 WHEN 'low' THEN 0.5 END, 1.0)
      * CASE WHEN coalesce(is_high_impact, false) THEN 2.5 ELSE 1.0 END / coalesce(runway_efficiency, 1.0) AS m
  FROM (SELECT *, CAST(epoch(scheduled_time) AS BIGINT) AS s FROM flights))
SELECT flight_id, o AS slot_offset, preferred_slot, preferred_slot + to_minutes(CAST(o * 15 AS BIGINT)) AS slot_time,
  CAST(floor(abs(o) * m) AS BIGINT) AS penalty
FROM p, (SELECT CAST(range AS INTEGER) AS o FROM range(-8, 9))
"""))
def _sp(spark, d):
    return K.slot_penalty(_fl(spark, d))


@register("slot_penalty_day", with_flights("""
, p AS (SELECT flight_id, date_trunc('day', scheduled_time) AS d, s // 86400 * 96 AS first_slot,
    CASE WHEN s % 900 > 450 THEN s // 900 + 1 ELSE s // 900 END AS pref,
    coalesce(congestion_factor, 1.0)
      * coalesce(CASE peak_category WHEN 'super_peak' THEN 3.0 WHEN 'peak' THEN 2.0 WHEN 'moderate' THEN 1.0 WHEN 'low' THEN 0.5 END, 1.0)
      * CASE WHEN coalesce(is_high_impact, false) THEN 2.5 ELSE 1.0 END / coalesce(runway_efficiency, 1.0) AS m
  FROM (SELECT *, CAST(epoch(scheduled_time) AS BIGINT) AS s FROM flights))
SELECT flight_id, CAST(first_slot + k - pref AS INTEGER) AS slot_offset,
  TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(pref * 900 AS BIGINT)) AS preferred_slot,
  CAST(d AS TIMESTAMP) + to_minutes(CAST(k * 15 AS BIGINT)) AS slot_time, CAST(floor(abs(first_slot + k - pref) * m) AS BIGINT) AS penalty
FROM p, (SELECT range AS k FROM range(0, 96))
"""))
def _spd(spark, d):
    return K.slot_penalty_day(_fl(spark, d))


SUIT = """
, ac(m, ml, cat, prefs) AS (VALUES ('A320', 2400, 'Medium', ['09R/27L', '09L/27R', '14/32']),
  ('A321', 2500, 'Medium', ['09R/27L', '09L/27R', '14/32']), ('A330', 2500, 'Heavy', ['09R/27L', '09L/27R']),
  ('A350', 2600, 'Heavy', ['09R/27L', '09L/27R']), ('B737', 2100, 'Medium', ['09R/27L', '09L/27R', '14/32', '27/09']),
  ('B777', 2600, 'Heavy', ['09R/27L', '09L/27R']), ('B787', 2600, 'Heavy', ['09R/27L', '09L/27R']),
  ('ATR72', 1200, 'Light', ['14/32', '27/09']), ('Q400', 1425, 'Light', ['14/32', '27/09'])),
rw(runway_id, len, cats, ord) AS (VALUES ('09R/27L', 4430, ['Heavy', 'Medium'], 1), ('09L/27R', 4430, ['Heavy', 'Medium'], 2),
  ('14/32', 2925, ['Medium', 'Light'], 3), ('27/09', 3445, ['Medium', 'Light'], 4)),
suit AS (
  SELECT f.flight_id, f.aircraft_type, rw.runway_id, rw.ord, least(1.0::DOUBLE, 0.5::DOUBLE
    + CASE WHEN ac.ml IS NOT NULL AND rw.len >= ac.ml THEN 0.2 ELSE 0.0 END
    + CASE WHEN ac.prefs IS NOT NULL AND list_contains(ac.prefs, rw.runway_id) THEN 0.2 ELSE 0.0 END
    + CASE WHEN list_contains(rw.cats, coalesce(ac.cat, 'Medium')) THEN 0.1 ELSE 0.0 END) AS suitability
  FROM flights f CROSS JOIN rw LEFT JOIN ac ON ac.m = f.aircraft_type)
"""


@register("runway_suitability", with_flights(SUIT + "SELECT flight_id, aircraft_type, runway_id, suitability FROM suit"))
def _rs(spark, d):
    return K.runway_suitability(_fl(spark, d))


@register("allocate_runway_slots")
def _alloc(spark, d):
    return K.allocate_runway_slots(_fl(spark, d))


GIVEN_ASG = SUIT + """
, asg AS (
  SELECT f.flight_id, f.base_airport, f.aircraft_id, f.capacity, f.delay_minutes, f.scheduled_time,
    CASE WHEN f.is_emergency THEN 1 WHEN f.is_international THEN 2 WHEN f.capacity >= 150 THEN 3 WHEN f.capacity >= 50 THEN 4 ELSE 5 END AS priority,
    coalesce(ac.cat, 'Medium') AS aircraft_category, s.runway_id AS optimized_runway,
    TIMESTAMP '1970-01-01 00:00:00' + to_seconds(CAST(CASE WHEN e - (e // 900) * 900 > 450 THEN (e // 900) * 900 + 900
      ELSE (e // 900) * 900 END AS BIGINT)) AS optimized_time, s.suitability AS suitability_score
  FROM (SELECT *, CAST(epoch(scheduled_time) AS BIGINT) AS e FROM flights) f
  JOIN suit s ON s.flight_id = f.flight_id AND s.ord = minute(f.scheduled_time) % 4 + 1
  LEFT JOIN ac ON ac.m = f.aircraft_type),
asg2 AS (SELECT *, epoch(optimized_time - scheduled_time) / 60.0 AS schedule_change_minutes FROM asg)
"""


def _asg(spark, d):
    return K.given_assignment(_fl(spark, d))


@register("runway_efficiency_metrics", with_flights(GIVEN_ASG + """
SELECT rw.runway_id AS optimized_runway, coalesce(a.m / rw_ops.max_ops * 100, 0.0) AS utilization_rate
FROM rw JOIN (VALUES ('09R/27L', 35), ('09L/27R', 35), ('14/32', 25), ('27/09', 28)) rw_ops(rid, max_ops) ON rw_ops.rid = rw.runway_id
LEFT JOIN (SELECT optimized_runway, avg(n) AS m FROM (SELECT optimized_runway, count(*) AS n
           FROM asg2 GROUP BY optimized_runway, base_airport, date_trunc('hour', optimized_time)) GROUP BY 1) a ON a.optimized_runway = rw.runway_id
"""))
def _rem(spark, d):
    return K.runway_efficiency_metrics(_asg(spark, d))


@register("priority_compliance", with_flights(GIVEN_ASG + """
SELECT p AS priority, coalesce(greatest(0.0, 100 - abs(a)), 100.0) AS compliance
FROM (SELECT CAST(range AS INTEGER) AS p FROM range(1, 6)) LEFT JOIN
  (SELECT priority, avg(schedule_change_minutes) AS a FROM asg2 GROUP BY priority) ON priority = p
"""))
def _pcm(spark, d):
    return K.priority_compliance(_asg(spark, d))


@register("category_efficiency", with_flights(GIVEN_ASG + """
SELECT aircraft_category, count(*) AS flights, avg(suitability_score) AS avg_suitability, avg(schedule_change_minutes) AS avg_schedule_change
FROM asg2 WHERE optimized_time IS NOT NULL GROUP BY aircraft_category
"""))
def _ce(spark, d):
    return K.category_efficiency(_asg(spark, d))


@register("allocation_rollups", with_flights(GIVEN_ASG + """
SELECT aircraft_category, optimized_runway, count(*) AS flights, avg(suitability_score) AS avg_suitability,
  avg(schedule_change_minutes) AS avg_schedule_change, CAST(sum(capacity) AS BIGINT) AS passengers FROM asg2 GROUP BY 1, 2
"""))
def _ar(spark, d):
    return K.allocation_rollups(_asg(spark, d))


@register("schedule_audit", with_flights(GIVEN_ASG + """
SELECT
  (SELECT count(*) FROM (SELECT base_airport, optimized_runway, date_trunc('hour', optimized_time) AS h, count(*) AS n FROM asg2 GROUP BY 1, 2, 3) x
   LEFT JOIN (VALUES ('09R/27L', 35), ('09L/27R', 35), ('14/32', 25), ('27/09', 28)) o(rid, max_ops) ON o.rid = x.optimized_runway
   WHERE n > coalesce(max_ops, 0)) AS over_capacity_runway_hours,
  (SELECT count(*) FROM (SELECT flight_id FROM asg2 GROUP BY flight_id HAVING count(*) > 1)) AS duplicate_assignments,
  (SELECT count(*) FROM (SELECT flight_id, lag(flight_id) OVER w AS p, epoch(optimized_time - lag(optimized_time) OVER w) / 60.0 AS g
     FROM asg2 WINDOW w AS (PARTITION BY aircraft_id ORDER BY optimized_time, flight_id)) WHERE p IS NOT NULL AND g < 45)
    AS turnaround_violations
"""))
def _sa(spark, d):
    return K.schedule_audit(_asg(spark, d))


RESCHED = """
, wj AS (SELECT f.*, coalesce(w.weather_condition, 'Clear') AS weather_condition
  FROM (SELECT *, date_trunc('hour', scheduled_time) AS weather_hour FROM flights) f LEFT JOIN weather w USING (weather_hour)),
c0 AS (SELECT wj.*, hour AS current_hour,
    CASE weather_condition WHEN 'Clear' THEN 1.0 WHEN 'Light Rain' THEN 1.2 WHEN 'Heavy Rain' THEN 1.8 WHEN 'Fog' THEN 2.0
      WHEN 'Storm' THEN 3.0 WHEN 'Snow' THEN 2.5 WHEN 'Moderate Rain' THEN 1.5 WHEN 'Thunderstorm' THEN 3.0 WHEN 'Strong Winds' THEN 1.5 END::DOUBLE AS weather_impact_factor,
    coalesce(CASE runway WHEN 'R1' THEN 35 WHEN 'R2' THEN 30 WHEN 'R3' THEN 25 WHEN 'R4' THEN 20 WHEN '09R/27L' THEN 35
      WHEN '09L/27R' THEN 30 WHEN '14/32' THEN 25 END, 30) AS runway_capacity_r,
    count(*) OVER (PARTITION BY base_airport, runway, CAST(scheduled_time AS DATE), hour) AS current_usage FROM wj),
c1 AS (SELECT *, delay_minutes * weather_impact_factor AS weather_adjusted_delay,
    round(current_usage / runway_capacity_r * 100, 1) AS runway_utilization_pct FROM c0),
cand AS (SELECT * FROM c1 WHERE coalesce(weather_adjusted_delay > 30 OR runway_utilization_pct > 85 OR delay_minutes > 45, false)),
keys AS (SELECT DISTINCT base_airport, runway FROM flights),
days AS (SELECT base_airport, count(DISTINCT CAST(scheduled_time AS DATE)) AS days FROM flights GROUP BY 1),
grid AS (SELECT k.base_airport, k.runway, h.hour, coalesce(u.u, 0) / d.days AS u FROM keys k JOIN days d USING (base_airport)
  CROSS JOIN (SELECT * FROM (VALUES (6), (9), (10), (11), (12), (13), (14), (15), (16), (17), (18), (22)) t(hour)) h
  LEFT JOIN (SELECT base_airport, runway, hour, count(*) AS u FROM flights GROUP BY 1, 2, 3) u USING (base_airport, runway, hour)),
best AS (SELECT base_airport, runway, hour AS best_hour, u AS best_hour_usage FROM (
  SELECT *, row_number() OVER (PARTITION BY base_airport, runway ORDER BY u, hour) AS r FROM grid) WHERE r = 1),
recs AS (
  SELECT c.flight_id, c.airline, c.current_hour, b.best_hour AS recommended_hour, c.runway, c.delay_minutes AS current_delay,
    c.weather_condition, c.weather_impact_factor AS weather_impact, c.runway_utilization_pct AS current_runway_util,
    CASE WHEN b.best_hour_usage / c.runway_capacity_r * 100 < 70 THEN b.best_hour_usage / c.runway_capacity_r * 100 END
      AS recommended_runway_util,
    least(c.delay_minutes * 0.3 + abs(b.best_hour - c.current_hour) * 2
      * CASE WHEN c.weather_condition IN ('Heavy Rain', 'Storm', 'Fog') THEN 0.8 ELSE 1.0 END
      + greatest(0.0, (c.runway_utilization_pct - 70) / 100) * 20, c.delay_minutes) AS expected_delay_reduction,
    CASE WHEN c.delay_minutes > 60 THEN 'High' WHEN c.delay_minutes > 30 THEN 'Medium' ELSE 'Low' END AS priority,
    coalesce(nullif(concat_ws('; ',
      CASE WHEN c.weather_impact_factor > 1.5 THEN 'Weather impact (' || c.weather_condition || ')' END,
      CASE WHEN c.runway_utilization_pct > 85 THEN 'Runway overcapacity (' || format('{:.1f}', c.runway_utilization_pct) || '%)' END,
      CASE WHEN c.delay_minutes > 45 THEN 'High delay (' || format('{:.0f}', c.delay_minutes) || ' min)' END,
      CASE WHEN abs(b.best_hour - c.current_hour) > 2 THEN 'Peak hour avoidance' END), ''), 'General optimization') AS reason
  FROM cand c LEFT JOIN best b USING (base_airport, runway))
"""


def _recs(spark, d):
    fl = _fl(spark, d)
    return K.reschedule_recommendations(fl, fixture.weather_from_flights(fl))


@register("reschedule_recommendations", with_flights(RESCHED + "SELECT * FROM recs", WEATHER))
def _rr(spark, d):
    return _recs(spark, d)


@register("apply_recommendations", with_flights(RESCHED + """
SELECT f.flight_id, f.hour AS current_hour, f.delay_minutes,
  CASE WHEN r.recommended_hour IS NOT NULL THEN r.recommended_hour ELSE f.hour END AS optimized_hour,
  CASE WHEN r.recommended_hour IS NOT NULL THEN f.delay_minutes - r.expected_delay_reduction ELSE f.delay_minutes * 0.9 END AS optimized_delay,
  CASE WHEN r.recommended_hour IS NOT NULL THEN 'Rescheduled' ELSE 'Original' END AS status
FROM flights f LEFT JOIN recs r USING (flight_id)
""", WEATHER))
def _ap(spark, d):
    return K.apply_recommendations(_fl(spark, d), _recs(spark, d))


@register("reschedule_by_weather", with_flights(RESCHED + """
SELECT weather_condition, count(flight_id) AS flights_affected, avg(expected_delay_reduction) AS avg_delay_reduction,
  avg(weather_impact) AS avg_weather_impact FROM recs GROUP BY weather_condition
""", WEATHER))
def _rbw(spark, d):
    return K.reschedule_by_weather(_recs(spark, d))


@register("assignment_join", with_flights(GIVEN_ASG + """
SELECT f.flight_id, coalesce(a.optimized_runway, f.runway) AS runway, coalesce(a.optimized_time, f.scheduled_time) AS scheduled_time
FROM flights f LEFT JOIN (SELECT * FROM asg2 WHERE priority <= 2) a USING (flight_id)
"""))
def _aj(spark, d):
    from tarmac.operators.joins import assignment_join

    fl = _fl(spark, d)
    asg = K.given_assignment(fl).filter(F.col("priority") <= 2).select(
        "flight_id", F.col("optimized_runway").alias("runway"), F.col("optimized_time").alias("scheduled_time"))
    return assignment_join(fl, asg, ["runway", "scheduled_time"]).select("flight_id", "runway", "scheduled_time")


@register("before_after", with_flights(RESCHED + """
, opt AS (SELECT CASE WHEN r.recommended_hour IS NOT NULL THEN r.recommended_hour ELSE f.hour END AS hour,
    CASE WHEN r.recommended_hour IS NOT NULL THEN f.delay_minutes - r.expected_delay_reduction ELSE f.delay_minutes * 0.9 END
      AS delay_minutes FROM flights f LEFT JOIN recs r USING (flight_id)),
o AS (SELECT hour, avg(delay_minutes) AS original_avg, max(delay_minutes) AS original_max,
    count(*) FILTER (WHERE delay_minutes > 0) AS original_delayed FROM flights GROUP BY hour),
n AS (SELECT hour, avg(delay_minutes) AS optimized_avg, max(delay_minutes) AS optimized_max,
    count(*) FILTER (WHERE delay_minutes > 0) AS optimized_delayed FROM opt GROUP BY hour)
SELECT g.hour, original_avg, original_max, original_delayed, optimized_avg, optimized_max, optimized_delayed,
  original_avg - optimized_avg AS avg_reduction, original_max - optimized_max AS max_reduction,
  original_delayed - optimized_delayed AS delayed_reduction
FROM (SELECT CAST(range AS INTEGER) AS hour FROM range(24)) g LEFT JOIN o USING (hour) LEFT JOIN n USING (hour)
""", WEATHER))
def _ba(spark, d):
    from tarmac.operators.aggregates import before_after

    fl = _fl(spark, d)
    opt = K.apply_recommendations(fl, _recs(spark, d)).select(
        F.col("optimized_hour").alias("hour"), F.col("optimized_delay").alias("delay_minutes"))
    return before_after(fl, opt)


@register("allocation_rollup_hour_runway", with_flights(GIVEN_ASG + """
SELECT CAST(hour(optimized_time) AS INTEGER) AS hour, optimized_runway, count(*) AS flights, avg(suitability_score) AS avg_suitability,
  avg(schedule_change_minutes) AS avg_schedule_change, CAST(sum(capacity) AS BIGINT) AS passengers FROM asg2 GROUP BY 1, 2
"""))
def _arh(spark, d):
    return K.allocation_rollups(_asg(spark, d), ("hour", "optimized_runway"))


@register("allocation_rollup_priority_runway", with_flights(GIVEN_ASG + """
SELECT priority, optimized_runway, count(*) AS flights, avg(suitability_score) AS avg_suitability,
  avg(schedule_change_minutes) AS avg_schedule_change, CAST(sum(capacity) AS BIGINT) AS passengers FROM asg2 GROUP BY 1, 2
"""))
def _arp(spark, d):
    return K.allocation_rollups(_asg(spark, d), ("priority", "optimized_runway"))


@register("allocation_summary", with_flights(GIVEN_ASG + """
, util AS (SELECT avg(coalesce(a.m / o.max_ops * 100, 0.0)) AS average_utilization
  FROM (VALUES ('09R/27L', 35), ('09L/27R', 35), ('14/32', 25), ('27/09', 28)) o(rid, max_ops)
  LEFT JOIN (SELECT optimized_runway, avg(n) AS m FROM (SELECT optimized_runway, count(*) AS n
             FROM asg2 GROUP BY optimized_runway, base_airport, date_trunc('hour', optimized_time)) GROUP BY 1) a ON a.optimized_runway = o.rid)
SELECT avg(schedule_change_minutes) AS average_schedule_change, count(*) AS total_flights_optimized,
  (SELECT average_utilization FROM util) AS average_utilization,
  greatest(0.0, 15 - abs(avg(schedule_change_minutes))) / 15 * 100 AS throughput_improvement_estimate
FROM asg2
"""))
def _asum(spark, d):
    return K.allocation_summary(_asg(spark, d))


@register("allocated_slots_summary")
def _allocated(spark, d):
    """K9 over the slots that K8 really hands out."""
    return K.allocation_summary(K.allocate_runway_slots(_fl(spark, d)))
