"""Registered aggregate queries (A*) with their DuckDB twins."""

from __future__ import annotations

from tarmac.operators import aggregates as A
from tarmac.plans.oracle import WEATHER, with_flights
from tarmac.plans.registry import register
from tarmac.sources import fixture


def _fl(spark, d):
    return fixture.flights(spark, d)


def _q(name: str, fn, sql: str | None):
    register(name, sql)(lambda spark, d: fn(_fl(spark, d)))


HOUR_DOW_BASE = """
SELECT hour, day_of_week, count(flight_id) AS flight_count, avg(delay_minutes) AS avg_delay,
  stddev_samp(delay_minutes) AS delay_std, max(delay_minutes) AS max_delay,
  CAST(sum(capacity) AS BIGINT) AS total_passengers, count(DISTINCT runway) AS active_runways
FROM flights GROUP BY hour, day_of_week
"""

_q("flight_view", lambda fl: fl, with_flights("SELECT * FROM flights"))
register("weather_view", with_flights("SELECT * FROM weather", WEATHER))(lambda s, d: fixture.weather(s, d))

_q("hourly_dow_stats", A.hourly_dow_stats, with_flights(f"""
SELECT *, flight_count * 0.4 + avg_delay * 0.3 + flights_per_runway * 0.3 AS congestion_score
FROM (SELECT *, flight_count / active_runways AS flights_per_runway FROM ({HOUR_DOW_BASE}))
"""))

_q("hourly_dow_basic", A.hourly_dow_basic, with_flights(f"""
SELECT *, flight_count * 0.1::DOUBLE AS congestion_score FROM ({HOUR_DOW_BASE})
"""))

_q("peak_hours", A.peak_hours, with_flights("""
SELECT hour, flight_count FROM (
  SELECT hour, count(*) AS flight_count, avg(count(*)) OVER () AS m FROM flights GROUP BY hour)
WHERE flight_count > m * 1.2
"""))

_q("delay_summary", A.delay_summary, with_flights("""
SELECT count(*) AS total_flights,
  count(*) FILTER (WHERE delay_minutes > 0) AS delayed_flights,
  count(*) FILTER (WHERE delay_minutes > 0) * 100.0 / count(*) AS delay_rate,
  avg(delay_minutes) AS avg_delay, max(delay_minutes) AS max_delay,
  quantile_cont(delay_minutes, 0.5) AS median_delay,
  count(*) FILTER (WHERE delay_minutes > 30) AS over_30,
  count(*) FILTER (WHERE delay_minutes > 60) AS over_60
FROM flights
"""))

RUNWAY_UTIL = """
SELECT runway, count(flight_id) AS flight_count, avg(delay_minutes) AS avg_delay,
  CAST(sum(capacity) AS BIGINT) AS total_passengers,
  count(flight_id) * 100.0 / max(count(flight_id)) OVER () AS utilization_score
FROM flights GROUP BY runway
"""
_q("runway_utilization", A.runway_utilization, with_flights(RUNWAY_UTIL))

_q("runway_efficiency", A.runway_efficiency, with_flights("""
SELECT *, flight_count / hours_used AS flights_per_hour, flight_count / (avg_delay + 1) AS efficiency_score FROM (
  SELECT runway, count(flight_id) AS flight_count, avg(delay_minutes) AS avg_delay, sum(delay_minutes) AS total_delay,
    CAST(sum(capacity) AS BIGINT) AS total_passengers, count(DISTINCT hour) AS hours_used
  FROM flights GROUP BY runway)
"""))

_q("runway_delay_table", A.runway_delay_table, with_flights("""
SELECT runway, avg(delay_minutes) AS avg_delay, sum(delay_minutes) AS total_delay, count(delay_minutes) AS delayed_flights,
  count(flight_id) AS total_flights
FROM flights GROUP BY runway
"""))

_q("airline_performance", A.airline_performance, with_flights("""
SELECT *, 85 - avg_delay AS on_time_rate, flight_count / (avg_delay + 1) AS performance_score FROM (
  SELECT airline, count(flight_id) AS flight_count, avg(delay_minutes) AS avg_delay, sum(delay_minutes) AS total_delay,
    stddev_samp(delay_minutes) AS delay_std, CAST(sum(capacity) AS BIGINT) AS total_passengers, avg(capacity) AS avg_capacity
  FROM flights GROUP BY airline)
"""))

_q("airline_compare", A.airline_compare, with_flights("""
, a AS (
  SELECT airline, count(flight_id) AS total_flights, avg(delay_minutes) AS avg_delay, sum(delay_minutes) AS total_delay,
    avg(capacity) AS avg_capacity FROM flights GROUP BY airline),
s AS (SELECT *, (1 / (avg_delay + 1)) * total_flights / max(total_flights) OVER () * 100 AS performance_score FROM a),
b AS (SELECT airline AS best_airline, avg_delay AS bd FROM s ORDER BY performance_score DESC, airline LIMIT 1),
w AS (SELECT airline AS worst_airline, avg_delay AS wd FROM s ORDER BY performance_score ASC, airline LIMIT 1)
SELECT airline, total_flights, avg_delay, total_delay, avg_capacity, performance_score, best_airline, worst_airline,
  wd - bd AS improvement_potential
FROM s, b, w
"""))

_q("airline_delay_rate", A.airline_delay_rate, with_flights("""
SELECT airline, avg(delay_minutes) AS avg_delay, count(delay_minutes) AS delayed_flights, count(flight_id) AS total_flights,
  count(delay_minutes) / count(flight_id) * 100 AS delay_rate FROM flights GROUP BY airline
"""))

_q("congestion_metrics", A.congestion_metrics, with_flights("""
SELECT count(*) FILTER (WHERE peak_category = 'super_peak') AS super_peak_flights,
  count(*) FILTER (WHERE peak_category = 'super_peak') * 100.0 / count(*) AS super_peak_pct,
  avg(congestion_factor) AS avg_congestion,
  avg(CASE WHEN peak_category = 'super_peak' THEN delay_minutes END) AS super_peak_avg_delay,
  avg(runway_efficiency) AS avg_runway_efficiency,
  count(*) FILTER (WHERE congestion_factor > 1.5) AS high_congestion_flights,
  count(*) FILTER (WHERE congestion_factor > 1.5) * 100.0 / count(*) AS high_congestion_pct
FROM flights
"""))

_q("peak_category_breakdown", A.peak_category_breakdown, with_flights("""
SELECT peak_category, count(delay_minutes) AS flight_count, avg(delay_minutes) AS avg_delay,
  sum(delay_minutes) AS total_delay, avg(congestion_factor) AS avg_congestion
FROM flights GROUP BY peak_category
"""))

_q("delay_by_hour", A.delay_by_hour, with_flights("""
SELECT hour, avg(delay_minutes) AS avg_delay, count(*) AS flight_count,
  count(*) FILTER (WHERE delay_minutes > 0) AS delayed_count
FROM flights GROUP BY hour
"""))

_HOURS = ", ".join(f"avg(CASE WHEN hour = {h} THEN delay_minutes END) AS h{h}" for h in range(24))
_q("delay_heatmap", A.delay_heatmap, with_flights(f"""
SELECT day_of_week, dayname(scheduled_time) AS day_name, {_HOURS}
FROM flights GROUP BY day_of_week, dayname(scheduled_time)
"""))

_CH = ", ".join(f"first(CASE WHEN hour = {h} THEN congestion_score END) FILTER (WHERE hour = {h}) AS h{h}" for h in range(24))
_q("congestion_heatmap", A.congestion_heatmap, with_flights(f"""
SELECT day_of_week, {_CH} FROM (
  SELECT *, flight_count * 0.4 + avg_delay * 0.3 + flight_count / active_runways * 0.3 AS congestion_score
  FROM ({HOUR_DOW_BASE})) GROUP BY day_of_week
"""))

_q("best_times", A.best_times, with_flights("""
SELECT *, top_rank <= 5 AS is_top,
  row_number() OVER (ORDER BY performance_score ASC, hour) <= 3 AS is_bottom FROM (
  SELECT *, row_number() OVER (ORDER BY performance_score DESC, hour) AS top_rank FROM (
    SELECT *, (1 / (avg_delay + 1)) * (flight_count / max(flight_count) OVER ()) AS performance_score FROM (
      SELECT hour, count(flight_id) AS flight_count, avg(delay_minutes) AS avg_delay, stddev_samp(delay_minutes) AS delay_std,
        min(delay_minutes) AS min_delay, max(delay_minutes) AS max_delay, CAST(sum(capacity) AS BIGINT) AS total_passengers
      FROM flights GROUP BY hour)))
"""))

_q("optimal_hours_quantile", A.optimal_hours_quantile, with_flights("""
SELECT hour, avg_delay, delay_std, flight_count FROM (
  SELECT *, quantile_cont(avg_delay, 0.3) OVER () AS q FROM (
    SELECT hour, avg(delay_minutes) AS avg_delay, stddev_samp(delay_minutes) AS delay_std, count(flight_id) AS flight_count
    FROM flights GROUP BY hour))
WHERE avg_delay < q AND flight_count >= 5
"""))

_q("busiest_times", A.busiest_times, with_flights("""
SELECT *, top_rank <= 5 AS is_top,
  row_number() OVER (ORDER BY congestion_score ASC, hour) <= 5 AS is_bottom FROM (
  SELECT *, row_number() OVER (ORDER BY congestion_score DESC, hour) AS top_rank FROM (
    SELECT *, flight_count * avg_delay * total_passengers / 10000 AS congestion_score,
      flight_count / runways_used AS traffic_density FROM (
      SELECT hour, count(flight_id) AS flight_count, avg(delay_minutes) AS avg_delay, sum(delay_minutes) AS total_delay,
        CAST(sum(capacity) AS BIGINT) AS total_passengers, count(DISTINCT runway) AS runways_used
      FROM flights GROUP BY hour)))
"""))

_q("peaks_to_avoid", A.peaks_to_avoid, with_flights("""
SELECT hour, flight_count, avg_delay, total_capacity, congestion_score FROM (
  SELECT *, quantile_cont(congestion_score, 0.7) OVER () AS q FROM (
    SELECT hour, count(flight_id) AS flight_count, avg(delay_minutes) AS avg_delay,
      CAST(sum(capacity) AS BIGINT) AS total_capacity, count(flight_id) * avg(delay_minutes) / 100 AS congestion_score
    FROM flights GROUP BY hour))
WHERE congestion_score >= q
"""))

_q("over_under_loaded", A.over_under_loaded, with_flights("""
SELECT hour, avg_delay, flight_count, load_class FROM (
  SELECT *, CASE WHEN flight_count > hi THEN 'overloaded' WHEN flight_count < lo THEN 'underutilized' END AS load_class FROM (
    SELECT *, quantile_cont(flight_count, 0.8) OVER () AS hi, quantile_cont(flight_count, 0.3) OVER () AS lo FROM (
      SELECT hour, avg(delay_minutes) AS avg_delay, count(delay_minutes) AS flight_count FROM flights GROUP BY hour)))
WHERE load_class IS NOT NULL
"""))

_q("capacity_by_hour", A.capacity_by_hour, with_flights("""
SELECT *, first(hour) OVER (ORDER BY operations DESC, hour ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS peak_hour FROM (
  SELECT hour, count(*) AS operations, count(DISTINCT runway) AS runways_used, CAST(sum(capacity) AS BIGINT) AS passengers,
    count(*) / count(DISTINCT runway) AS ops_per_runway
  FROM flights GROUP BY hour)
"""))

_q("hourly_forecast", A.hourly_forecast, with_flights("""
SELECT g.hour,
  coalesce(h.m, 10.0) AS predicted_delay,
  CAST(CASE WHEN h.n IS NULL THEN 50 ELSE least(95, h.n * 5) END AS BIGINT) AS confidence,
  CASE WHEN coalesce(h.m, 10.0) > 25 THEN 'High' WHEN coalesce(h.m, 10.0) > 15 THEN 'Medium' ELSE 'Low' END AS risk_level,
  CASE WHEN h.n IS NULL THEN 5.0 ELSE h.s END AS variance
FROM (SELECT CAST(range AS INTEGER) AS hour FROM range(24)) g
LEFT JOIN (SELECT hour, avg(delay_minutes) AS m, stddev_samp(delay_minutes) AS s, count(delay_minutes) AS n
           FROM flights GROUP BY hour) h USING (hour)
"""))

_q("weekly_risk_grid", A.weekly_risk_grid, with_flights("""
SELECT date, hour, r AS delay_risk,
  CASE WHEN r >= 70 THEN 'Critical' WHEN r >= 50 THEN 'High' WHEN r >= 30 THEN 'Medium' ELSE 'Low' END AS risk_level,
  expected_flights, expected_avg_delay FROM (
  SELECT d.date, h.hour, h.expected_flights, h.expected_avg_delay,
    least(h.expected_avg_delay * 0.8 + h.expected_flights * 0.3, 100.0)
      * CASE WHEN isodow(d.date) IN (1, 5) THEN 1.2 WHEN isodow(d.date) IN (6, 7) THEN 0.8 ELSE 1.0 END
      * CASE WHEN h.hour IN (7, 8, 19, 20) THEN 1.4 WHEN h.hour IN (11, 12, 13, 14) THEN 1.1 ELSE 1.0 END AS r
  FROM (SELECT CAST(DATE '2024-02-01' + CAST(range AS INTEGER) AS DATE) AS date FROM range(7)) d
  CROSS JOIN (SELECT hour, avg(delay_minutes) AS expected_avg_delay, count(*) AS expected_flights
              FROM flights WHERE hour BETWEEN 6 AND 22 GROUP BY hour) h)
"""))

_q("schedule_tuning", A.schedule_tuning, with_flights("""
, h AS (SELECT hour, count(flight_id) AS current_flights, avg(delay_minutes) AS current_delay FROM flights GROUP BY hour),
t AS (SELECT min(hour) AS recommended_hour FROM h WHERE current_delay < 15)
SELECT hour AS original_hour, recommended_hour, CAST(least(current_flights // 3, 10) AS BIGINT) AS flights_to_move,
  current_delay, current_delay * 0.7 AS projected_delay, current_delay - current_delay * 0.7 AS delay_reduction,
  least(current_flights // 3, 10) * (current_delay - current_delay * 0.7) AS impact_score
FROM h, t WHERE current_delay > 20 AND recommended_hour IS NOT NULL
"""))

_q("redistribution_potential", A.redistribution_potential, with_flights(f"""
SELECT *, CASE WHEN overused_runways > 0 AND underused_runways > 0
  THEN least(overused_flights * 0.2::DOUBLE, underused_flights * 0.5::DOUBLE) END AS potential_redistribution FROM (
  SELECT CAST(sum(CASE WHEN utilization_score > 80 THEN flight_count END) AS BIGINT) AS overused_flights,
    CAST(sum(CASE WHEN utilization_score < 50 THEN flight_count END) AS BIGINT) AS underused_flights,
    count(*) FILTER (WHERE utilization_score > 80) AS overused_runways,
    count(*) FILTER (WHERE utilization_score < 50) AS underused_runways
  FROM ({RUNWAY_UTIL}))
"""))

_q("system_overview", A.system_overview, with_flights("""
SELECT * FROM (
  SELECT count(*) AS total_flights, avg(delay_minutes) AS avg_delay, count(DISTINCT airline) AS total_airlines,
    count(DISTINCT runway) AS total_runways, count(*) FILTER (WHERE delay_minutes > 0) * 100.0 / count(*) AS delay_rate
  FROM flights),
  (SELECT runway AS busiest_runway FROM flights GROUP BY runway ORDER BY count(*) DESC, runway LIMIT 1),
  (SELECT airline AS busiest_airline FROM flights GROUP BY airline ORDER BY count(*) DESC, airline LIMIT 1),
  (SELECT hour AS busiest_hour FROM flights GROUP BY hour ORDER BY count(*) DESC, hour LIMIT 1)
"""))

_q("delay_breakdown", A.delay_breakdown, with_flights("""
, c AS (SELECT count(*) AS n,
    count(*) FILTER (WHERE delay_minutes > 0 AND delay_minutes <= 15) AS minor,
    count(*) FILTER (WHERE delay_minutes > 15 AND delay_minutes <= 30) AS moderate,
    count(*) FILTER (WHERE delay_minutes > 30) AS major FROM flights),
h AS (SELECT hour, avg(delay_minutes) AS m FROM flights GROUP BY hour),
e AS (SELECT (SELECT hour FROM h ORDER BY m DESC, hour LIMIT 1) AS worst_hour,
             (SELECT hour FROM h ORDER BY m ASC, hour LIMIT 1) AS best_hour)
SELECT delay_category, flight_count, flight_count * 100.0 / n AS percentage, worst_hour, best_hour FROM (
  SELECT 'Minor (1-15 min)' AS delay_category, minor AS flight_count, n FROM c
  UNION ALL SELECT 'Moderate (16-30 min)', moderate, n FROM c
  UNION ALL SELECT 'Major (>30 min)', major, n FROM c), e
"""))

_DESC_COLS = ["delay_minutes", "capacity", "congestion_factor", "runway_efficiency"]
_q("describe_numeric", A.describe_numeric, with_flights(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std,
    min(CAST({c} AS DOUBLE)) AS min, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS p25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS p50,
    quantile_cont(CAST({c} AS DOUBLE), 0.75) AS p75, max(CAST({c} AS DOUBLE)) AS max FROM flights"""
    for c in _DESC_COLS)))

_q("operating_cost", A.operating_cost, with_flights("""
SELECT sum(delay_minutes) AS total_delay_minutes, sum(delay_minutes) * 1000 AS delay_cost, sum(delay_minutes) * 50 AS fuel_waste_l,
  sum(delay_minutes) * 200 AS crew_cost, sum(delay_minutes) * 500 AS cost_500_per_min, sum(delay_minutes) * 100 AS cost_100_per_min
FROM flights
"""))

_q("fleet_utilization", A.fleet_utilization, with_flights("""
SELECT *, daily_flights * avg_capacity / (avg_delay + 1) AS utilization_score FROM (
  SELECT aircraft_id, count(flight_id) AS daily_flights, avg(delay_minutes) AS avg_delay, avg(capacity) AS avg_capacity
  FROM flights GROUP BY aircraft_id)
ORDER BY utilization_score DESC, aircraft_id LIMIT 10
"""))

_q("aircraft_impact", A.aircraft_impact, with_flights("""
SELECT *, mean_delay * flight_count / 100 AS impact_score FROM (
  SELECT aircraft_id, avg(delay_minutes) AS mean_delay, count(delay_minutes) AS flight_count,
    coalesce(stddev_samp(delay_minutes), 0.0) AS std_delay
  FROM flights GROUP BY aircraft_id)
ORDER BY impact_score DESC, aircraft_id LIMIT 10
"""))

_q("disruptive_flights", A.disruptive_flights, with_flights("""
SELECT flight_id, sum(delay_minutes) AS total_delay, arg_min(aircraft_id, scheduled_time) AS aircraft_id,
  arg_min(airline, scheduled_time) AS airline
FROM flights WHERE delay_minutes > 30 GROUP BY flight_id
ORDER BY total_delay DESC, flight_id LIMIT 10
"""))

_q("on_time_metrics", A.on_time_metrics, with_flights("""
SELECT * FROM (
  SELECT count(*) AS total_ops, count(*) FILTER (WHERE delay_minutes <= 15) * 100.0 / count(*) AS on_time_rate,
    count(*) FILTER (WHERE delay_minutes > 60) * 100.0 / count(*) AS severe_delay_rate,
    avg(delay_minutes) AS avg_turnaround_delay, count(*) / count(DISTINCT runway) AS ops_per_runway FROM flights),
  (SELECT max(m) AS worst_hourly_avg_delay FROM (SELECT avg(delay_minutes) AS m FROM flights GROUP BY hour)),
  (SELECT avg(c) AS mean_flights_per_runway, max(c) AS max_flights_per_runway FROM (
     SELECT count(aircraft_type) AS c FROM flights GROUP BY runway))
"""))

_q("delay_patterns", A.delay_patterns, with_flights("""
, h AS (SELECT hour, avg(delay_minutes) AS m FROM flights GROUP BY hour),
a AS (SELECT airline, avg(delay_minutes) AS m FROM flights GROUP BY airline),
d AS (SELECT date, avg(delay_minutes) AS m FROM flights GROUP BY date)
SELECT (SELECT hour FROM h ORDER BY m, hour LIMIT 1) AS best_hour,
  (SELECT hour FROM h ORDER BY m DESC, hour LIMIT 1) AS worst_hour,
  (SELECT airline FROM a ORDER BY m, airline LIMIT 1) AS best_airline,
  (SELECT airline FROM a ORDER BY m DESC, airline LIMIT 1) AS worst_airline,
  (SELECT avg(m) FROM (SELECT m FROM d ORDER BY date DESC LIMIT 3)) AS recent_avg_delay
"""))

_q("operational_issues", A.operational_issues, with_flights("""
, o AS (SELECT count(*) FILTER (WHERE delay_minutes > 15) / count(*) AS late_rate,
    count(*) FILTER (WHERE delay_minutes > 120) AS extreme FROM flights),
r AS (SELECT max(c) AS rw_max, avg(c) AS rw_mean FROM (SELECT count(*) AS c FROM flights GROUP BY runway))
SELECT 'high_delay_rate' AS issue, CAST(late_rate AS DOUBLE) AS value FROM o WHERE late_rate > 0.3
UNION ALL SELECT 'runway_imbalance', CAST(rw_max AS DOUBLE) FROM r WHERE rw_max > rw_mean * 2
UNION ALL SELECT 'extreme_delays', CAST(extreme AS DOUBLE) FROM o WHERE extreme > 0
"""))

_q("rule_recommendations", A.rule_recommendations, with_flights(f"""
, o AS (SELECT avg(delay_minutes) AS avg_delay,
    count(*) FILTER (WHERE delay_minutes > 0) * 100.0 / count(*) AS delay_rate FROM flights),
r AS (SELECT stddev_samp(c) AS rw_std, avg(c) AS rw_mean FROM (SELECT count(flight_id) AS c FROM flights GROUP BY runway)),
hh AS (SELECT hour, count(flight_id) AS c FROM flights GROUP BY hour),
h AS (SELECT max(c) AS h_max, avg(c) AS h_mean, (SELECT hour FROM hh ORDER BY c DESC, hour LIMIT 1) AS peak_hour FROM hh),
u AS (SELECT count(*) FILTER (WHERE utilization_score > 80) AS overutilized FROM ({RUNWAY_UTIL})),
x AS (SELECT * FROM o, r, h, u)
SELECT 1 AS rule_no, CASE WHEN avg_delay > 20 THEN 'HIGH_PRIORITY' WHEN avg_delay > 10 THEN 'MEDIUM_PRIORITY'
  ELSE 'MAINTENANCE' END AS recommendation FROM x
UNION ALL SELECT 2, 'balance_runways' FROM x WHERE rw_std > rw_mean * 0.3
UNION ALL SELECT 3, 'redistribute_from_hour_' || CAST(peak_hour AS VARCHAR) FROM x WHERE h_max > h_mean * 1.5
UNION ALL SELECT 4, 'increase_buffer_times' FROM x WHERE delay_rate > 30
UNION ALL SELECT 5, 'high_runway_utilization' FROM x WHERE overutilized > 0
"""))

_q("slot_comparison", A.slot_comparison, with_flights("""
SELECT CASE WHEN hour < 9 THEN '6AM - 9AM' ELSE '9AM - 12PM' END AS time_slot, count(*) AS flights,
  avg(delay_minutes) AS avg_delay, quantile_cont(delay_minutes, 0.5) AS median_delay,
  count(*) FILTER (WHERE delay_minutes <= 5) * 100.0 / count(*) AS on_time_rate,
  count(*) FILTER (WHERE delay_minutes > 15) AS delayed_over_15, stddev_samp(delay_minutes) AS delay_std
FROM flights GROUP BY 1
"""))

_q("route_analysis", A.route_analysis, with_flights("""
SELECT destination, count(*) AS flights, avg(delay_minutes) AS avg_delay,
  count(*) FILTER (WHERE delay_minutes <= 5) * 100.0 / count(*) AS on_time_pct,
  count(*) FILTER (WHERE delay_minutes > 15) AS major_delays, stddev_samp(delay_minutes) AS delay_std
FROM flights WHERE destination IN (
  SELECT destination FROM flights GROUP BY destination ORDER BY count(*) DESC, destination LIMIT 8)
GROUP BY destination
"""))

HOURLY_CONG = """
SELECT *, flight_count * avg_delay AS congestion_score FROM (
  SELECT hour, count(*) AS flight_count, avg(delay_minutes) AS avg_delay, stddev_samp(delay_minutes) AS delay_std
  FROM flights GROUP BY hour)
"""
_q("hourly_congestion", A.hourly_congestion, with_flights(HOURLY_CONG))

_q("hour_performance", A.hour_performance, with_flights(f"""
SELECT *, CAST(floor(sum(CASE WHEN is_worst THEN flight_count END) OVER () * 0.2) AS BIGINT) AS redistribute_count FROM (
  SELECT *, rank <= 3 AS is_best,
    row_number() OVER (ORDER BY performance_score ASC NULLS FIRST, hour DESC) <= 2 AS is_worst FROM (
    SELECT *, row_number() OVER (ORDER BY performance_score DESC NULLS LAST, hour) AS rank FROM (
      SELECT *, 50 / (avg_delay + 1) + 30 / (delay_std + 1) + 20 / (congestion_score + 1) AS performance_score
      FROM ({HOURLY_CONG}))))
"""))

_q("cost_potential", A.cost_potential, with_flights("""
SELECT *, (worst3_avg - best3_avg) * worst3_flights AS potential_minutes_saved FROM (
  SELECT avg(CASE WHEN hi <= 3 THEN m END) AS worst3_avg, avg(CASE WHEN lo <= 3 THEN m END) AS best3_avg,
    CAST(sum(CASE WHEN hi <= 3 THEN n END) AS BIGINT) AS worst3_flights FROM (
    SELECT *, row_number() OVER (ORDER BY m DESC, hour) AS hi, row_number() OVER (ORDER BY m ASC, hour) AS lo FROM (
      SELECT hour, avg(delay_minutes) AS m, count(*) AS n FROM flights GROUP BY hour)))
"""))

_q("delay_histogram", lambda fl: A.histogram(fl, "delay_minutes", 20), with_flights("""
, r AS (SELECT min(delay_minutes) AS lo, max(delay_minutes) AS hi FROM flights),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((delay_minutes - lo) / ((hi - lo) / 20)), 19) END AS INTEGER) AS bin,
        lo, hi FROM flights, r WHERE delay_minutes IS NOT NULL)
SELECT bin, lo + bin * ((hi - lo) / 20) AS bin_start, lo + (bin + 1) * ((hi - lo) / 20) AS bin_end, count(*) AS count
FROM b GROUP BY bin, lo, hi
"""))

_q("value_counts_airline", lambda fl: A.value_counts(fl, "airline"), with_flights("""
SELECT airline, count(*) AS count FROM flights GROUP BY airline
"""))

_q("value_counts_delay_category", A.delay_categories, with_flights("""
SELECT CASE WHEN delay_minutes IS NULL THEN NULL WHEN delay_minutes <= 0 THEN 'On_Time' WHEN delay_minutes <= 15 THEN 'Minor'
  WHEN delay_minutes <= 30 THEN 'Moderate' WHEN delay_minutes <= 60 THEN 'Major' ELSE 'Severe' END AS delay_category,
  count(*) AS flights
FROM flights GROUP BY 1
"""))

_q("route_delay_top", A.route_delay_top, with_flights("""
SELECT origin, destination, avg(delay_minutes) AS avg_delay, count(*) AS flights
FROM flights GROUP BY origin, destination ORDER BY avg_delay DESC, origin, destination LIMIT 5
"""))

_q("business_leisure_split", A.business_leisure_split, with_flights("""
SELECT count(*) FILTER (WHERE hour IN (7,8,9,18,19,20)) AS business_flights,
  count(*) FILTER (WHERE hour IN (10,11,12,13,14,15,16,17)) AS leisure_flights,
  count(*) FILTER (WHERE hour IN (7,8,9,18,19,20)) * avg(CASE WHEN hour IN (7,8,9,18,19,20) THEN capacity END) * 1.5
    AS business_revenue_potential,
  count(*) FILTER (WHERE hour IN (10,11,12,13,14,15,16,17)) * avg(CASE WHEN hour IN (10,11,12,13,14,15,16,17) THEN capacity END) * 1.0
    AS leisure_revenue_potential
FROM flights
"""))

_q("hourly_peak_mode", A.hourly_peak_mode, with_flights("""
, s AS (SELECT hour, avg(c) AS avg_flights, avg(m) AS avg_delay FROM (
    SELECT date, hour, count(*) AS c, avg(delay_minutes) AS m FROM flights GROUP BY date, hour) GROUP BY hour),
l AS (SELECT hour, peak_category, count(*) AS n FROM flights GROUP BY hour, peak_category),
md AS (SELECT hour, peak_category AS mode_category FROM (
    SELECT *, row_number() OVER (PARTITION BY hour ORDER BY n DESC, peak_category) AS r FROM l) WHERE r = 1)
SELECT s.hour, avg_flights, avg_delay, mode_category FROM s JOIN md USING (hour)
"""))

_q("reschedule_hour", A.reschedule_hour, with_flights("""
, h AS (SELECT hour, avg(delay_minutes) AS avg_delay, count(*) AS flight_count FROM flights GROUP BY hour)
SELECT t.*, s.source_flights, s.source_avg_delay, CAST(s.source_flights // 3 AS BIGINT) AS flights_to_receive
FROM (SELECT * FROM h WHERE hour <> 21 ORDER BY avg_delay, hour LIMIT 3) t,
     (SELECT flight_count AS source_flights, avg_delay AS source_avg_delay FROM h WHERE hour = 21) s
"""))

_q("ops_cube", A.ops_cube, with_flights("""
SELECT hour, runway, airline, count(*) AS flights, avg(delay_minutes) AS avg_delay,
  CAST(grouping(hour, runway, airline) AS BIGINT) AS gid
FROM flights GROUP BY CUBE (hour, runway, airline)
"""))

_q("optimal_hours_quantile_min10", lambda fl: A.optimal_hours_quantile(fl, 0.3, 10), with_flights("""
SELECT hour, avg_delay, delay_std, flight_count FROM (
  SELECT *, quantile_cont(avg_delay, 0.3) OVER () AS q FROM (
    SELECT hour, avg(delay_minutes) AS avg_delay, stddev_samp(delay_minutes) AS delay_std, count(flight_id) AS flight_count
    FROM flights GROUP BY hour))
WHERE avg_delay < q AND flight_count >= 10
"""))

_q("hour_redistribution", A.hour_redistribution, with_flights("""
SELECT *, (peak_mean_flights - off_peak_mean_flights) * 0.15 AS flights_to_move FROM (
  SELECT avg(CASE WHEN hi <= 3 THEN c END) AS peak_mean_flights, avg(CASE WHEN lo <= 3 THEN c END) AS off_peak_mean_flights FROM (
    SELECT *, row_number() OVER (ORDER BY c DESC, hour) AS hi, row_number() OVER (ORDER BY c ASC, hour) AS lo FROM (
      SELECT hour, count(flight_id) AS c FROM flights GROUP BY hour)))
"""))
