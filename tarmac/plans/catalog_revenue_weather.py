"""Registered revenue (R*) and weather (X*) queries with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import dims
from tarmac.operators import revenue as R
from tarmac.operators import weather as X
from tarmac.plans.oracle import WEATHER, with_flights
from tarmac.plans.registry import register
from tarmac.sources import fixture

_SLOTS = ", ".join(
    f"({h}, {'CAST(' + str(v[0]) + ' AS DOUBLE)' if i == 0 else v[0]}, {v[1]}, {v[2]}, {v[3]})"
    for i, (h, v) in enumerate(sorted(dims.REVENUE_SLOTS.items()))
)
PRICE = "CASE destination_priority WHEN 'high' THEN 12000.0 WHEN 'medium' THEN 8500.0 WHEN 'normal' THEN 6200.0 END"
PREM = "CASE {p} WHEN 'super_peak' THEN 0.35 WHEN 'peak' THEN 0.20 WHEN 'moderate' THEN 0.05 WHEN 'low' THEN -0.15 END"


def _rev(dm: str, rm: str, br: str, peak: str) -> str:
    final = f"({PRICE} * {rm} * (1 + {PREM.format(p=peak)}))"
    load = f"least(0.95, {dm} * 0.75)"
    return (f"(capacity * {load} * (1 - {br} * 0.15) * {final} + capacity * {load} * ({br} * 0.15) * {final} * 2.8)")


REV = f"""
, slots(hour, dm, rm, wp, br) AS (VALUES {_SLOTS}),
rev AS (SELECT f.*, s.dm, s.rm, s.br, {_rev('s.dm', 's.rm', 's.br', 'peak_category')} AS current_revenue
        FROM flights f JOIN slots s USING (hour))
"""


def _fl(spark, d):
    return fixture.flights(spark, d)


@register("flight_revenue", with_flights(REV + "SELECT flight_id, hour, current_revenue FROM rev"))
def _fr(spark, d):
    return R.flight_revenue(_fl(spark, d)).select("flight_id", "hour", "current_revenue")


def _moves_sql() -> str:
    parts = ["b0 AS (SELECT *, current_revenue AS best_0, CAST(NULL AS INTEGER) AS hr_0 FROM rev)"]
    for i, h in enumerate(R.SUPER_PEAK_TRY):
        dm, rm, _, br = dims.REVENUE_SLOTS[h]
        alt = _rev(str(dm), str(rm), str(br), "'super_peak'")
        parts.append(
            f"b{i + 1} AS (SELECT *, CASE WHEN hour <> {h} AND {alt} > best_{i} * 1.05 THEN {alt} ELSE best_{i} END AS best_{i + 1},"
            f" CASE WHEN hour <> {h} AND {alt} > best_{i} * 1.05 THEN {h} ELSE hr_{i} END AS hr_{i + 1} FROM b{i})"
        )
    n = len(R.SUPER_PEAK_TRY)
    return REV + ", " + ",\n".join(parts) + f"""
SELECT flight_id, hour AS current_hour, hr_{n} AS recommended_hour, current_revenue, best_{n} AS projected_revenue,
  best_{n} - current_revenue AS revenue_increase, (best_{n} - current_revenue) / current_revenue * 100 AS percentage_increase
FROM b{n} WHERE hr_{n} IS NOT NULL"""


@register("revenue_moves", with_flights(_moves_sql()))
def _rm(spark, d):
    return R.revenue_moves(_fl(spark, d))


@register("revenue_multipliers", with_flights(REV + """
SELECT flight_id, CAST(rm AS DOUBLE) AS revenue_per_hour_multiplier, CAST(dm AS DOUBLE) AS demand_multiplier FROM rev
"""))
def _rmu(spark, d):
    return R.revenue_multipliers(_fl(spark, d)).select("flight_id", "revenue_per_hour_multiplier", "demand_multiplier")


@register("hourly_revenue", with_flights(REV + """
SELECT *, total_revenue / flight_count AS revenue_per_flight, total_revenue / total_capacity AS revenue_per_passenger FROM (
  SELECT hour, count(flight_id) AS flight_count, sum(current_revenue) AS total_revenue, avg(current_revenue) AS avg_revenue_per_flight,
    CAST(sum(capacity) AS BIGINT) AS total_capacity FROM rev GROUP BY hour)
"""))
def _hr(spark, d):
    return R.hourly_revenue(_fl(spark, d))


@register("peak_consolidation", with_flights(REV + """
SELECT sp AS current_super_peak_flights, n AS total_flights, sp / n * 100 AS peak_utilization_percentage,
  tot AS current_total_revenue, off * 0.6 * av * (1.6 - 1) AS potential_additional_revenue,
  off * 0.6 * av * (1.6 - 1) / tot * 100 AS revenue_increase_percentage
FROM (SELECT count(*) FILTER (WHERE hour IN (7, 8, 19, 20)) AS sp, count(flight_id) AS n, sum(current_revenue) AS tot,
        avg(current_revenue) AS av, count(*) FILTER (WHERE hour NOT IN (7, 8, 19, 20, 6, 9, 18, 21)) AS off FROM rev)
"""))
def _pc(spark, d):
    return R.peak_consolidation(_fl(spark, d))


NET = """
, nr AS (SELECT flight_id, hour, coalesce(capacity, 150) AS capacity, coalesce(capacity, 150) * 200 AS base_revenue,
    CASE WHEN hour IN (7, 8, 19, 20) THEN 1.4 WHEN hour IN (6, 9, 18, 21) THEN 1.2 ELSE 1.0 END::DOUBLE AS revenue_multiplier,
    delay_minutes * 50 AS delay_cost, delay_minutes FROM flights)
"""


@register("net_revenue_simple", with_flights(NET + """
SELECT flight_id, hour, capacity, base_revenue, revenue_multiplier, delay_cost,
  base_revenue * revenue_multiplier - delay_cost AS net_revenue, delay_minutes FROM nr
"""))
def _nrs(spark, d):
    return R.net_revenue_simple(_fl(spark, d))


@register("net_revenue_summary", with_flights(NET + """
SELECT sum(base_revenue * revenue_multiplier - delay_cost) AS total_revenue, sum(delay_cost) AS total_delay_cost,
  sum(base_revenue) * avg(revenue_multiplier) AS potential_revenue,
  count(*) FILTER (WHERE delay_cost > 1000) AS flights_delay_cost_over_1000 FROM nr
"""))
def _nrsum(spark, d):
    return R.net_revenue_summary(_fl(spark, d))


def _wx(spark, d):
    fl = _fl(spark, d)
    return X.apply_weather(fl, fixture.weather_from_flights(fl))


_DELAYS = " ".join(f"WHEN '{c}' THEN {float(v[7])}" for c, v in dims.WEATHER.items())
APPLY = f"""
, wj AS (
  SELECT f.*, coalesce(w.weather_condition, 'Clear') AS weather_condition,
    coalesce(w.capacity_reduction_factor, 1.0) AS capacity_reduction_factor,
    coalesce(w.landing_restrictions, false) AS landing_restrictions, coalesce(w.takeoff_restrictions, false) AS takeoff_restrictions,
    coalesce(w.crosswind_runway_closure, false) AS crosswind_runway_closure
  FROM (SELECT *, date_trunc('hour', scheduled_time) AS weather_hour FROM flights) f LEFT JOIN weather w USING (weather_hour)),
sens AS (SELECT * FROM (VALUES ('09R/27L', 0.8::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE, 1.1::DOUBLE), ('09L/27R', 0.8, 0.9, 1.0, 1.1),
    ('14/32', 1.3, 1.2, 1.1, 0.9)) t(runway, ws, rs, fs, la)),
r1 AS (SELECT wj.*, CASE WHEN contains(weather_condition, 'Rain') THEN capacity_reduction_factor * (2.0 - coalesce(rs, 1.0))
    WHEN contains(weather_condition, 'Fog') THEN capacity_reduction_factor * (2.0 - coalesce(fs, 1.0))
    WHEN contains(weather_condition, 'Wind') THEN capacity_reduction_factor * (2.0 - coalesce(ws, 1.0))
    ELSE capacity_reduction_factor END AS red0, coalesce(la, 1.0) AS la1 FROM wj LEFT JOIN sens USING (runway)),
wx AS (SELECT *, greatest(CAST(floor(runway_capacity * CASE WHEN red0 < 0.7 THEN red0 * la1 ELSE red0 END) AS INTEGER), 5)
      AS weather_adjusted_runway_capacity,
    CAST(coalesce(CASE weather_condition {_DELAYS} END, 0.0) AS DOUBLE) * 1.0
      * CASE WHEN landing_restrictions OR takeoff_restrictions THEN 1.5 ELSE 1.0 END AS weather_delay_minutes,
    runway = '14/32' AND crosswind_runway_closure AS needs_runway_reassignment FROM r1)
"""


@register("apply_weather", with_flights(APPLY + """
SELECT flight_id, weather_condition, weather_adjusted_runway_capacity, weather_delay_minutes,
  delay_minutes + weather_delay_minutes AS total_delay_minutes, needs_runway_reassignment FROM wx
""", WEATHER))
def _aw(spark, d):
    return _wx(spark, d).select("flight_id", "weather_condition", "weather_adjusted_runway_capacity", "weather_delay_minutes",
                                "total_delay_minutes", "needs_runway_reassignment")


@register("weather_impact_summary", with_flights(APPLY + """
SELECT count(*) AS total_flights, count(*) FILTER (WHERE weather_condition <> 'Clear') AS weather_affected_flights,
  count(*) FILTER (WHERE weather_condition <> 'Clear') / count(*) * 100 AS weather_impact_percentage,
  (1 - avg(capacity_reduction_factor)) * 100 AS avg_capacity_reduction_percentage,
  sum(weather_delay_minutes) AS total_weather_delay_minutes, avg(weather_delay_minutes) AS avg_weather_delay_per_flight,
  count(*) FILTER (WHERE crosswind_runway_closure) AS crosswind_runway_closures,
  count(*) FILTER (WHERE needs_runway_reassignment) AS flights_needing_reassignment FROM wx
""", WEATHER))
def _wis(spark, d):
    return X.weather_impact_summary(_wx(spark, d))


@register("weather_hourly_impact", with_flights(APPLY + """
SELECT hour, avg(weather_delay_minutes) AS avg_weather_delay, avg(capacity_reduction_factor) AS avg_capacity_factor,
  count(*) FILTER (WHERE weather_condition <> 'Clear') AS affected_flights FROM wx GROUP BY hour
""", WEATHER))
def _whi(spark, d):
    return X.weather_hourly_impact(_wx(spark, d))


@register("weather_distribution", with_flights(APPLY + """
SELECT weather_condition, count(*) AS count FROM wx GROUP BY weather_condition
""", WEATHER))
def _wd(spark, d):
    return _wx(spark, d).groupBy("weather_condition").agg(F.count(F.lit(1)).alias("count"))


@register("weather_alerts", with_flights(APPLY + """
SELECT hour, arg_min(weather_condition, (scheduled_time, flight_id)) AS condition, count(*) AS affected_flights,
  (1 - avg(capacity_reduction_factor)) * 100 AS capacity_impact_pct
FROM wx WHERE capacity_reduction_factor < 0.7 GROUP BY hour
""", WEATHER))
def _wa(spark, d):
    return X.weather_alerts(_wx(spark, d))


@register("weather_high_delay_hours", with_flights(APPLY + """
SELECT hour, weather_delay FROM (SELECT hour, sum(weather_delay_minutes) AS weather_delay FROM wx GROUP BY hour)
WHERE weather_delay > (SELECT quantile_cont(weather_delay, 0.8) FROM (SELECT sum(weather_delay_minutes) AS weather_delay FROM wx GROUP BY hour))
""", WEATHER))
def _whd(spark, d):
    return X.weather_high_delay_hours(_wx(spark, d))
