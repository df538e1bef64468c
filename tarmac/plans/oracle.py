"""DuckDB twins of the Spark queries (the independent correctness oracle).

Written by hand from the operator definitions, not generated from the Spark code.
``FLIGHTS`` builds the same flight view from the pre-registered ``events`` view.
"""

from __future__ import annotations

FLIGHTS = """
ev AS (
  SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         CAST(user_id // 150 AS VARCHAR) AS net,
         CAST(user_id % 6 AS INTEGER) + 1 AS ti,
         CAST(event_id % 3 AS INTEGER) + 1 AS ri,
         date_trunc('minute', ts) AS st
  FROM events
),
ev2 AS (
  SELECT *,
    CASE WHEN k % 2 = 1 THEN (['BOM','DEL','BLR','MAA','CCU','HYD','AMD','COK','GOI','PNQ','JAI','LKO'])[k % 12 + 1] || net
         ELSE 'BOM' || net END AS origin,
    CASE WHEN k % 2 = 1 THEN 'BOM' || net
         ELSE (['BOM','DEL','BLR','MAA','CCU','HYD','AMD','COK','GOI','PNQ','JAI','LKO'])[(k + 1) % 12 + 1] || net END AS destination
  FROM ev
),
flights AS (
  SELECT
    'FL' || lpad(CAST(event_id AS VARCHAR), CAST(greatest(7, length(CAST(event_id AS VARCHAR))) AS INTEGER), '0') AS flight_id,
    (['AI','6E','UK','SG','G8','QP','I5','9W','VT','IX'])[user_id % 10 + 1] AS airline,
    'T' || CAST(user_id AS VARCHAR) AS aircraft_id,
    (['A320','B737','A321','B777','A350','B787'])[ti] AS aircraft_type,
    'BOM' || net AS base_airport,
    origin, destination,
    st AS scheduled_time,
    CASE WHEN event_type IN ('error', 'purchase') THEN floor(value) ELSE 0.0 END AS delay_minutes,
    (['09R/27L','09L/27R','14/32'])[ri] AS runway,
    ([35, 32, 28])[ri] AS runway_capacity,
    ([0.85::DOUBLE, 0.90::DOUBLE, 0.80::DOUBLE])[ri] AS runway_efficiency,
    ([180, 160, 220, 300, 280, 250])[ti] AS capacity,
    ([45, 40, 50, 90, 85, 80])[ti] AS base_turnaround,
    CASE substr(destination, 1, 3)
      WHEN 'BOM' THEN 1.8 WHEN 'DEL' THEN 1.9 WHEN 'BLR' THEN 1.6 WHEN 'MAA' THEN 1.4
      WHEN 'CCU' THEN 1.3 WHEN 'HYD' THEN 1.5 WHEN 'AMD' THEN 1.1 WHEN 'COK' THEN 1.2
      WHEN 'GOI' THEN 0.9 WHEN 'PNQ' THEN 1.3 WHEN 'JAI' THEN 1.0 WHEN 'LKO' THEN 1.1 END::DOUBLE AS congestion_factor,
    CASE WHEN substr(destination, 1, 3) IN ('BOM','DEL','BLR') THEN 'high'
         WHEN substr(destination, 1, 3) IN ('MAA','CCU','HYD','PNQ') THEN 'medium'
         ELSE 'normal' END AS destination_priority,
    CASE WHEN hour(st) IN (7,8,9,19,20,21) THEN 'super_peak'
         WHEN hour(st) IN (6,10,18,22) THEN 'peak'
         WHEN hour(st) IN (5,11,12,13,14,17,23) THEN 'moderate'
         ELSE 'low' END AS peak_category,
    CAST(hour(st) AS INTEGER) AS hour,
    CAST(isodow(st) - 1 AS INTEGER) AS day_of_week,
    CAST(st AS DATE) AS date,
    hour(st) IN (6,7,8,9,18,19,20,21) AS is_peak_hour,
    (substr(destination, 1, 3) IN ('BOM','DEL','BLR','MAA','CCU','HYD')
      OR (['A320','B737','A321','B777','A350','B787'])[ti] IN ('B777','A350','B787')
      OR ([180, 160, 220, 300, 280, 250])[ti] > 250) AS is_high_impact,
    user_id % 6 >= 3 AS is_international,
    false AS is_emergency,
    st + to_minutes(CAST(CASE WHEN event_type IN ('error', 'purchase') THEN floor(value) ELSE 0 END AS BIGINT)) AS actual_time
  FROM ev2
)
"""

WEATHER = """
wx_hours AS (
  SELECT DISTINCT date_trunc('hour', scheduled_time) AS weather_hour FROM flights
),
weather AS (
  SELECT weather_hour, c.*
  FROM (
    SELECT weather_hour,
      (['Clear','Light Rain','Moderate Rain','Heavy Rain','Fog','Thunderstorm','Strong Winds','Snow'])
        [(day(weather_hour) * 5 + hour(weather_hour) * 7) % 8 + 1] AS weather_condition
    FROM wx_hours WHERE (day(weather_hour) * 24 + hour(weather_hour)) % 11 <> 0
  ) h JOIN (VALUES
    ('Clear', 10.0::DOUBLE, 5, 0.0::DOUBLE, 1.0::DOUBLE, false, false, false),
    ('Light Rain', 8.0, 8, 2.5, 0.9, false, false, false),
    ('Moderate Rain', 5.0, 12, 7.5, 0.75, true, false, false),
    ('Heavy Rain', 2.0, 15, 15.0, 0.6, true, true, true),
    ('Fog', 0.8, 3, 0.0, 0.5, true, true, false),
    ('Thunderstorm', 3.0, 25, 20.0, 0.3, true, true, true),
    ('Strong Winds', 10.0, 30, 0.0, 0.7, true, false, true),
    ('Snow', 1.5, 10, 8.0, 0.4, true, true, true)
  ) c(weather_condition, visibility_km, wind_speed_kts, precipitation_mm, capacity_reduction_factor,
      landing_restrictions, takeoff_restrictions, crosswind_runway_closure)
  USING (weather_condition)
)
"""


def with_flights(body: str, *ctes: str, recursive: bool = False) -> str:
    """Prefix ``body`` (a SELECT, optionally starting with more CTEs after a comma) with the flight view."""
    parts = [FLIGHTS.strip()] + [c.strip() for c in ctes]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body.strip()
