"""Registered query-log queries (Q1-Q3) with DuckDB twins."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tarmac.functions import dims
from tarmac.operators import intents as Q
from tarmac.plans.oracle import with_flights
from tarmac.plans.registry import register
from tarmac.sources import fixture


def _sq(s: str) -> str:
    return s.replace("'", "''")


def _w(words) -> str:
    return _sq(r"\b(" + "|".join(re.escape(w) for w in words) + r")\b")


_AP = ", ".join(f"'{a}'" for a in dims.AIRPORTS)
_T = ", ".join(f"'{_sq(t)}'" for t in Q.TEMPLATES)
N = len(Q.TEMPLATES)
LOG = f"""
, ql AS (SELECT event_id AS query_id,
    CASE WHEN event_id % 14 < {N} THEN ([{_T}])[event_id % 14 + 1]
      WHEN event_id % 14 = {N} THEN 'show flights delayed more than ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ' minutes'
      WHEN event_id % 14 = {N + 1} THEN 'delays from ' || ([{_AP}])[CAST(json_extract(props, '$.k') AS INTEGER) % 12 + 1] || ' to '
        || ([{_AP}])[(CAST(json_extract(props, '$.k') AS INTEGER) + 5) % 12 + 1] || ' this morning?'
      WHEN event_id % 14 = {N + 2} THEN 'airline ranking' ELSE '' END AS text
  FROM events),
qn AS (SELECT *, lower(trim(text)) AS q FROM ql)
"""


def _case(pairs, default):
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in pairs) + (f" ELSE '{default}'" if default else "") + " END"


TIMEF = ("CASE " + " ".join(f"WHEN regexp_matches(q, '{_w([ph])}') THEN '{c}'" for ph, c in Q.TIME_PATTERNS.items())
         + r" WHEN regexp_matches(q, '(\d{1,2})(:|\s)?(am|pm|:\d{2})') THEN 'specific_time'"
         + r" WHEN regexp_matches(q, '\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}') THEN 'specific_date' END")
QTY = "CASE " + " ".join(f"WHEN regexp_matches(q, '\\b({p})\\b') THEN '{n}'" for n, p in Q.QUANTITY.items()) + " END"
MODS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(q, '\\b({p})\\b') THEN '{m}' END" for m, p in Q.MODIFIERS.items()) \
    + "], lambda x: x IS NOT NULL)"
AIRL = "list_filter([" + ", ".join(f"'{a}'" for a in Q.AIRLINE_NAMES) + "], lambda a: contains(q, a))"
ACFT = "list_filter([" + ", ".join(f"'{a}'" for a in Q.AIRCRAFT_NAMES) + "], lambda a: contains(q, a))"
APTS = rf"list_filter(regexp_extract_all(upper(q), '\b([A-Z]{{3}})\b', 1), lambda c: c IN ({_AP}))"

def _parsed_sql(intents: dict, entities: dict) -> str:
    action = _case([(f"regexp_matches(q, '{_w(p)}')", n) for n, p in intents.items()]
                   + [(f"regexp_matches(q, '{_w(['how to', 'can you', 'should i'])}')", "optimize")], "show")
    scores = [(n, " + ".join(f"CAST(regexp_matches(q, '{_w([p])}') AS INTEGER)" for p in pats)) for n, pats in entities.items()]
    greatest = ", ".join(f"s_{n}" for n, _ in scores)
    entity = _case([(f"s_{n} = greatest({greatest})", n) for n, _ in scores], None)
    return LOG + f"""
, p1 AS (SELECT *, {action} AS action, {", ".join(f"{sc} AS s_{n}" for n, sc in scores)} FROM qn),
p2 AS (SELECT *, CASE WHEN greatest({greatest}) = 0 THEN 'flights' ELSE {entity} END AS entity FROM p1),
parsed AS (SELECT query_id, text, action, entity, {TIMEF} AS time_filter,
  CASE WHEN len({APTS}) > 0 THEN {APTS} END AS airports, CASE WHEN len({AIRL}) > 0 THEN {AIRL} END AS airlines,
  CASE WHEN len({ACFT}) > 0 THEN {ACFT} END AS aircraft_types,
  CAST(nullif(regexp_extract(q, '(\\d+)\\s*(minute|min|hour|hr)', 1), '') AS INTEGER) AS delay_threshold,
  {QTY} AS quantity, {MODS} AS modifiers,
  least(1.0::DOUBLE, 0.5::DOUBLE
    + CASE WHEN {" OR ".join(f"(action = '{n}' AND regexp_matches(q, '{_w(p)}'))" for n, p in intents.items())} THEN 0.2 ELSE 0.0 END
    + CASE WHEN {" OR ".join(f"(entity = '{n}' AND regexp_matches(q, '{_w(p)}'))" for n, p in entities.items())} THEN 0.2 ELSE 0.0 END
    + CASE WHEN contains(q, '?') THEN 0.1 ELSE 0.0 END) AS confidence
  FROM p2)
"""


PARSED = _parsed_sql(Q.INTENT_PATTERNS, Q.ENTITY_PATTERNS)
PARSED_FULL = _parsed_sql(Q.INTENT_PATTERNS_FULL, Q.ENTITY_PATTERNS_FULL)


def _log(spark, d):
    return Q.query_log_from_events(fixture.read_events(spark, d))


@register("parse_queries", with_flights(PARSED + "SELECT * FROM parsed"))
def _pq(spark, d):
    return Q.parse_queries(_log(spark, d))


@register("parse_queries_full", with_flights(PARSED_FULL + "SELECT * FROM parsed"))
def _pqf(spark, d):
    return Q.parse_queries(_log(spark, d), profile="full")


@register("intent_counts", with_flights(PARSED + """
SELECT action, entity, coalesce(time_filter, '-') AS time_filter, count(*) AS queries, avg(confidence) AS avg_confidence
FROM parsed GROUP BY 1, 2, 3
"""))
def _ic(spark, d):
    p = Q.parse_queries(_log(spark, d))
    return p.groupBy("action", "entity", F.coalesce("time_filter", F.lit("-")).alias("time_filter")).agg(
        F.count(F.lit(1)).alias("queries"), F.avg("confidence").alias("avg_confidence"))


_ROUTE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(text), '{_sq(w)}')" for w in words) + f" THEN '{name}'" for name, words in Q.ROUTES
) + f" ELSE '{Q.DEFAULT_ROUTE}' END"


@register("route_queries", with_flights(LOG + f"SELECT query_id, text, {_ROUTE} AS route FROM ql"))
def _rq(spark, d):
    return Q.route_queries(_log(spark, d))


INTENT_QUERY_ID = N + 1  # "delays from X to Y this morning?"


@register("run_intent", with_flights(PARSED + f"""
, it AS (SELECT * FROM parsed WHERE query_id = {INTENT_QUERY_ID})
SELECT flight_id, airline, runway, scheduled_time, delay_minutes FROM flights, it
WHERE hour BETWEEN 6 AND 11 AND (list_contains(it.airports, substr(origin, 1, 3)) OR list_contains(it.airports, substr(destination, 1, 3)))
  AND delay_minutes > 0
"""))
def _ri(spark, d):
    row = Q.parse_queries(_log(spark, d)).filter(F.col("query_id") == INTENT_QUERY_ID).first()  # one parsed intent
    return Q.run_intent(fixture.flights(spark, d), row.asDict())


AIRLINE_QUERY_ID = N + 2  # "airline ranking": entity 'airlines' under the full keyword profile


@register("run_intent_airlines", with_flights("""
SELECT airline, count(flight_id) AS flight_count, avg(delay_minutes) AS avg_delay, CAST(sum(capacity) AS BIGINT) AS total_passengers
FROM flights GROUP BY airline
"""))
def _ria(spark, d):
    row = Q.parse_queries(_log(spark, d), profile="full").filter(F.col("query_id") == AIRLINE_QUERY_ID).first()
    return Q.run_intent(fixture.flights(spark, d), row.asDict())


# the whole log at once, written over flights one by one
PLANS = """
, plans AS (SELECT *, min(query_id) OVER (PARTITION BY entity, time_filter, airlines, airports, delay_threshold, quantity) AS plan_id FROM parsed),
met AS (
  SELECT p.plan_id, p.entity, p.quantity, f.* FROM (SELECT * FROM plans WHERE query_id = plan_id) p JOIN flights f ON
    (CASE p.time_filter WHEN 'morning' THEN f.hour BETWEEN 6 AND 11 WHEN 'afternoon' THEN f.hour BETWEEN 12 AND 17
       WHEN 'evening' THEN f.hour BETWEEN 18 AND 23 WHEN 'night' THEN f.hour BETWEEN 0 AND 5
       WHEN 'peak_hours' THEN f.hour IN (7, 8, 9, 18, 19, 20) ELSE true END)
    AND (p.airlines IS NULL OR list_contains(p.airlines, lower(f.airline)))
    AND (p.airports IS NULL OR list_contains(p.airports, substr(f.origin, 1, 3)) OR list_contains(p.airports, substr(f.destination, 1, 3)))
    AND (p.delay_threshold IS NULL OR f.delay_minutes > p.delay_threshold)
    AND (p.entity <> 'delays' OR f.delay_minutes > 0))
"""


@register("run_query_log", with_flights(PARSED_FULL + PLANS + """
, grouped AS (
  SELECT plan_id, quantity, CASE entity WHEN 'runways' THEN runway WHEN 'airlines' THEN airline END AS group_key,
    count(flight_id) AS flight_count, avg(delay_minutes) AS avg_delay, CAST(sum(capacity) AS BIGINT) AS total_passengers FROM met GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY CASE quantity WHEN 'most' THEN -avg_delay ELSE avg_delay END, group_key) AS r FROM grouped)
SELECT plans.query_id, plans.plan_id, plans.entity, group_key, flight_count, avg_delay, total_passengers
FROM plans JOIN ranked USING (plan_id) WHERE r <= 10 OR plans.quantity IS NULL OR plans.quantity NOT IN ('most', 'least')
"""))
def _rql(spark, d):
    return Q.run_query_log(fixture.flights(spark, d), Q.parse_queries(_log(spark, d), profile="full"))


@register("run_query_log_top_flights", with_flights(PARSED + PLANS + """
SELECT * FROM (SELECT plan_id, flight_id, airline, runway, scheduled_time, delay_minutes,
  row_number() OVER (PARTITION BY plan_id ORDER BY CASE quantity WHEN 'most' THEN -delay_minutes ELSE delay_minutes END, flight_id) AS rank
  FROM met WHERE entity = 'delays' AND quantity IN ('most', 'least')) WHERE rank <= 10
"""))
def _rqlt(spark, d):
    top = Q.top_flights_of_log(fixture.flights(spark, d), Q.parse_queries(_log(spark, d)))
    return top.withColumn("rank", F.col("rank").cast("long"))
