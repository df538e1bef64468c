"""Registered delay-graph queries (W1, W2, J5, J6, G1-G8, G12, G14) with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import graph as G
from tarmac.plans.oracle import with_flights
from tarmac.plans.registry import register
from tarmac.session import cut_lineage, stored
from tarmac.sources import fixture

EDGE_CTES = """
, seq_ac AS (
  SELECT flight_id, scheduled_time, origin, destination,
    lead(flight_id) OVER w AS next_id, lead(scheduled_time) OVER w AS next_time, lead(origin) OVER w AS next_origin
  FROM flights WINDOW w AS (PARTITION BY aircraft_id ORDER BY scheduled_time, flight_id)),
e_aircraft AS (
  SELECT flight_id AS src, next_id AS dst, 'aircraft' AS connection_type,
    CAST(CASE WHEN b < 60 THEN 0.9 WHEN b < 120 THEN 0.7 WHEN b < 180 THEN 0.4 ELSE 0.1 END AS DOUBLE) AS propagation_factor,
    b AS time_buffer
  FROM (SELECT *, epoch(next_time - scheduled_time) / 60.0 AS b FROM seq_ac
        WHERE next_id IS NOT NULL AND destination = next_origin)),
seq_cr AS (
  SELECT flight_id, scheduled_time, lead(flight_id) OVER w AS next_id, lead(scheduled_time) OVER w AS next_time
  FROM flights WINDOW w AS (PARTITION BY base_airport, airline ORDER BY scheduled_time, flight_id)),
e_crew AS (
  SELECT flight_id AS src, next_id AS dst, 'crew' AS connection_type, 0.3::DOUBLE AS propagation_factor, b AS time_buffer
  FROM (SELECT *, epoch(next_time - scheduled_time) / 60.0 AS b FROM seq_cr WHERE next_id IS NOT NULL)
  WHERE b >= 90 AND b <= 480),
slots AS (
  SELECT flight_id, scheduled_time, runway, base_airport,
    date_trunc('hour', scheduled_time) + CASE WHEN minute(scheduled_time) >= 30 THEN INTERVAL 30 MINUTE ELSE INTERVAL 0 MINUTE END AS slot
  FROM flights),
e_runway AS (
  SELECT a.flight_id AS src, b.flight_id AS dst, 'runway' AS connection_type, 0.6::DOUBLE AS propagation_factor,
    epoch(b.scheduled_time - a.scheduled_time) / 60.0 AS time_buffer
  FROM slots a JOIN slots b ON a.base_airport = b.base_airport AND a.runway = b.runway AND a.slot = b.slot
    AND (a.scheduled_time < b.scheduled_time OR (a.scheduled_time = b.scheduled_time AND a.flight_id < b.flight_id))
  WHERE epoch(b.scheduled_time - a.scheduled_time) / 60.0 <= 30),
hubs AS (
  SELECT destination AS airport FROM flights GROUP BY destination HAVING count(*) >= 10
  UNION SELECT origin FROM flights GROUP BY origin HAVING count(*) >= 10),
e_passenger AS (
  SELECT a.flight_id AS src, d.flight_id AS dst, 'passenger' AS connection_type, 0.2::DOUBLE AS propagation_factor,
    epoch(d.scheduled_time - a.scheduled_time) / 60.0 AS time_buffer
  FROM flights a JOIN flights d ON a.destination = d.origin
  WHERE a.destination IN (SELECT airport FROM hubs)
    AND epoch(d.scheduled_time - a.scheduled_time) / 60.0 BETWEEN 45 AND 240),
e_all AS (
  SELECT *, 1 AS r FROM e_aircraft UNION ALL SELECT *, 2 FROM e_crew
  UNION ALL SELECT *, 3 FROM e_runway UNION ALL SELECT *, 4 FROM e_passenger),
edges AS (
  SELECT src, dst, connection_type, propagation_factor, time_buffer FROM (
    SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY r DESC) AS rn FROM e_all) WHERE rn = 1)
"""


def _fl(spark, d):
    return fixture.flights(spark, d)


for _name, _fn in [("aircraft", G.aircraft_edges), ("crew", G.crew_edges), ("runway", G.runway_edges),
                   ("passenger", G.passenger_edges)]:
    register(f"{_name}_edges", with_flights(EDGE_CTES + f"SELECT * FROM e_{_name}"))(
        (lambda fn: lambda spark, d: fn(_fl(spark, d)))(_fn)
    )


@register("hub_airports", with_flights(EDGE_CTES + "SELECT airport FROM hubs"))
def _hubs(spark, d):
    return G.hub_airports(_fl(spark, d))


@register("build_edges", with_flights(EDGE_CTES + "SELECT * FROM edges"))
def _edges(spark, d):
    return G.build_edges(_fl(spark, d))


@register("edge_type_counts", with_flights(EDGE_CTES + """
SELECT connection_type, count(*) AS edges, avg(time_buffer) AS avg_buffer FROM edges GROUP BY connection_type
"""))
def _etc(spark, d):
    return G.build_edges(_fl(spark, d)).groupBy("connection_type").agg(
        F.count(F.lit(1)).alias("edges"), F.avg("time_buffer").alias("avg_buffer"))


def initial_delays(fl):
    """Given input of the cascade: flights with more than 100 delay minutes start delayed by that amount."""
    return fl.filter(F.col("delay_minutes") > 100).select("flight_id", F.col("delay_minutes").alias("delay"))


def _round(prev: str, name: str) -> str:
    return f""", {name} AS (
  SELECT c.flight_id, c.delay + coalesce(m.p, 0.0) AS delay FROM {prev} c LEFT JOIN (
    SELECT dst AS flight_id, max(p) AS p FROM (
      SELECT e.dst, CASE WHEN e.time_buffer > s.delay * e.propagation_factor
        THEN greatest(0.0, s.delay * e.propagation_factor - e.time_buffer * 0.1)
        ELSE s.delay * e.propagation_factor END AS p
      FROM {prev} s JOIN edges e ON e.src = s.flight_id WHERE s.delay > 0) WHERE p > 0 GROUP BY dst) m USING (flight_id))
"""


CASCADE = EDGE_CTES + """
, init AS (SELECT flight_id, delay_minutes AS delay FROM flights WHERE delay_minutes > 100),
r0 AS (SELECT f.flight_id, coalesce(i.delay, 0.0) AS delay FROM flights f LEFT JOIN init i USING (flight_id))
""" + "".join(_round(f"r{i}", f"r{i + 1}") for i in range(5))


def _cascade(spark, d):
    fl = _fl(spark, d)
    return G.simulate_cascade(fl.select("flight_id"), G.build_edges(fl), initial_delays(fl))


register("simulate_cascade", with_flights(CASCADE + "SELECT * FROM r5"))(_cascade)


@register("cascade_impact", with_flights(CASCADE + """
SELECT *, CASE WHEN initial_delay_minutes > 0 THEN total_propagated_delay / initial_delay_minutes ELSE 0.0 END AS amplification_factor
FROM (
  SELECT sum(r.delay) AS total_propagated_delay, count(*) FILTER (WHERE r.delay > 0) AS affected_flights_count,
    count(*) FILTER (WHERE r.delay > 0 AND r.delay <= 15) AS minor,
    count(*) FILTER (WHERE r.delay > 15 AND r.delay <= 30) AS moderate,
    count(*) FILTER (WHERE r.delay > 30) AS severe,
    sum(CASE WHEN r.delay > 0 THEN f.capacity * r.delay END) / 60 AS estimated_passenger_delay_hours
  FROM r5 r LEFT JOIN flights f USING (flight_id)), (SELECT sum(delay) AS initial_delay_minutes FROM init)
"""))
def _impact(spark, d):
    fl = G.numbered(_fl(spark, d).select("flight_id", "airline", "aircraft_id", "base_airport", "origin", "destination", "scheduled_time",
                                         "delay_minutes", "runway", "capacity"))
    init = initial_delays(fl)
    final = G.simulate_cascade(fl.select("flight_id"), G.build_edges(fl), init)
    return G.cascade_impact(final, init, fl)


DEGREES = """
, deg AS (
  SELECT f.flight_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM flights f
  LEFT JOIN (SELECT dst AS flight_id, count(*) AS n FROM edges GROUP BY dst) i USING (flight_id)
  LEFT JOIN (SELECT src AS flight_id, count(*) AS n FROM edges GROUP BY src) o USING (flight_id))
"""


@register("degrees", with_flights(EDGE_CTES + DEGREES + "SELECT * FROM deg"))
def _deg(spark, d):
    fl = _fl(spark, d)
    return G.degrees(fl, G.build_edges(fl))


@register("network_metrics", with_flights(EDGE_CTES + """
, und AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges),
dg AS (SELECT x, count(*) AS k FROM (SELECT u AS x FROM und UNION ALL SELECT v FROM und) GROUP BY x),
ori AS (
  SELECT CASE WHEN du.k < dv.k OR (du.k = dv.k AND und.u < und.v) THEN und.u ELSE und.v END AS a,
         CASE WHEN du.k < dv.k OR (du.k = dv.k AND und.u < und.v) THEN und.v ELSE und.u END AS b
  FROM und JOIN dg du ON du.x = und.u JOIN dg dv ON dv.x = und.v),
tri AS (SELECT ab.a, ab.b, ac.b AS c FROM ori ab JOIN ori ac ON ab.a = ac.a AND ab.b <> ac.b
        JOIN ori bc ON bc.a = ab.b AND bc.b = ac.b),
pn AS (SELECT x, count(*) AS t FROM (SELECT a AS x FROM tri UNION ALL SELECT b FROM tri UNION ALL SELECT c FROM tri) GROUP BY x),
cc AS (SELECT CASE WHEN k >= 2 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0.0 END AS c FROM dg LEFT JOIN pn USING (x)),
n AS (SELECT count(*) AS total_nodes FROM flights),
m AS (SELECT count(*) AS total_edges FROM edges)
SELECT total_nodes, total_edges, total_edges / (total_nodes * (total_nodes - 1)) AS density,
  coalesce((SELECT sum(c) FROM cc), 0.0) / total_nodes AS avg_clustering
FROM n, m
"""))
def _nm(spark, d):
    fl = _fl(spark, d)
    return G.network_metrics(fl, G.build_edges(G.numbered(fl), keep_all=True))  # pairs of several families are merged there


@register("impact_score_basic", with_flights("""
, s AS (SELECT flight_id, airline, delay_minutes, capacity, hour,
    (delay_minutes / 60 + coalesce(capacity, 150) / 300
     + CASE WHEN hour IN (7, 8, 18, 19, 20) THEN 1.5 WHEN hour IN (22, 23, 0, 1, 2, 3, 4, 5) THEN 0.5 ELSE 1.0 END
     + CASE WHEN aircraft_type IS NULL THEN 1.0
            WHEN upper(aircraft_type) SIMILAR TO '.*(A330|A350|B777|B787).*' THEN 1.3
            WHEN upper(aircraft_type) SIMILAR TO '.*(ATR|Q400).*' THEN 0.8 ELSE 1.0 END) / 4 AS impact_score
  FROM flights)
SELECT * FROM (SELECT * FROM s ORDER BY impact_score DESC, flight_id LIMIT 10),
  (SELECT count(*) FILTER (WHERE impact_score > 1.0) AS high_impact_count,
          count(*) FILTER (WHERE impact_score > 0.7 AND impact_score <= 1.0) AS medium_impact_count,
          sum(impact_score) AS total_cascade_risk FROM s)
"""))
def _isb(spark, d):
    return G.impact_summary(G.impact_score_basic(_fl(spark, d)))


@register("pagerank")
def _pr(spark, d):
    fl = _fl(spark, d)
    return G.pagerank(fl.select("flight_id"), G.build_edges(fl))


@register("betweenness")
def _btw(spark, d):
    """Estimated from 64 pivots: exact betweenness of a graph with a giant component costs V x E."""
    from tarmac.operators.centrality import betweenness

    fl = _fl(spark, d)
    return betweenness(fl.select("flight_id"), G.build_edges(fl), sources=64)


@register("betweenness_rotations", with_flights(EDGE_CTES + """
, step AS (SELECT f.aircraft_id, f.flight_id, f.scheduled_time, (e.src IS NULL)::INT AS starts FROM flights f LEFT JOIN e_aircraft e ON e.dst = f.flight_id),
chain AS (SELECT flight_id, aircraft_id, sum(starts) OVER (PARTITION BY aircraft_id ORDER BY scheduled_time, flight_id) AS c, scheduled_time FROM step),
place AS (SELECT flight_id, row_number() OVER (PARTITION BY aircraft_id, c ORDER BY scheduled_time, flight_id) - 1 AS before,
  count(*) OVER (PARTITION BY aircraft_id, c) AS n FROM chain),
t AS (SELECT count(*) AS v FROM flights)
SELECT flight_id, (before * (n - 1 - before))::DOUBLE / ((v - 1.0) * (v - 2.0)) AS betweenness FROM place, t
"""))
def _btw_rotations(spark, d):
    """Exact betweenness of the aircraft rotations, whose components are chains: a flight with i before and
    j behind it lies between i * j pairs."""
    from tarmac.operators.centrality import betweenness

    fl = _fl(spark, d)
    return betweenness(fl.select("flight_id"), G.aircraft_edges(fl))


def _given_centrality(fl, deg):
    """Given centralities in place of G9 and G8: fixed rules on the degrees."""
    btw = deg.select("flight_id", (F.col("in_degree") * F.col("out_degree") / 1000.0).alias("betweenness"))
    pr = deg.select("flight_id", ((F.col("in_degree") + 1) / 10000.0).alias("pr"))
    nodes = fl.select("flight_id", "airline", "aircraft_id", "scheduled_time", "origin", "destination")
    return nodes, btw, pr


CRITICALITY = EDGE_CTES + DEGREES + """
, crit AS (SELECT f.flight_id, f.airline, f.origin, f.destination, in_degree, out_degree,
    in_degree * out_degree / 1000.0 AS betweenness, (in_degree + 1) / 10000.0 AS pagerank,
    in_degree * out_degree / 1000.0 * 0.4 + out_degree / (SELECT max(out_degree) FROM deg) * 0.3 + (in_degree + 1) / 10000.0 * 0.3 AS criticality_score
  FROM flights f JOIN deg USING (flight_id))
"""


@register("criticality_top20", with_flights(CRITICALITY + """
SELECT flight_id, airline, origin, destination, in_degree, out_degree, betweenness::DOUBLE AS betweenness, pagerank::DOUBLE AS pagerank,
  criticality_score::DOUBLE AS criticality_score FROM crit ORDER BY criticality_score DESC, flight_id LIMIT 20
"""))
def _crit(spark, d):
    fl = _fl(spark, d)
    deg = cut_lineage(G.degrees(fl, G.build_edges(fl)))
    nodes, btw, pr = _given_centrality(fl, deg)
    return G.top_critical(G.criticality(nodes, deg, btw, pr), 20)


@register("airport_vulnerability", with_flights(CRITICALITY + """
SELECT origin AS airport, count(*) AS flights_count, sum(criticality_score)::DOUBLE AS total_criticality, avg(criticality_score)::DOUBLE AS avg_criticality FROM crit GROUP BY origin
"""))
def _av(spark, d):
    fl = _fl(spark, d)
    deg = cut_lineage(G.degrees(fl, G.build_edges(fl)))
    nodes, btw, pr = _given_centrality(fl, deg)
    return G.airport_vulnerability(G.criticality(nodes, deg, btw, pr))


@register("impact_ranking", with_flights(EDGE_CTES + DEGREES + """
SELECT f.flight_id, airline, aircraft_id, scheduled_time, origin, destination, in_degree, out_degree, (in_degree * out_degree / 1000.0)::DOUBLE AS betweenness,
  (in_degree * out_degree / 1000.0 * 10 + in_degree * 0.5 + out_degree * 2)::DOUBLE AS impact_score
FROM flights f JOIN deg USING (flight_id) ORDER BY impact_score DESC, flight_id LIMIT 20
"""))
def _ir(spark, d):
    fl = _fl(spark, d)
    deg = cut_lineage(G.degrees(fl, G.build_edges(fl)))
    nodes, btw, _ = _given_centrality(fl, deg)
    return G.impact_ranking(nodes, deg, btw, 20)


@register("criticality_estimated")
def _crit_estimated(spark, d):
    """The whole chain: estimated betweenness, PageRank, degrees, criticality of the 20 first flights."""
    from tarmac.operators.centrality import betweenness

    fl = _fl(spark, d)
    e = stored(G.build_edges(fl), "edges")
    nodes = fl.select("flight_id", "airline", "aircraft_id", "scheduled_time", "origin", "destination")
    return G.top_critical(G.criticality(nodes, G.degrees(fl, e), betweenness(fl.select("flight_id"), e, sources=64), G.pagerank(fl.select("flight_id"), e)), 20)
