"""Delay-propagation graph: edges, cascade simulation, degrees, centrality, network metrics.

Nodes are flights, edges live in a DataFrame ``(src, dst, connection_type, propagation_factor,
time_buffer)``. Every edge family is built with joins/windows keyed so that no task sees more
than one bounded neighbourhood:

* aircraft / crew edges (W1/W2): next flight per key via ``with_neighbors`` bucketed by day,
  so one aircraft's or airline's whole history never sits in one task;
* runway edges (J6): equi-join on (base, runway, 30-minute slot); a slot holds at most a
  runway's half-hour capacity of flights;
* passenger edges (J5): range join ``45 <= dep - arr <= 240`` turned into an equi-join on
  (hub, 4-hour bin) by copying each arrival into its own and the next bin, then the exact
  predicate. AQE's skew-join split handles a hot hub bin.

There are many times more edges than flights, so the number of tasks follows the edges
(``edge_tasks``), not the session's shuffle partitions: a task keeps about the same number of edges
at every size.

Iterative operators (cascade, PageRank) cut lineage every round with a reliable checkpoint.
"""

from __future__ import annotations

import math
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.components import ranked
from tarmac.functions.scalars import with_scalars
from tarmac.functions.windows import with_neighbors
from tarmac.session import cut_lineage, shuffles_dropped, stored

EPOCH = "1970-01-01 00:00:00"
BIN_MINUTES = 240
TYPE_RANK = {"aircraft": 1, "crew": 2, "runway": 3, "passenger": 4}  # later type wins a (src, dst) pair
EDGES_A_TASK = 1_000_000
HEAVY = 1 << 62  # added to the numbers of ends of high degree, which so come after all others


def edge_tasks(df: DataFrame, rows: int) -> int:
    """Number of tasks for ``rows`` edges: at most about EDGES_A_TASK each, and work for every core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / EDGES_A_TASK))


def dealt(edges: DataFrame) -> DataFrame:
    """The edges, stored, then dealt by their source to ``edge_tasks`` tasks, and to no fewer than the session's shuffles
    have: joins with fewer tasks than that would deal the edges anew each time."""
    kept = stored(edges, "edges")
    least = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept.repartition(max(edge_tasks(kept, kept.count()), least), "src")


def minutes_between(a: Column, b: Column) -> Column:
    """(b - a) in minutes as double, independent of the session time zone."""
    return F.timestamp_diff("SECOND", a, b) / 60.0


def epoch_minutes(t: Column) -> Column:
    return F.timestamp_diff("MINUTE", F.lit(EPOCH).cast("timestamp_ntz"), t)


def _next_in_sequence(fl: DataFrame, keys: list[str], tasks: int | None) -> DataFrame:
    cols = ["flight_id", "scheduled_time", "origin", "destination", *keys]
    base = fl.select(*dict.fromkeys(cols))

    def compute(frame: DataFrame, w) -> DataFrame:
        return frame.withColumns({
            "next_id": F.lead("flight_id").over(w),
            "next_time": F.lead("scheduled_time").over(w),
            "next_origin": F.lead("origin").over(w),
        })

    return with_neighbors(base, keys, ["scheduled_time", "flight_id"], F.to_date("scheduled_time"), 0, 1, compute, tasks).filter(
        F.col("next_id").isNotNull()
    )


# W1 + G2
def aircraft_edges(fl: DataFrame, tasks: int | None = None) -> DataFrame:
    nxt = _next_in_sequence(fl, ["aircraft_id"], tasks).filter(F.col("destination") == F.col("next_origin"))
    buf = minutes_between(F.col("scheduled_time"), F.col("next_time"))
    factor = F.when(buf < 60, 0.9).when(buf < 120, 0.7).when(buf < 180, 0.4).otherwise(0.1)
    return nxt.select(
        F.col("flight_id").alias("src"), F.col("next_id").alias("dst"), F.lit("aircraft").alias("connection_type"),
        factor.alias("propagation_factor"), buf.alias("time_buffer"),
    )


# W2 + G3
def crew_edges(fl: DataFrame, tasks: int | None = None) -> DataFrame:
    nxt = _next_in_sequence(fl, ["base_airport", "airline"], tasks)
    buf = minutes_between(F.col("scheduled_time"), F.col("next_time"))
    return nxt.filter((buf >= 90) & (buf <= 480)).select(
        F.col("flight_id").alias("src"), F.col("next_id").alias("dst"), F.lit("crew").alias("connection_type"),
        F.lit(0.3).alias("propagation_factor"), buf.alias("time_buffer"),
    )


def half_hour_slot(t: Column) -> Column:
    h = F.date_trunc("hour", t).cast("timestamp_ntz")
    return F.when(F.minute(t) >= 30, F.timestamp_add("MINUTE", F.lit(30), h)).otherwise(h)


# J6 + G3
def runway_edges(fl: DataFrame, tasks: int | None = None) -> DataFrame:
    s = fl.select("flight_id", "scheduled_time", "runway", "base_airport", half_hour_slot(F.col("scheduled_time")).alias("slot"))
    if tasks:
        s = s.repartition(tasks, "base_airport", "runway", "slot")
    a = s.alias("a")
    b = s.alias("b")
    cond = [
        F.col("a.base_airport") == F.col("b.base_airport"),
        F.col("a.runway") == F.col("b.runway"),
        F.col("a.slot") == F.col("b.slot"),
        (F.col("a.scheduled_time") < F.col("b.scheduled_time"))
        | ((F.col("a.scheduled_time") == F.col("b.scheduled_time")) & (F.col("a.flight_id") < F.col("b.flight_id"))),
    ]
    j = a.join(b, cond, "inner")
    buf = minutes_between(F.col("a.scheduled_time"), F.col("b.scheduled_time"))
    return j.filter(buf <= 30).select(
        F.col("a.flight_id").alias("src"), F.col("b.flight_id").alias("dst"), F.lit("runway").alias("connection_type"),
        F.lit(0.6).alias("propagation_factor"), buf.alias("time_buffer"),
    )


# G4 + U3
def hub_airports(fl: DataFrame, min_flights: int = 10) -> DataFrame:
    dest = fl.groupBy(F.col("destination").alias("airport")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_flights)
    orig = fl.groupBy(F.col("origin").alias("airport")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_flights)
    return dest.select("airport").union(orig.select("airport")).distinct()


# J5 + G3
def _arrivals(fl: DataFrame) -> DataFrame:
    b = F.floor(epoch_minutes(F.col("scheduled_time")) / BIN_MINUTES)
    return fl.select(F.col("flight_id").alias("a_id"), F.col("scheduled_time").alias("a_t"), F.col("destination").alias("hub"),
                     F.explode(F.array(b, b + 1)).alias("bin"))


def _departures(fl: DataFrame) -> DataFrame:
    b = F.floor(epoch_minutes(F.col("scheduled_time")) / BIN_MINUTES)
    return fl.select(F.col("flight_id").alias("d_id"), F.col("scheduled_time").alias("d_t"), F.col("origin").alias("hub"), b.alias("bin"))


def _pair_tasks(fl: DataFrame) -> int:
    """Tasks for the pairs that the passenger join looks at, from the numbers of flights by hub and bin."""
    a = _arrivals(fl).groupBy("hub", "bin").agg(F.count(F.lit(1)).alias("na"))
    d = _departures(fl).groupBy("hub", "bin").agg(F.count(F.lit(1)).alias("nd"))
    return edge_tasks(fl, a.join(d, ["hub", "bin"]).agg(F.sum(F.col("na") * F.col("nd"))).first()[0] or 0)


def passenger_edges(fl: DataFrame, min_flights: int = 10, lo: int = 45, hi: int = 240, tasks: int | None = None) -> DataFrame:
    hubs = hub_airports(fl, min_flights).withColumnRenamed("airport", "hub")
    n = tasks or _pair_tasks(fl)
    arr = _arrivals(fl).join(hubs, "hub", "left_semi").repartition(n, "hub", "bin")
    dep = _departures(fl).join(hubs, "hub", "left_semi").repartition(n, "hub", "bin")
    j = arr.join(dep, ["hub", "bin"], "inner")
    buf = minutes_between(F.col("a_t"), F.col("d_t"))
    return j.filter((buf >= lo) & (buf <= hi)).select(
        F.col("a_id").alias("src"), F.col("d_id").alias("dst"), F.lit("passenger").alias("connection_type"),
        F.lit(0.2).alias("propagation_factor"), buf.alias("time_buffer"),
    )


# G1
def build_edges(fl: DataFrame, keep_all: bool = False) -> DataFrame:
    """Union of the four edge families; per (src, dst) the later family wins (one edge per pair). The edges are
    dealt by source before they are merged: no task merges what its joins made, and what follows finds them by source."""
    n = _pair_tasks(fl)
    parts = [family(fl, tasks=n) for family in (aircraft_edges, crew_edges, runway_edges, passenger_edges)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    if keep_all:
        return u
    rank = F.create_map(*[F.lit(x) for kv in TYPE_RANK.items() for x in kv])[F.col("connection_type")]
    ranked = u.select("src", "dst", rank.alias("r"), "propagation_factor", "time_buffer").repartition(n, "src")
    best = ranked.groupBy("src", "dst").agg(  # numbers only: merged in a hash table, without a sort
        F.max("r").alias("r"), F.max_by("propagation_factor", "r").alias("propagation_factor"), F.max_by("time_buffer", "r").alias("time_buffer"))
    name = F.element_at(F.array(*[F.lit(t) for t in TYPE_RANK]), F.col("r"))
    return best.select("src", "dst", name.alias("connection_type"), "propagation_factor", "time_buffer")


# G5
def simulate_cascade(nodes: DataFrame, edges: DataFrame, initial: DataFrame, max_iterations: int = 5,
                     checkpoint: bool = True) -> DataFrame:
    """Synchronous rounds: p = d_u * f; if buffer > p then p = max(0, p - 0.1 * buffer);
    new(v) = max(cur(v), cur(v) + max p). Stops early when no positive p was produced.

    ``nodes``: flight_id; ``initial``: flight_id, delay. Returns flight_id, delay for every node.
    """
    state = initial.select("flight_id", F.col("delay").cast("double").alias("delay")).filter(F.col("delay") > 0)
    state = state.join(nodes.select("flight_id"), "flight_id", "left_semi")
    with shuffles_dropped(nodes.sparkSession) if checkpoint else nullcontext():
        state = _cascade_rounds(state, edges.select("src", "dst", "propagation_factor", "time_buffer"), max_iterations, checkpoint)
    return nodes.select("flight_id").join(state.select("flight_id", "delay"), "flight_id", "left").select(
        "flight_id", F.coalesce(F.col("delay"), F.lit(0.0)).alias("delay"))


def _cascade_rounds(state: DataFrame, e: DataFrame, rounds: int, checkpoint: bool) -> DataFrame:
    """``state`` (sparse: only delayed flights; delays never decrease, so a flight never leaves it) after the rounds."""
    if checkpoint:
        # the edge table is reused every round: materialise it once, dealt and sorted by src
        e = cut_lineage(dealt(e).sortWithinPartitions("src"), keep_layout=True)
        state = cut_lineage(state.select("*"))
    for _ in range(rounds):
        act = state.withColumnRenamed("flight_id", "src").withColumnRenamed("delay", "d_src")
        p = F.col("d_src") * F.col("propagation_factor")
        p = F.when(F.col("time_buffer") > p, F.greatest(F.lit(0.0), p - F.col("time_buffer") * 0.1)).otherwise(p)
        prop = act.join(e, "src").select(F.col("dst").alias("flight_id"), p.alias("p")).filter(F.col("p") > 0)
        best = prop.groupBy("flight_id").agg(F.max("p").alias("p"))
        step = state.join(best, "flight_id", "full_outer").select(
            "flight_id", (F.coalesce(F.col("delay"), F.lit(0.0)) + F.coalesce(F.col("p"), F.lit(0.0))).alias("delay"),
            F.col("p").isNotNull().alias("_moved"))
        if checkpoint:
            step = cut_lineage(step)
            if step.filter("_moved").isEmpty():  # no propagation: later rounds change nothing
                break
        state = step.drop("_moved")
    return state


# G6
def cascade_impact(final: DataFrame, initial: DataFrame, nodes: DataFrame) -> DataFrame:
    init = initial.agg(F.sum("delay").alias("initial_delay_minutes"))
    j = final.join(nodes.select("flight_id", "capacity"), "flight_id", "left")
    d = F.col("delay")
    agg = j.agg(
        F.sum(d).alias("total_propagated_delay"),
        F.count_if(d > 0).alias("affected_flights_count"),
        F.count_if((d > 0) & (d <= 15)).alias("minor"),
        F.count_if((d > 15) & (d <= 30)).alias("moderate"),
        F.count_if(d > 30).alias("severe"),
        (F.sum(F.when(d > 0, F.col("capacity") * d)) / 60).alias("estimated_passenger_delay_hours"),
    )
    out = with_scalars(agg, init)
    return out.withColumn(
        "amplification_factor",
        F.when(F.col("initial_delay_minutes") > 0, F.col("total_propagated_delay") / F.col("initial_delay_minutes")).otherwise(0.0),
    )


# G7
def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    outd = edges.groupBy(F.col("src").alias("flight_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    ind = edges.groupBy(F.col("dst").alias("flight_id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.select("flight_id").join(ind, "flight_id", "left").join(outd, "flight_id", "left").select(
        "flight_id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree")
    )


# G12
def numbered(fl: DataFrame) -> DataFrame:
    """The flights, stored, with the position of their id among all ids in place of the id: as edges hold two ids,
    they are shorter and quicker to compare, and the order of the ids stays."""
    with shuffles_dropped(fl.sparkSession):
        ids = ranked(fl.select("flight_id").filter(F.col("flight_id").isNotNull()).distinct(), "_vid")
        return stored(fl.join(ids, "flight_id", "left").withColumn("flight_id", F.col("_vid")).drop("_vid"), "numbered")


def _undirected(edges: DataFrame, tasks: int) -> DataFrame:
    """``u, v, ways``: each pair of ends once, the smaller first; how many of its two directions are edges."""
    way = F.when(F.col("src") <= F.col("dst"), 1).otherwise(2)
    pairs = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), way.alias("way"))
    return pairs.repartition(tasks, "u").groupBy("u", "v").agg(F.bit_count(F.bit_or("way")).alias("ways"))


def network_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, density m/(n(n-1)) and average clustering of the undirected graph. Edges given more than once
    count once; the ends may be strings or whole numbers.

    Triangles: an undirected edge leads from the end that comes first to the other; every triangle is found once
    as a -> b, a -> c, b -> c, i.e. as c in N+(a) & N+(b) for the edge (a, b). Ends come by number, those of degree
    over sqrt(2m), of which there are fewer than that, after all others: so each out-list is bounded by sqrt(2m)
    (no hub blow-up, O(m^1.5) work). Only what follows b in N+(a) is sent to b.
    """
    edges = stored(edges.select("src", "dst"), "edges")
    ends = F.col("src").isNotNull() & F.col("dst").isNotNull()
    whole = edges.filter(ends)
    tasks = edge_tasks(edges, edges.count())
    if dict(edges.dtypes)["src"] != "bigint":  # the triangle search shuffles adjacency lists: numbers are a fraction of string ids
        both = whole.select(F.col("src").alias("x")).union(whole.select(F.col("dst").alias("x")))
        vid = stored(both.distinct().withColumn("vid", F.monotonically_increasing_id()), "ends")
        whole = (whole.repartition(tasks, "src").join(vid.select(F.col("x").alias("src"), F.col("vid").alias("s")), "src").repartition(tasks, "dst")
                 .join(vid.select(F.col("x").alias("dst"), F.col("vid").alias("t")), "dst").select(F.col("s").alias("src"), F.col("t").alias("dst")))
    und = stored(_undirected(whole, tasks), "undirected")
    pairs, found = und.agg(F.count(F.lit(1)), F.sum("ways")).first()
    total = (found or 0) + edges.filter(~ends).distinct().count()
    deg = stored(und.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("k")), "degrees")
    heavy = deg.filter(F.col("k") > math.isqrt(2 * pairs)).select("x").cache()
    a, b = F.col("u"), F.col("v")
    if not heavy.isEmpty():  # numbers of heavy ends are raised above all others
        for end, raised in (("u", "_hu"), ("v", "_hv")):
            und = und.join(F.broadcast(heavy.select(F.col("x").alias(end), F.lit(HEAVY).alias(raised))), end, "left")
        a, b = a + F.coalesce("_hu", F.lit(0)), b + F.coalesce("_hv", F.lit(0))
    ori = und.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).repartition(tasks, "a")
    outn = stored(ori.groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("nb")), "out-lists")
    heavy.unpersist()
    sent = outn.agg(F.sum(F.size("nb") * F.size("nb")) / 2).first()[0] or 0
    tasks = edge_tasks(edges, max(pairs, int(sent / 8)))
    tails = outn.select("a", F.posexplode("nb").alias("_at", "b"), "nb").select("a", "b", F.expr("slice(nb, _at + 1, size(nb) - _at)").alias("tail"))
    close = tails.repartition(tasks, "b").join(outn.select(F.col("a").alias("b"), F.col("nb").alias("nbb")), "b").select(
        "a", "b", F.array_intersect("tail", "nbb").alias("c")).filter(F.size("c") > 0)
    # a and b are in as many triangles as there are third corners, each of those in one
    n3 = F.size("c").cast("long")
    corners = F.concat(F.array(F.struct(F.col("a").alias("x"), n3.alias("t")), F.struct(F.col("b").alias("x"), n3.alias("t"))),
                       F.transform("c", lambda c: F.struct(c.alias("x"), F.lit(1).cast("long").alias("t"))))
    per_node = close.select(F.inline(corners)).groupBy(F.when(F.col("x") >= HEAVY, F.col("x") - HEAVY).otherwise(F.col("x")).alias("x")).agg(F.sum("t").alias("t"))
    cc = deg.join(per_node, "x", "left").select(
        F.when(F.col("k") >= 2, 2.0 * F.coalesce(F.col("t"), F.lit(0)) / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("c")
    )
    n = nodes.agg(F.count(F.lit(1)).alias("total_nodes")).withColumn("total_edges", F.lit(total).cast("long"))
    out = with_scalars(n, cc.agg(F.sum("c").alias("_cs")))
    return out.select(
        "total_nodes", "total_edges",
        (F.col("total_edges") / (F.col("total_nodes") * (F.col("total_nodes") - 1))).alias("density"),
        (F.coalesce(F.col("_cs"), F.lit(0.0)) / F.col("total_nodes")).alias("avg_clustering"),
    )


# G8
def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 100) -> DataFrame:
    """Power iteration with uniform edge weights; dangling mass spread uniformly.
    Stops when the L1 change < n * tol. Per iteration one job computes the new ranks (checkpointed)
    and one aggregate returns the two scalars the driver needs (change, next dangling mass)."""
    ids = nodes.select("flight_id").distinct()
    e = dealt(edges.select("src", "dst")).filter(F.col("src").isNotNull()).distinct()
    e = cut_lineage(e.select("src", "dst", (1.0 / F.count(F.lit(1)).over(Window.partitionBy("src"))).alias("w")))
    outs = e.select(F.col("src").alias("flight_id")).distinct()
    flags = ids.join(outs.withColumn("_has_out", F.lit(False)), "flight_id", "left")
    n = ids.count()
    pr = cut_lineage(flags.select("flight_id", F.col("_has_out").isNull().alias("dangling"), F.lit(1.0 / n).alias("pr")))
    dmass = pr.agg(F.sum(F.when(F.col("dangling"), F.col("pr")))).first()[0] or 0.0
    for _ in range(max_iter):
        contrib = pr.join(e, pr.flight_id == e.src).groupBy(F.col("dst").alias("flight_id")).agg(
            F.sum(F.col("pr") * F.col("w")).alias("s"))
        new = pr.select("flight_id", "dangling").join(contrib, "flight_id", "left").select(
            "flight_id", "dangling",
            (F.lit(alpha) * (F.coalesce(F.col("s"), F.lit(0.0)) + F.lit(dmass / n)) + F.lit((1 - alpha) / n)).alias("pr"),
        )
        new = cut_lineage(new)
        stats = new.alias("a").join(pr.alias("b"), "flight_id").agg(
            F.sum(F.abs(F.col("a.pr") - F.col("b.pr"))).alias("err"),
            F.sum(F.when(F.col("a.dangling"), F.col("a.pr"))).alias("dm"),
        ).first()
        pr = new
        dmass = stats["dm"] or 0.0
        if stats["err"] < n * tol:
            break
    return pr.select("flight_id", "pr")


# G10 / G11 / G13
def criticality(nodes: DataFrame, deg: DataFrame, betweenness: DataFrame, pr: DataFrame, top: int = 20) -> DataFrame:
    j = nodes.select("flight_id", "airline", "origin", "destination").join(deg, "flight_id").join(
        betweenness, "flight_id", "left").join(pr, "flight_id", "left")
    j = j.withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0))).withColumn("pagerank", F.coalesce("pr", F.lit(0.0)))
    j = with_scalars(j, deg.agg(F.max("out_degree").alias("_max_out")))
    score = F.col("betweenness") * 0.4 + F.col("out_degree") / F.col("_max_out") * 0.3 + F.col("pagerank") * 0.3
    return j.withColumn("criticality_score", score).drop("pr", "_max_out")


def top_critical(crit: DataFrame, top: int = 20) -> DataFrame:
    return crit.orderBy(F.col("criticality_score").desc(), "flight_id").limit(top)


def airport_vulnerability(crit: DataFrame) -> DataFrame:
    return crit.groupBy(F.col("origin").alias("airport")).agg(
        F.count(F.lit(1)).alias("flights_count"), F.sum("criticality_score").alias("total_criticality"),
        F.avg("criticality_score").alias("avg_criticality"),
    )


def impact_ranking(nodes: DataFrame, deg: DataFrame, betweenness: DataFrame, top: int = 20) -> DataFrame:
    j = nodes.select("flight_id", "airline", "aircraft_id", "scheduled_time", "origin", "destination").join(deg, "flight_id").join(
        betweenness, "flight_id", "left")
    score = F.coalesce("betweenness", F.lit(0.0)) * 10 + F.col("in_degree") * 0.5 + F.col("out_degree") * 2
    return j.withColumn("impact_score", score).orderBy(F.col("impact_score").desc(), "flight_id").limit(top)


# G14
def impact_score_basic(fl: DataFrame) -> DataFrame:
    """Per flight: (delay/60 + capacity/300 + hour factor + aircraft factor) / 4."""
    hour_f = F.when(F.col("hour").isin(7, 8, 18, 19, 20), 1.5).when(F.col("hour").isin(22, 23, 0, 1, 2, 3, 4, 5), 0.5).otherwise(1.0)
    ac = F.upper(F.col("aircraft_type"))
    large = ac.contains("A330") | ac.contains("A350") | ac.contains("B777") | ac.contains("B787")
    small = ac.contains("ATR") | ac.contains("Q400")
    ac_f = F.when(ac.isNull(), 1.0).when(large, 1.3).when(small, 0.8).otherwise(1.0)
    score = (F.col("delay_minutes") / 60 + F.coalesce(F.col("capacity"), F.lit(150)) / 300 + hour_f + ac_f) / 4
    return fl.select("flight_id", "airline", "delay_minutes", "capacity", "hour", score.alias("impact_score"))


def impact_summary(scored: DataFrame, top: int = 10) -> DataFrame:
    """Top flights by impact plus the >1.0 / (0.7, 1.0] counts and the total risk (one pass + top-k)."""
    s = F.col("impact_score")
    summary = scored.agg(
        F.count_if(s > 1.0).alias("high_impact_count"),
        F.count_if((s > 0.7) & (s <= 1.0)).alias("medium_impact_count"),
        F.sum(s).alias("total_cascade_risk"),
    )
    topk = scored.orderBy(s.desc(), "flight_id").limit(top)
    return with_scalars(topk, summary)
