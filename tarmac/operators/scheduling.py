"""Scheduling, slot allocation and rescheduling.

The two allocators (K2 greedy capacity search, K8 runway-slot assignment) are sequential,
state-carrying loops in the reference: each flight's choice depends on all earlier choices.
Their state is scoped to one (base airport, service day) (decision D5; K8 adds a second pass at
midnight), which makes every group independent: Spark shuffles flights by that key and runs the loop per group with
``applyInPandas``. A group is one airport-day of traffic, bounded by the airport's capacity.
Inside a group the order is total (priority, time, flight id), so the result does not depend
on partitioning. Everything else is Column expressions and aggregates.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import dims
from tarmac.functions.scalars import with_scalars
from tarmac.operators.cleaning import AIRCRAFT, aircraft_category, flight_priority
from tarmac.operators.joins import nearest_slot
from tarmac.session import cut_lineage

SLOT_MINUTES = 15
# FIXED VALUES: slot-penalty multipliers by peak category; hours the rescheduler avoids
PEAK_MULT = {"super_peak": 3.0, "peak": 2.0, "moderate": 1.0, "low": 0.5}
NO_GO_HOURS = [7, 8, 19, 20, 21]
CANDIDATE_HOURS = [h for h in range(6, 23) if h not in NO_GO_HOURS]
# FIXED VALUES: rescheduling tables
RESCHEDULE_RUNWAY_CAPACITY = {"R1": 35, "R2": 30, "R3": 25, "R4": 20, "09R/27L": 35, "09L/27R": 30, "14/32": 25}
WEATHER_DELAY_IMPACT = {"Clear": 1.0, "Light Rain": 1.2, "Heavy Rain": 1.8, "Fog": 2.0, "Storm": 3.0, "Snow": 2.5,
                        # not in the rescheduling table but in the weather table: rain between light and heavy, storms alike
                        "Moderate Rain": 1.5, "Thunderstorm": 3.0, "Strong Winds": 1.5}


# K1
def optimization_priority(fl: DataFrame) -> DataFrame:
    pr = (F.coalesce(F.col("is_high_impact"), F.lit(False)).cast("int") * 1000
          + F.coalesce(F.col("congestion_factor"), F.lit(1.0)) * 100
          + (F.col("delay_minutes") > 30).cast("int") * 50)
    return fl.withColumn("optimization_priority", pr)


# K3
def improvement_factor() -> Column:
    b = F.lit(0.25)
    b = b + F.when(F.coalesce(F.col("is_high_impact"), F.lit(False)), 0.10).otherwise(0.0)
    cf = F.coalesce(F.col("congestion_factor"), F.lit(1.0))
    b = b + F.when(cf < 1.3, 0.05).when(cf > 1.7, -0.05).otherwise(0.0)
    pc = F.coalesce(F.col("peak_category"), F.lit("moderate"))
    b = b + F.when(pc == "low", 0.08).when(pc == "super_peak", -0.10).otherwise(0.0)
    b = b + F.when(F.coalesce(F.col("runway_efficiency"), F.lit(1.0)) > 0.85, 0.03).otherwise(0.0)
    return F.least(F.lit(0.40), F.greatest(F.lit(0.10), b))


# K4
def optimized_delay(assigned: DataFrame) -> DataFrame:
    """Given optimized_time and can_improve per flight: optimized delay and per-flight score."""
    shift = F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", F.col("scheduled_time"), F.col("optimized_time")) / 60.0)
    orig = F.col("delay_minutes")
    improved = F.greatest(F.lit(0.0), orig - orig * improvement_factor() + shift)
    opt = F.when(F.col("can_improve") & (orig > 0), improved).otherwise(orig + shift)
    df = assigned.withColumn("time_shift_delay", shift).withColumn("optimized_delay", opt)
    score = F.when(orig > 0, F.greatest(F.lit(0.0), (orig - F.col("optimized_delay")) / orig)).otherwise(
        F.when(F.col("time_shift_delay") == 0, 0.0).otherwise(-0.1))
    return df.withColumn("optimization_score", score)


def optimization_summary(scored: DataFrame) -> DataFrame:
    one = scored.agg(
        F.sum("delay_minutes").alias("original_total_delay"), F.sum("optimized_delay").alias("optimized_total_delay"),
        F.count_if(F.col("optimization_score") > 0).alias("flights_improved"), F.count(F.lit(1)).alias("total_flights"),
    )
    imp = F.when(F.col("original_total_delay") > 0, F.least(F.lit(0.35), F.greatest(
        F.lit(0.0), (F.col("original_total_delay") - F.col("optimized_total_delay")) / F.col("original_total_delay")))).otherwise(0.0)
    return one.withColumn("optimization_improvement", imp)


# K2
GREEDY_SCHEMA = (
    "flight_id string, base_airport string, service_date date, optimization_priority double, "
    "optimized_time timestamp_ntz, optimized_runway string, can_improve boolean"
)


LATE_STEP = 10  # a place found this many quarter hours late, or on another runway, is no improvement


def _first_with_room(minute: int, steps: int, booked: Counter, room: int) -> int | None:
    """Quarter hours from ``minute`` to the first one whose hour has room. Capacity is per hour, so one
    look per hour is enough: its first quarter hour on the flight's own 15-minute raster."""
    for hour in range(minute // 60, (minute + SLOT_MINUTES * (steps - 1)) // 60 + 1):
        step = max(0, -(-(hour * 60 - minute) // SLOT_MINUTES))
        if (minute + SLOT_MINUTES * step) // 60 == hour and booked[hour] < room:
            return step
    return None


def _greedy_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """One airport-day in priority order; ``booked`` counts flights per runway and hour."""
    rooms = {name: int(c * 0.85) for name, c in dims.GREEDY_RUNWAY_CAPACITY.items()}
    booked = {name: Counter() for name in rooms}
    pdf = pdf.sort_values(["optimization_priority", "scheduled_time", "flight_id"], ascending=[False, True, True], kind="mergesort")
    wanted = (pd.to_datetime(pdf["scheduled_time"]).astype("int64") // 60_000_000_000).to_numpy()
    span = np.where(pdf["delay_minutes"].to_numpy() > 60, 24, 12)
    placed = []
    for minute, own, steps in zip(wanted.tolist(), pdf["runway"].tolist(), span.tolist()):
        order = [own, *(name for name in rooms if name != own)]
        tries = ((name, _first_with_room(minute, steps, booked[name], rooms[name])) for name in order if name in rooms)
        name, step = next(((n, k) for n, k in tries if k is not None), (own, None))
        at = minute + 30 if step is None else minute + SLOT_MINUTES * step
        booked.setdefault(name, Counter())[at // 60] += 1
        placed.append((at, name, step is not None and name == own and step < LATE_STEP))
    times, names, early = zip(*placed)
    return pd.DataFrame({
        "flight_id": pdf["flight_id"].values, "base_airport": pdf["base_airport"].values, "service_date": pdf["service_date"].values,
        "optimization_priority": pdf["optimization_priority"].astype(float).values,
        "optimized_time": pd.to_datetime(np.array(times, dtype="int64"), unit="m"), "optimized_runway": names, "can_improve": early,
    })


def greedy_slot_allocation(fl: DataFrame) -> DataFrame:
    """K2 per (base airport, service day), then K4 scoring. Returns one row per flight."""
    df = optimization_priority(fl).withColumn("service_date", F.to_date("scheduled_time"))
    inp = df.select("flight_id", "base_airport", "service_date", "optimization_priority", "scheduled_time", "runway", "delay_minutes")
    alloc = inp.groupBy("base_airport", "service_date").applyInPandas(_greedy_group, GREEDY_SCHEMA)
    j = df.join(alloc.select("flight_id", "optimized_time", "optimized_runway", "can_improve"), "flight_id")
    return optimized_delay(j)


# K5
def slot_penalty_multiplier() -> Column:
    """congestion x peak multiplier x (2.5 if high impact) / runway efficiency."""
    return (F.coalesce(F.col("congestion_factor"), F.lit(1.0))
            * F.coalesce(dims.lit_map(PEAK_MULT)[F.col("peak_category")], F.lit(1.0))
            * F.when(F.coalesce(F.col("is_high_impact"), F.lit(False)), 2.5).otherwise(1.0)
            / F.coalesce(F.col("runway_efficiency"), F.lit(1.0)))


def slot_penalty_at(offset: Column) -> Column:
    """Closed form of the penalty for any slot offset from the preferred slot: every slot of the
    horizon is covered exactly without materialising flights x slots."""
    return F.floor(F.abs(offset) * slot_penalty_multiplier()).cast("long")


def slot_penalty(fl: DataFrame, window_slots: int = 8) -> DataFrame:
    """Tabulated penalties for offsets in [-window, window] around the preferred (nearest) 15-minute
    slot (a per-row array, not a join); ``slot_penalty_at`` gives the same value for any other offset."""
    pref = nearest_slot(F.col("scheduled_time"), SLOT_MINUTES)
    mult = slot_penalty_multiplier()
    df = fl.select("flight_id", pref.alias("preferred_slot"), mult.alias("_m"),
                   F.explode(F.sequence(F.lit(-window_slots), F.lit(window_slots))).alias("slot_offset"))
    return df.select(
        "flight_id", "slot_offset", "preferred_slot",
        F.timestamp_add("MINUTE", F.col("slot_offset") * SLOT_MINUTES, F.col("preferred_slot")).alias("slot_time"),
        F.floor(F.abs(F.col("slot_offset")) * F.col("_m")).cast("long").alias("penalty"),
    )


def slot_penalty_day(fl: DataFrame) -> DataFrame:
    """Penalties of all 96 quarter-hour slots of the flight's service day, the whole horizon of one day, one row per
    flight and slot (a fixed per-row array, not a join). A flight of the last minutes may prefer the next midnight's slot."""
    day = F.date_trunc("DAY", F.col("scheduled_time")).cast("timestamp_ntz")
    df = fl.select("flight_id", nearest_slot(F.col("scheduled_time"), SLOT_MINUTES).alias("preferred_slot"), slot_penalty_multiplier().alias("_m"),
                   day.alias("_day"), F.explode(F.sequence(F.lit(0), F.lit(24 * 60 // SLOT_MINUTES - 1))).alias("_slot"))
    offset = (F.col("_slot") - F.timestamp_diff("MINUTE", F.col("_day"), F.col("preferred_slot")) / SLOT_MINUTES).cast("int")
    return df.withColumn("slot_offset", offset).select(
        "flight_id", "slot_offset", "preferred_slot",
        F.timestamp_add("MINUTE", F.col("_slot") * SLOT_MINUTES, F.col("_day")).alias("slot_time"),
        F.floor(F.abs(F.col("slot_offset")) * F.col("_m")).cast("long").alias("penalty"),
    )


# K7
def suitability(runway: str, aircraft_type: Column) -> Column:
    length, _, pref_cats = dims.SUITABILITY_RUNWAYS[runway]
    known = dims.lit_map({m: v[1] for m, v in AIRCRAFT.items()})[aircraft_type]
    prefers = dims.lit_map({m: runway in v[2] for m, v in AIRCRAFT.items()})[aircraft_type]
    s = (F.lit(0.5)
         + F.when(known.isNotNull() & (F.lit(length) >= known), 0.2).otherwise(0.0)
         + F.when(F.coalesce(prefers, F.lit(False)), 0.2).otherwise(0.0)
         + F.when(aircraft_category(aircraft_type).isin(pref_cats), 0.1).otherwise(0.0))
    return F.least(F.lit(1.0), s)


def runway_suitability(fl: DataFrame) -> DataFrame:
    """One row per (flight, runway of the suitability table) via a fixed per-row array."""
    rows = F.array(*[F.struct(F.lit(r).alias("runway_id"), suitability(r, F.col("aircraft_type")).alias("suitability"))
                     for r in dims.SUITABILITY_RUNWAYS])
    return fl.select("flight_id", "aircraft_type", F.inline(rows))


# K8
ALLOC_SCHEMA = (
    "flight_id string, base_airport string, service_date date, priority int, aircraft_category string, "
    "optimized_runway string, optimized_time timestamp_ntz, schedule_change_minutes double, suitability_score double"
)


SUITS = [f"s_{i}" for i in range(len(dims.SUITABILITY_RUNWAYS))]
#: What a second pass needs besides the result.
CARRIED = ["scheduled_time", "runway", *SUITS]
PLACED_SCHEMA = (ALLOC_SCHEMA + ", scheduled_time timestamp_ntz, runway string, placed boolean, "
                 + ", ".join(f"{c} double" for c in SUITS))
#: How far a flight may move, in seconds.
MAX_SHIFT = 3600


def _place(pdf: pd.DataFrame, day: pd.Timestamp, taken: set) -> pd.DataFrame:
    """Places flights in priority order on the free slots of one calendar day; the rest keep their own runway and time.
    ``taken`` holds (runway, slot of the day) pairs and receives the new ones."""
    step = SLOT_MINUTES * 60
    last = 24 * 3600 // step - 1
    pdf = pdf.sort_values(["priority", "scheduled_time", "flight_id"], kind="mergesort")
    offsets = (pdf["scheduled_time"] - day).dt.total_seconds().astype("int64")
    suits = pdf[SUITS].to_numpy()
    slots, runways, scores = [], [], []
    for t, own, suit in zip(offsets, pdf["runway"], suits):
        first, final = max(0, -((MAX_SHIFT - t) // step)), min(last, (t + MAX_SHIFT) // step)
        # nearest slot first, the earlier one of two equally near
        near = sorted(range(first, final + 1), key=lambda k: (abs(k * step - t), k))
        best = None
        for r, s in zip(dims.SUITABILITY_RUNWAYS, suit):
            k = next((k for k in near if (r, k) not in taken), None)
            if k is None:
                continue
            score = s * (1 - min(0.5, abs(k * step - t) / MAX_SHIFT))
            if best is None or score > best[0]:
                best = (score, r, k)
        if best is None:
            slots.append(None), runways.append(own), scores.append(0.5)
        else:
            taken.add(best[1:])
            slots.append(best[2] * step), runways.append(best[1]), scores.append(best[0])
    placed = [k is not None for k in slots]
    moved = np.array([t if k is None else k for t, k in zip(offsets, slots)], dtype="int64")
    return pdf[["flight_id", "base_airport", "service_date", "priority", "aircraft_category", *CARRIED]].assign(
        optimized_runway=runways, optimized_time=day + pd.to_timedelta(moved, unit="s"),
        schedule_change_minutes=(moved - offsets.to_numpy()) / 60.0, suitability_score=scores, placed=placed)


def _place_own_day(pdf: pd.DataFrame) -> pd.DataFrame:
    return _place(pdf, pd.Timestamp(pdf["service_date"].iloc[0]), set())


def _place_other_day(left: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    """Flights without a slot on their own day, on the slots that the neighbouring day's flights left free."""
    if left.empty:
        return pd.DataFrame()
    day = pd.Timestamp(left["slot_day"].iloc[0])
    taken = set(zip(held["held_runway"], held["held_slot"])) if len(held) else set()
    return _place(left, day, taken)


def allocate_runway_slots(fl: DataFrame) -> DataFrame:
    """K8: priority order, each (airport, runway, 15-minute slot) used once, within +/-60 min, best suitability x
    (1 - min(0.5, shift/60)); unplaced flights keep their slot.

    A slot belongs to the calendar day it lies in. First every (base airport, day) places its own flights on the whole
    day's slots; then flights left over within an hour of midnight try what the neighbouring day left free. So no two
    groups hand out the same slot."""
    df = fl.withColumns({
        "service_date": F.to_date("scheduled_time"),
        "priority": flight_priority(F.col("is_emergency"), F.col("is_international"), F.col("capacity")),
        "aircraft_category": aircraft_category(F.col("aircraft_type")),
    })
    df = df.withColumns({c: suitability(r, F.col("aircraft_type")) for c, r in zip(SUITS, dims.SUITABILITY_RUNWAYS)}).select(
        "flight_id", "base_airport", "service_date", "priority", "aircraft_category", *CARRIED)
    own = cut_lineage(df.groupBy("base_airport", "service_date").applyInPandas(_place_own_day, PLACED_SCHEMA))

    hour = F.hour("scheduled_time")
    slot_day = F.when(hour == 0, F.date_sub("service_date", 1)).when(hour == 23, F.date_add("service_date", 1))
    edge = ~F.col("placed") & hour.isin(0, 23)
    left = own.filter(edge).withColumn("slot_day", slot_day)
    held = own.filter(F.col("placed") & F.hour("optimized_time").isin(0, 23)).select(
        "base_airport", F.to_date("optimized_time").alias("slot_day"), F.col("optimized_runway").alias("held_runway"),
        ((F.hour("optimized_time") * 60 + F.minute("optimized_time")) / SLOT_MINUTES).cast("int").alias("held_slot"))
    other = left.groupBy("base_airport", "slot_day").cogroup(held.groupBy("base_airport", "slot_day")).applyInPandas(
        _place_other_day, PLACED_SCHEMA)
    return own.filter(~edge).unionByName(other).drop("placed", *CARRIED)


def given_assignment(fl: DataFrame) -> DataFrame:
    """A deterministic stand-in assignment (runway by minute mod 4, nearest slot) so that the
    assignment audits and rollups can be checked against SQL independently of K8."""
    rws = list(dims.SUITABILITY_RUNWAYS)
    idx = F.minute("scheduled_time") % 4
    opt_rw = F.element_at(F.array(*[F.lit(r) for r in rws]), (idx + 1).cast("int"))
    suit = F.element_at(F.array(*[suitability(r, F.col("aircraft_type")) for r in rws]), (idx + 1).cast("int"))
    ot = nearest_slot(F.col("scheduled_time"), SLOT_MINUTES)
    return fl.select(
        "flight_id", "base_airport", "aircraft_id", "capacity", "delay_minutes", "scheduled_time",
        flight_priority(F.col("is_emergency"), F.col("is_international"), F.col("capacity")).alias("priority"),
        aircraft_category(F.col("aircraft_type")).alias("aircraft_category"),
        opt_rw.alias("optimized_runway"), ot.alias("optimized_time"),
        (F.timestamp_diff("SECOND", F.col("scheduled_time"), ot) / 60.0).alias("schedule_change_minutes"),
        suit.alias("suitability_score"),
    )


# K9
def runway_efficiency_metrics(asg: DataFrame) -> DataFrame:
    """Per runway of the table: utilisation = mean flights in an hour of use (one airport, one day) / max ops
    (0 if unused)."""
    hourly = asg.groupBy("base_airport", "optimized_runway", F.date_trunc("hour", "optimized_time").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    per_rw = hourly.groupBy("optimized_runway").agg(F.avg("n").alias("avg_flights_per_hour"))
    spark = asg.sparkSession
    rw = spark.createDataFrame([(r, v[1]) for r, v in dims.SUITABILITY_RUNWAYS.items()], "optimized_runway string, max_ops int")
    j = rw.join(per_rw, "optimized_runway", "left")
    return j.select(
        "optimized_runway",
        F.coalesce(F.col("avg_flights_per_hour") / F.col("max_ops") * 100, F.lit(0.0)).alias("utilization_rate"),
    )


def priority_compliance(asg: DataFrame) -> DataFrame:
    spark = asg.sparkSession
    pr = spark.range(1, 6).select(F.col("id").cast("int").alias("priority"))
    m = asg.groupBy("priority").agg(F.avg("schedule_change_minutes").alias("_a"))
    return pr.join(m, "priority", "left").select(
        "priority", F.coalesce(F.greatest(F.lit(0.0), 100 - F.abs("_a")), F.lit(100.0)).alias("compliance"))


def category_efficiency(asg: DataFrame) -> DataFrame:
    """Per aircraft category: mean suitability and mean schedule change of the flights that got a slot."""
    return asg.filter(F.col("optimized_time").isNotNull()).groupBy("aircraft_category").agg(
        F.count(F.lit(1)).alias("flights"), F.avg("suitability_score").alias("avg_suitability"),
        F.avg("schedule_change_minutes").alias("avg_schedule_change"))


def allocation_summary(asg: DataFrame) -> DataFrame:
    util = runway_efficiency_metrics(asg).agg(F.avg("utilization_rate").alias("average_utilization"))
    one = asg.agg(F.avg("schedule_change_minutes").alias("average_schedule_change"),
                  F.count(F.lit(1)).alias("total_flights_optimized"))
    out = with_scalars(one, util)
    return out.withColumn(
        "throughput_improvement_estimate",
        F.greatest(F.lit(0.0), 15 - F.abs("average_schedule_change")) / 15 * 100)


# K10
def allocation_rollups(asg: DataFrame, by: tuple[str, ...] = ("aircraft_category", "optimized_runway")) -> DataFrame:
    """Rollup of an assignment (category x runway by default; also hour x runway, priority x runway):
    flights, mean suitability, mean schedule change, passengers."""
    keys = [F.hour("optimized_time").alias("hour") if k == "hour" else F.col(k) for k in by]
    return asg.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("flights"), F.avg("suitability_score").alias("avg_suitability"),
        F.avg("schedule_change_minutes").alias("avg_schedule_change"), F.sum("capacity").alias("passengers"))


# K6
def schedule_audit(asg: DataFrame) -> DataFrame:
    """Runway-hours (of one airport) above max ops, duplicate flight assignments and turnaround gaps below 45 minutes."""
    from tarmac.operators.joins import turnaround_violations

    spark = asg.sparkSession
    rw = F.broadcast(spark.createDataFrame([(r, v[1]) for r, v in dims.SUITABILITY_RUNWAYS.items()],
                                           "optimized_runway string, max_ops int"))
    over = asg.groupBy("base_airport", "optimized_runway", F.date_trunc("hour", "optimized_time").alias("h")).agg(F.count(F.lit(1)).alias("n")).join(
        rw, "optimized_runway", "left").filter(F.col("n") > F.coalesce(F.col("max_ops"), F.lit(0))).agg(
        F.count(F.lit(1)).alias("over_capacity_runway_hours"))
    dup = asg.groupBy("flight_id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > 1).agg(
        F.count(F.lit(1)).alias("duplicate_assignments"))
    turn = turnaround_violations(asg, "optimized_time").agg(F.count(F.lit(1)).alias("turnaround_violations"))
    return with_scalars(with_scalars(over, dup), turn)


# K11 - K15
def reschedule_candidates(fl: DataFrame, weather: DataFrame) -> DataFrame:
    """Flights with weather-adjusted delay > 30, runway-hour usage > 85% of capacity, or delay > 45.
    Weather is an input table (the reference draws it at random). Usage is per (base, runway, day, hour), so it
    compares with an hourly capacity however many days the table holds."""
    from tarmac.operators.joins import weather_join

    df = weather_join(fl, weather).withColumnRenamed("hour", "current_hour")
    df = df.withColumns({
        "weather_impact_factor": dims.lit_map(WEATHER_DELAY_IMPACT)[F.col("weather_condition")],
        "runway_capacity_r": F.coalesce(dims.lit_map(RESCHEDULE_RUNWAY_CAPACITY)[F.col("runway")], F.lit(30)),
    })
    df = df.withColumn("weather_adjusted_delay", F.col("delay_minutes") * F.col("weather_impact_factor"))
    # bounded by what one runway handles in an hour
    one_hour = Window.partitionBy("base_airport", "runway", F.to_date("scheduled_time"), "current_hour")
    df = df.withColumn("current_usage", F.count(F.lit(1)).over(one_hour))
    df = df.withColumn("runway_utilization_pct", F.round(F.col("current_usage") / F.col("runway_capacity_r") * 100, 1))
    crit = (F.col("weather_adjusted_delay") > 30) | (F.col("runway_utilization_pct") > 85) | (F.col("delay_minutes") > 45)
    return df.withColumn("needs_reschedule", F.coalesce(crit, F.lit(False)))


def recommend_hour(fl: DataFrame) -> DataFrame:
    """K12 per (base, runway): among hours 6-22 outside 7, 8, 19, 20, 21 the least-used hour
    (first wins ties); usage is the mean per service day of the airport, reported only when it is under 70% of capacity."""
    usage = fl.groupBy("base_airport", "runway", "hour").agg(F.count(F.lit(1)).alias("u"))
    days = fl.groupBy("base_airport").agg(F.count_distinct(F.to_date("scheduled_time")).alias("days"))
    keys = fl.select("base_airport", "runway").distinct().join(days, "base_airport")
    cands = keys.select("base_airport", "runway", "days", F.explode(F.array(*[F.lit(h) for h in CANDIDATE_HOURS])).alias("hour"))
    grid = cands.join(usage, ["base_airport", "runway", "hour"], "left").withColumn("u", F.coalesce("u", F.lit(0)) / F.col("days"))
    best = grid.groupBy("base_airport", "runway").agg(F.min_by(F.struct("u", "hour"), F.struct("u", "hour")).alias("b"))
    return best.select("base_airport", "runway", F.col("b.hour").alias("best_hour"), F.col("b.u").alias("best_hour_usage"))


def reschedule_recommendations(fl: DataFrame, weather: DataFrame) -> DataFrame:
    cand = reschedule_candidates(fl, weather).filter("needs_reschedule")
    rec = recommend_hour(fl)
    df = cand.join(rec, ["base_airport", "runway"], "left")
    util = F.col("best_hour_usage") / F.col("runway_capacity_r") * 100
    tc = F.abs(F.col("best_hour") - F.col("current_hour"))
    wi = F.when(F.col("weather_condition").isin("Heavy Rain", "Storm", "Fog"), 0.8).otherwise(1.0)
    ci = F.greatest(F.lit(0.0), (F.col("runway_utilization_pct") - 70) / 100)
    exp = F.col("delay_minutes") * 0.3 + tc * 2 * wi + ci * 20
    reason = F.concat_ws("; ", F.array_compact(F.array(
        F.when(F.col("weather_impact_factor") > 1.5, F.concat(F.lit("Weather impact ("), F.col("weather_condition"), F.lit(")"))),
        F.when(F.col("runway_utilization_pct") > 85, F.format_string("Runway overcapacity (%.1f%%)", F.col("runway_utilization_pct"))),
        F.when(F.col("delay_minutes") > 45, F.format_string("High delay (%d min)", F.bround("delay_minutes").cast("long"))),
        F.when(tc > 2, F.lit("Peak hour avoidance")),
    )))
    return df.select(
        "flight_id", "airline", "current_hour", F.col("best_hour").alias("recommended_hour"), "runway",
        F.col("delay_minutes").alias("current_delay"), "weather_condition",
        F.col("weather_impact_factor").alias("weather_impact"), F.col("runway_utilization_pct").alias("current_runway_util"),
        F.when(util < 70, util).alias("recommended_runway_util"),
        F.least(exp, F.col("delay_minutes")).alias("expected_delay_reduction"),
        F.when(F.col("delay_minutes") > 60, "High").when(F.col("delay_minutes") > 30, "Medium").otherwise("Low").alias("priority"),
        F.when(reason == "", "General optimization").otherwise(reason).alias("reason"),
    )


def apply_recommendations(fl: DataFrame, recs: DataFrame) -> DataFrame:
    r = recs.select("flight_id", "recommended_hour", "expected_delay_reduction")
    j = fl.join(r, "flight_id", "left")
    moved = F.col("recommended_hour").isNotNull()
    return j.select(
        "flight_id", F.col("hour").alias("current_hour"), "delay_minutes",
        F.when(moved, F.col("recommended_hour")).otherwise(F.col("hour")).alias("optimized_hour"),
        F.when(moved, F.col("delay_minutes") - F.col("expected_delay_reduction")).otherwise(F.col("delay_minutes") * 0.9).alias(
            "optimized_delay"),
        F.when(moved, "Rescheduled").otherwise("Original").alias("status"),
    )


def reschedule_by_weather(recs: DataFrame) -> DataFrame:
    return recs.groupBy("weather_condition").agg(
        F.count("flight_id").alias("flights_affected"), F.avg("expected_delay_reduction").alias("avg_delay_reduction"),
        F.avg("weather_impact").alias("avg_weather_impact"))
