"""Revenue operators (R1-R6): row-local pricing with small literal lookups, then aggregates.

The hour -> (demand, revenue multiplier, business ratio) table has 24 entries, so it is a
``create_map`` literal inside the projection (no join at all). The "try the super-peak hours in
order, keep a running best" search of R2 is unrolled over the fixed 4-hour list on precomputed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import dims

SUPER_PEAK_TRY = [7, 8, 19, 20]
SEMI_PEAK = [6, 9, 18, 21]


def _slot(hour: Column, idx: int) -> Column:
    """Revenue slot field for an hour (unknown hour -> hour 12)."""
    m = dims.lit_map({h: v[idx] for h, v in dims.REVENUE_SLOTS.items()})
    return F.coalesce(m[hour], F.lit(dims.REVENUE_SLOTS[12][idx]))


def revenue_expr(hour: Column, capacity: Column, priority: Column, peak: Column) -> Column:
    """R1 for one (hour, peak category) choice."""
    demand, mult, ratio = _slot(hour, 0), _slot(hour, 1), _slot(hour, 3)
    base = dims.lit_map(dims.BASE_PRICES)[priority]
    final = base * mult * (1 + dims.lit_map(dims.PEAK_PREMIUMS)[peak])
    load = F.least(F.lit(0.95), demand * 0.75)
    econ = capacity * load * (1 - ratio * 0.15)
    bus = capacity * load * (ratio * 0.15)
    return econ * final + bus * final * 2.8


def _fixed_hour_revenue(hour: int, peak: str) -> Column:
    """``revenue_expr`` for a literal hour and category: the hour terms are folded to constants
    (same operation order), leaving one 3-entry price lookup per row."""
    demand, mult, _, ratio = dims.REVENUE_SLOTS.get(hour, dims.REVENUE_SLOTS[12])
    finals = {p: b * mult * (1 + dims.PEAK_PREMIUMS[peak]) for p, b in dims.BASE_PRICES.items()}
    final = dims.lit_map(finals)[F.col("destination_priority")]
    load = min(0.95, demand * 0.75)
    cap = F.col("capacity")
    return cap * load * (1 - ratio * 0.15) * final + cap * load * (ratio * 0.15) * final * 2.8


# R1
def flight_revenue(fl: DataFrame) -> DataFrame:
    return fl.withColumn(
        "current_revenue", revenue_expr(F.col("hour"), F.col("capacity"), F.col("destination_priority"), F.col("peak_category"))
    )


# R2
def revenue_moves(fl: DataFrame) -> DataFrame:
    """Per flight: try hours 7, 8, 19, 20 (skipping its own) as super-peak; a candidate is kept when it
    beats the running best by 5%. Flights with a recommendation only."""
    df = flight_revenue(fl)
    # candidate revenues are plain columns (each computed once); the running-best fold over the
    # fixed list is unrolled on those columns, so every step only compares attributes
    df = df.withColumns({f"_alt{h}": _fixed_hour_revenue(h, "super_peak") for h in SUPER_PEAK_TRY})
    best, hour = F.col("current_revenue"), F.lit(None).cast("int")
    for h in SUPER_PEAK_TRY:
        take = (F.col("hour") != h) & (F.col(f"_alt{h}") > best * 1.05)
        best, hour = F.when(take, F.col(f"_alt{h}")).otherwise(best), F.when(take, F.lit(h)).otherwise(hour)
    df = df.withColumn("_r", F.struct(best.alias("best"), hour.alias("hour"))).filter(F.col("_r.hour").isNotNull())
    inc = F.col("_r.best") - F.col("current_revenue")
    return df.select(
        "flight_id", F.col("hour").alias("current_hour"), F.col("_r.hour").alias("recommended_hour"), "current_revenue",
        F.col("_r.best").alias("projected_revenue"), inc.alias("revenue_increase"),
        (inc / F.col("current_revenue") * 100).alias("percentage_increase"),
    )


# R3
def revenue_multipliers(fl: DataFrame) -> DataFrame:
    return fl.withColumns({
        "revenue_per_hour_multiplier": _slot(F.col("hour"), 1),
        "demand_multiplier": _slot(F.col("hour"), 0),
    })


# R4
def hourly_revenue(fl: DataFrame) -> DataFrame:
    h = flight_revenue(fl).groupBy("hour").agg(
        F.count("flight_id").alias("flight_count"),
        F.sum("current_revenue").alias("total_revenue"),
        F.avg("current_revenue").alias("avg_revenue_per_flight"),
        F.sum("capacity").alias("total_capacity"),
    )
    return h.withColumns({
        "revenue_per_flight": F.col("total_revenue") / F.col("flight_count"),
        "revenue_per_passenger": F.col("total_revenue") / F.col("total_capacity"),
    })


# R5
def peak_consolidation(fl: DataFrame) -> DataFrame:
    df = flight_revenue(fl)
    off_peak = ~F.col("hour").isin(SUPER_PEAK_TRY + SEMI_PEAK)
    one = df.agg(
        F.count_if(F.col("hour").isin(SUPER_PEAK_TRY)).alias("current_super_peak_flights"),
        F.count("flight_id").alias("total_flights"),
        F.sum("current_revenue").alias("current_total_revenue"),
        F.avg("current_revenue").alias("_avg"),
        F.count_if(off_peak).alias("_off"),
    )
    pot = F.col("_off") * 0.6 * F.col("_avg") * (1.6 - 1)
    return one.select(
        "current_super_peak_flights", "total_flights",
        (F.col("current_super_peak_flights") / F.col("total_flights") * 100).alias("peak_utilization_percentage"),
        "current_total_revenue", pot.alias("potential_additional_revenue"),
        (pot / F.col("current_total_revenue") * 100).alias("revenue_increase_percentage"),
    )


# R6
def net_revenue_simple(fl: DataFrame) -> DataFrame:
    cap = F.coalesce(F.col("capacity"), F.lit(150))
    mult = F.when(F.col("hour").isin(SUPER_PEAK_TRY), 1.4).when(F.col("hour").isin(SEMI_PEAK), 1.2).otherwise(1.0)
    return fl.select(
        "flight_id", "hour", cap.alias("capacity"), (cap * 200).alias("base_revenue"), mult.alias("revenue_multiplier"),
        (F.col("delay_minutes") * 50).alias("delay_cost"), (cap * 200 * mult - F.col("delay_minutes") * 50).alias("net_revenue"),
        "delay_minutes",
    )


def net_revenue_summary(fl: DataFrame) -> DataFrame:
    r = net_revenue_simple(fl)
    one = r.agg(
        F.sum("net_revenue").alias("total_revenue"), F.sum("delay_cost").alias("total_delay_cost"),
        F.sum("base_revenue").alias("_b"), F.avg("revenue_multiplier").alias("_m"),
        F.count_if(F.col("delay_cost") > 1000).alias("flights_delay_cost_over_1000"),
    )
    return one.select("total_revenue", "total_delay_cost", (F.col("_b") * F.col("_m")).alias("potential_revenue"),
                      "flights_delay_cost_over_1000")

