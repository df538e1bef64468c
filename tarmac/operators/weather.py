"""Weather impact operators (X1-X5). Random delay variance of the reference is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import dims
from tarmac.functions.scalars import with_scalars
from tarmac.operators.joins import weather_join

SEVERE = 0.7


def _sens(runway: Column, idx: int) -> Column:
    m = dims.lit_map({r: v[idx] for r, v in dims.RUNWAY_WEATHER_SENSITIVITY.items()})
    return F.coalesce(m[runway], F.lit(1.0))


# X1
def weather_capacity(runway: Column, base_capacity: Column, factor: Column, condition: Column) -> Column:
    red = (
        F.when(condition.contains("Rain"), factor * (2.0 - _sens(runway, 1)))
        .when(condition.contains("Fog"), factor * (2.0 - _sens(runway, 2)))
        .when(condition.contains("Wind"), factor * (2.0 - _sens(runway, 0)))
        .otherwise(factor)
    )
    red = F.when(red < SEVERE, red * _sens(runway, 3)).otherwise(red)
    return F.greatest(F.floor(base_capacity * red).cast("int"), F.lit(5))


# X2
def weather_delay(condition: Column, landing: Column, takeoff: Column, variance: float = 1.0) -> Column:
    base = F.coalesce(dims.lit_map({c: float(v[7]) for c, v in dims.WEATHER.items()})[condition], F.lit(0.0)) * variance
    return F.when(landing | takeoff, base * 1.5).otherwise(base)


# X3
def apply_weather(fl: DataFrame, weather: DataFrame, variance: float = 1.0) -> DataFrame:
    j = weather_join(fl, weather)
    return j.withColumns({
        "weather_adjusted_runway_capacity": weather_capacity(
            F.col("runway"), F.col("runway_capacity"), F.col("capacity_reduction_factor"), F.col("weather_condition")),
        "weather_delay_minutes": weather_delay(
            F.col("weather_condition"), F.col("landing_restrictions"), F.col("takeoff_restrictions"), variance),
    }).withColumns({
        "total_delay_minutes": F.col("delay_minutes") + F.col("weather_delay_minutes"),
        "needs_runway_reassignment": (F.col("runway") == "14/32") & F.col("crosswind_runway_closure"),
    })


# X4
def weather_impact_summary(wx: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    affected = F.count_if(F.col("weather_condition") != "Clear")
    return wx.agg(
        n.alias("total_flights"),
        affected.alias("weather_affected_flights"),
        (affected / n * 100).alias("weather_impact_percentage"),
        ((1 - F.avg("capacity_reduction_factor")) * 100).alias("avg_capacity_reduction_percentage"),
        F.sum("weather_delay_minutes").alias("total_weather_delay_minutes"),
        F.avg("weather_delay_minutes").alias("avg_weather_delay_per_flight"),
        F.count_if("crosswind_runway_closure").alias("crosswind_runway_closures"),
        F.count_if("needs_runway_reassignment").alias("flights_needing_reassignment"),
    )


def weather_hourly_impact(wx: DataFrame) -> DataFrame:
    return wx.groupBy("hour").agg(
        F.avg("weather_delay_minutes").alias("avg_weather_delay"),
        F.avg("capacity_reduction_factor").alias("avg_capacity_factor"),
        F.count_if(F.col("weather_condition") != "Clear").alias("affected_flights"),
    )


# X5
def weather_alerts(wx: DataFrame) -> DataFrame:
    """Severe hours (factor < 0.7): first condition in (time, id) order, flights, capacity impact."""
    sev = wx.filter(F.col("capacity_reduction_factor") < SEVERE)
    return sev.groupBy("hour").agg(
        F.min_by("weather_condition", F.struct("scheduled_time", "flight_id")).alias("condition"),
        F.count(F.lit(1)).alias("affected_flights"),
        ((1 - F.avg("capacity_reduction_factor")) * 100).alias("capacity_impact_pct"),
    )


def weather_high_delay_hours(wx: DataFrame, q: float = 0.8) -> DataFrame:
    h = wx.groupBy("hour").agg(F.sum("weather_delay_minutes").alias("weather_delay"))
    thr = h.agg(F.percentile("weather_delay", q).alias("_q"))
    return with_scalars(h, thr).filter(F.col("weather_delay") > F.col("_q")).drop("_q")
