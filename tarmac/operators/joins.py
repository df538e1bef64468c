"""Join-shaped operators (J1, J3, J9-J12) and neighbour audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import dims
from tarmac.functions.windows import with_neighbors
from tarmac.operators.cleaning import aircraft_category

WEATHER_DEFAULTS = {
    "weather_condition": "Clear", "visibility_km": 10.0, "wind_speed_kts": 5, "precipitation_mm": 0.0,
    "capacity_reduction_factor": 1.0, "landing_restrictions": False, "takeoff_restrictions": False,
    "crosswind_runway_closure": False,
}


# J1
def weather_join(fl: DataFrame, weather: DataFrame) -> DataFrame:
    """Left equi-join on the flight's hour; hours without weather get the clear-sky defaults.
    The weather side has one row per hour (8,760 rows a year), so it is broadcast."""
    hour = F.date_trunc("hour", "scheduled_time").cast("timestamp_ntz")
    j = fl.withColumn("weather_hour", hour).join(F.broadcast(weather), "weather_hour", "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in WEATHER_DEFAULTS.items()})


# J3
def assignment_join(fl: DataFrame, assignments: DataFrame, cols: list[str]) -> DataFrame:
    """Left join of per-flight assignments; unassigned flights keep their original values."""
    renamed = assignments.select("flight_id", *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = fl.join(renamed, "flight_id", "left")
    return j.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in cols}).drop(*[f"_new_{c}" for c in cols])


# J9
def nearest_slot(t: Column, minutes: int = 15) -> Column:
    """Closest grid slot to ``t``; an exact half-way tie goes to the earlier slot."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    secs = F.timestamp_diff("SECOND", epoch, t)
    size = minutes * 60
    lower = F.floor(secs / size) * size
    rem = secs - lower
    start = F.when(rem > size / 2, lower + size).otherwise(lower)
    return F.timestamp_add("SECOND", start, epoch)


# J10
def topk_semi(df: DataFrame, key: str, k: int) -> DataFrame:
    """Rows whose key is among the k most frequent keys (ties by key); the k keys are broadcast."""
    top = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.col("_n").desc(), key).limit(k).select(key)
    return df.join(F.broadcast(top), key, "left_semi")


# J11
def off_peak_anti(fl: DataFrame) -> DataFrame:
    peak = dims.PEAK_HOURS["super_peak"] + dims.PEAK_HOURS["peak"]
    return fl.filter(~F.col("hour").isin(peak))


# J12
def known_label_join(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Predicted anomalies against known ids: left join + flag."""
    t = truth.select("flight_id", F.lit(True).alias("_t"))
    return pred.join(t, "flight_id", "left").withColumn("is_known", F.coalesce(F.col("_t"), F.lit(False))).drop("_t")


# W9
def wake_separation_check(fl: DataFrame, time_col: str = "scheduled_time") -> DataFrame:
    """Previous movement on the same (base, runway); violation when the gap is below the leader ->
    follower separation minutes. Bucketed by day with a one-row halo."""
    wake = dims.lit_map({f"{a}|{b}": m for (a, b), m in dims.WAKE_SEPARATION.items()})
    base = fl.select("flight_id", "base_airport", "runway", time_col, aircraft_category(F.col("aircraft_type")).alias("category"))

    def compute(frame, w):
        return frame.withColumns({
            "leader_id": F.lag("flight_id").over(w),
            "leader_time": F.lag(time_col).over(w),
            "leader_category": F.lag("category").over(w),
        })

    nb = with_neighbors(base, ["base_airport", "runway"], [time_col, "flight_id"], F.to_date(time_col), 1, 0, compute)
    gap = F.timestamp_diff("SECOND", F.col("leader_time"), F.col(time_col)) / 60.0
    req = wake[F.concat_ws("|", F.col("leader_category"), F.col("category"))]
    return nb.filter(F.col("leader_id").isNotNull()).select(
        "flight_id", "base_airport", "runway", "leader_id", "leader_category", "category",
        gap.alias("gap_minutes"), req.alias("required_minutes"), (gap < req).alias("violation"),
    )


# W10
def turnaround_violations(fl: DataFrame, time_col: str = "scheduled_time", min_turnaround: int = 45) -> DataFrame:
    base = fl.select("flight_id", "aircraft_id", time_col)

    def compute(frame, w):
        return frame.withColumns({"prev_id": F.lag("flight_id").over(w), "prev_time": F.lag(time_col).over(w)})

    nb = with_neighbors(base, ["aircraft_id"], [time_col, "flight_id"], F.to_date(time_col), 1, 0, compute)
    gap = F.timestamp_diff("SECOND", F.col("prev_time"), F.col(time_col)) / 60.0
    return nb.filter(F.col("prev_id").isNotNull() & (gap < min_turnaround)).select(
        "flight_id", "aircraft_id", "prev_id", gap.alias("gap_minutes")
    )
