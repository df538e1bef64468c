"""Feature operators.

Counts "per hour" are either window counts over (base, date, hour[, runway]) - a partition that
can never hold more than an hour of one airport's traffic - or, when the reference groups over
the whole table by hour of day, a grouped count joined back through a broadcast of at most
24 x runways rows. Global quantile flags come from a one-row aggregate attached to every row.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tarmac.functions import dims
from tarmac.functions.scalars import with_scalars
from tarmac.functions.windows import with_neighbors

# FIXED VALUES: peak category rank
PEAK_RANK = {"super_peak": 4, "peak": 3, "moderate": 2, "low": 1}
# FIXED VALUES: weather condition -> model score
WEATHER_SCORE = {
    "Clear": 0, "Partly Cloudy": 1, "Cloudy": 1, "Light Rain": 2, "Moderate Rain": 3,
    "Heavy Rain": 4, "Fog": 4, "Thunderstorm": 5,
}


# F1
def add_schedule_features(fl: DataFrame) -> DataFrame:
    hour_w = Window.partitionBy("base_airport", "date", "hour")
    rw_w = Window.partitionBy("base_airport", "date", "hour", "runway")
    return fl.withColumns({
        "hourly_flight_count": F.count(F.lit(1)).over(hour_w),
        "runway_hourly_count": F.count(F.lit(1)).over(rw_w),
    })


# F5
def rolling_delay(fl: DataFrame, k: int = 5) -> DataFrame:
    """Mean/std of the last k delays per base airport in (time, id) order; std of one value -> 0.
    Bucketed by day with a (k-1)-row halo, so a busy airport is spread over its days."""

    def compute(frame: DataFrame, w) -> DataFrame:
        fr = w.rowsBetween(-(k - 1), 0)
        return frame.withColumns({
            "rolling_delay_mean": F.avg("delay_minutes").over(fr),
            "rolling_delay_std": F.coalesce(F.stddev_samp("delay_minutes").over(fr), F.lit(0.0)),
        })

    return with_neighbors(fl, ["base_airport"], ["scheduled_time", "flight_id"], F.col("date"), k - 1, 0, compute)


# F6
def traffic_density(fl: DataFrame) -> DataFrame:
    """Flights per hour of day and per (runway, hour of day), over the whole table."""
    per_hour = fl.groupBy("hour").agg(F.count(F.lit(1)).alias("hourly_traffic_density"))
    per_rw = fl.groupBy("runway", "hour").agg(F.count(F.lit(1)).alias("runway_utilization"))
    return fl.join(F.broadcast(per_hour), "hour", "left").join(per_rw, ["runway", "hour"], "left")


# F9
def capacity_bin(cap: Column) -> Column:
    return (
        F.when((cap > 0) & (cap <= 150), "Small").when((cap > 150) & (cap <= 200), "Medium")
        .when((cap > 200) & (cap <= 250), "Large").when((cap > 250) & (cap <= 350), "XLarge")
    )


# F12
def model_flags(fl: DataFrame) -> DataFrame:
    h = F.col("hour")
    dest3 = F.substring("destination", 1, 3)
    flags = {
        "month": F.month("scheduled_time"),
        "is_weekend": F.col("day_of_week").isin(5, 6).cast("int"),
        "is_morning_peak": h.isin(6, 7, 8, 9).cast("int"),
        "is_evening_peak": h.isin(18, 19, 20, 21).cast("int"),
        "is_night": h.isin(22, 23, 0, 1, 2, 3, 4, 5).cast("int"),
        "is_congested_airport": F.substring("origin", 1, 3).isin("BOM", "DEL").cast("int"),
        "is_large_aircraft": (F.coalesce(F.col("capacity"), F.lit(0)) > 250).cast("int"),
        "is_high_impact_int": F.col("is_high_impact").cast("int"),
    }
    for d in dims.MAJOR_DESTINATIONS:
        flags[f"dest_{d.lower()}"] = (dest3 == d).cast("int")
    return fl.withColumns(flags)


# F10
def quantile_flag(df: DataFrame, col: str, q: float = 0.75, name: str | None = None) -> DataFrame:
    thr = df.agg(F.percentile(col, q).alias(f"_q_{col}"))
    out = with_scalars(df, thr)
    return out.withColumn(name or f"{col}_above_q", (F.col(col) > F.col(f"_q_{col}")).cast("int")).drop(f"_q_{col}")


# F7 / F8
def delay_model_features(fl: DataFrame) -> DataFrame:
    """Scalar model features; optional inputs missing from the table get literal defaults."""
    df = model_flags(add_schedule_features(fl))

    def opt(c: str, default) -> Column:
        return F.coalesce(F.col(c), F.lit(default)) if c in fl.columns else F.lit(default)

    origin_hour = fl.groupBy("origin", "hour").agg(F.count(F.lit(1)).alias("hourly_flights"))
    df = df.join(origin_hour, ["origin", "hour"], "left")
    rep = dims.lit_map(dims.AIRLINE_REPUTATION)[F.col("airline")]
    df = df.withColumns({
        "congestion_factor_f": opt("congestion_factor", 1.0),
        "peak_category_numeric": F.coalesce(dims.lit_map(PEAK_RANK)[F.col("peak_category")], F.lit(2)),
        "runway_efficiency_f": opt("runway_efficiency", 1.0),
        "runway_capacity_f": opt("runway_capacity", 30),
        "runway_utilization": F.coalesce(F.col("hourly_flights") / opt("runway_capacity", 30), F.lit(0.5)),
        "weather_score": F.coalesce(dims.lit_map(WEATHER_SCORE)[opt("weather_condition", "")], F.lit(0)),
        "wind_speed_f": opt("wind_speed", 0.0),
        "visibility_km_f": opt("visibility_km", 10.0),
        "precipitation_mm_f": opt("precipitation_mm", 0.0),
        "airline_reputation": F.coalesce(rep, F.lit(dims.DEFAULT_REPUTATION)),
        "crew_rest_risk": (opt("crew_hours_since_rest", 12.0) < 10).cast("int"),
        "connecting_count": F.lit(0) if "connecting_flights" not in fl.columns else F.size(
            F.filter(F.split(F.coalesce(F.col("connecting_flights"), F.lit("")), ","), lambda x: F.trim(x) != "")),
        "capacity_category": capacity_bin(F.coalesce(F.col("capacity"), F.lit(0))),
    })
    df = quantile_flag(df, "hourly_flight_count", 0.75, "is_congested_hour")
    df = quantile_flag(df, "runway_hourly_count", 0.75, "is_runway_congested")
    return df


#: columns that only share a prefix with the one-hots
RAW_INPUTS = {"runway_efficiency", "runway_capacity"}
MODEL_FEATURES = [
    "hour", "day_of_week", "month", "is_weekend", "is_morning_peak", "is_evening_peak", "is_night",
    "capacity", "is_large_aircraft", "is_high_impact_int", "congestion_factor_f", "peak_category_numeric",
    "runway_efficiency_f", "runway_capacity_f", "is_congested_airport", "runway_utilization", "weather_score",
    "wind_speed_f", "visibility_km_f", "precipitation_mm_f", "airline_reputation", "crew_rest_risk",
    "connecting_count", "hourly_flight_count", "runway_hourly_count", "is_congested_hour", "is_runway_congested",
    "hourly_flights",
] + [f"dest_{d.lower()}" for d in dims.MAJOR_DESTINATIONS]


#: categorical input -> prefix of its one-hot columns
ONE_HOT = {"airline": "airline_", "aircraft_type": "aircraft_", "runway": "runway_", "capacity_category": "cap_"}


# F7 (categorical part)
def one_hot_stages(categories: dict[str, str] = ONE_HOT) -> list:
    """Estimators that turn each category into a sparse vector ``<prefix>vec``, one slot per value in alphabetical
    order. A null or a value not seen in the fit has no slot set. What the fit keeps is the list of the values."""
    index = StringIndexer(inputCols=list(categories), outputCols=[f"{p}index" for p in categories.values()], handleInvalid="keep",
                          stringOrderType="alphabetAsc")
    # the indexer's last index stands for "other"; dropping it leaves all slots empty there
    encode = OneHotEncoder(inputCols=[f"{p}index" for p in categories.values()], outputCols=[f"{p}vec" for p in categories.values()],
                           dropLast=True)
    return [index, encode]


def used_categories(df: DataFrame, categories: dict[str, str] = ONE_HOT) -> dict[str, str]:
    """The categories that the table has and that hold a value in some row; others cannot be encoded."""
    there = [c for c in categories if c in df.columns]
    counts = df.agg(F.count(F.lit(1)), *[F.count(c).alias(c) for c in there]).first()
    return {c: categories[c] for c in there if counts[c]}


def fit_one_hots(df: DataFrame, categories: dict[str, str] = ONE_HOT) -> PipelineModel:
    return Pipeline(stages=one_hot_stages(used_categories(df, categories))).fit(df)


def one_hot_names(indexer: StringIndexerModel) -> dict[str, list[str]]:
    """Vector column -> names of its slots (prefix and value), from a fitted indexer."""
    prefixes = [c.removesuffix("index") for c in indexer.getOutputCols()]
    return {f"{p}vec": [p + v for v in values] for p, values in zip(prefixes, indexer.labelsArray)}


def one_hot_columns(df: DataFrame, model: PipelineModel) -> DataFrame:
    """The slots as 0/1 columns of their own, for reading; models take the vectors."""
    out = model.transform(df)
    names = one_hot_names(model.stages[0])
    arrays = {v: vector_to_array(F.col(v)) for v in names}
    flags = [arrays[v][i].cast("int").alias(n) for v, slots in names.items() for i, n in enumerate(slots)]
    return out.select(*df.columns, *flags)


# F11
def select_features(df: DataFrame, prefixes: tuple[str, ...] = tuple(ONE_HOT.values())) -> list[str]:
    """The scalar inputs that the table has, then the one-hot vectors ``<prefix>vec`` and 0/1 columns of ``prefixes``
    in the table's order. Indices, flags that are no numbers and columns already taken are left out."""
    cols = [c for c in MODEL_FEATURES if c in df.columns]
    numbers = {f.name for f in df.schema.fields if isinstance(f.dataType, (NumericType, VectorUDT))}
    cols += [c for c in df.columns if c in numbers and c.startswith(prefixes) and not c.endswith("index") and c not in cols
             and c not in RAW_INPUTS]
    return cols


# F4 (numeric part) -- FIXED VALUES: aircraft family lists
COMMON_FAMILIES = ["A320", "A330", "A350", "B737", "B747", "B777", "B787"]
WIDE_BODY = ["A330", "A350", "A380", "B747", "B767", "B777", "B787"]


DETECTOR_PEAK_HOURS = [7, 8, 9, 18, 19, 20]  # FIXED VALUES: the detector's own peak hours


def anomaly_features(fl: DataFrame) -> DataFrame:
    """Numeric anomaly features: time parts, delay flags, capacity share of the global max,
    aircraft family flags, rolling delay, hourly and runway-hour densities. A null delay counts
    as 0, a null capacity as 150 and a null congestion factor as 1."""
    fl = fl.withColumns({"delay_minutes": F.coalesce("delay_minutes", F.lit(0.0)), "capacity": F.coalesce("capacity", F.lit(150)),
                         "congestion_factor": F.coalesce("congestion_factor", F.lit(1.0))})
    df = rolling_delay(fl)
    df = traffic_density(df)
    cap_max = fl.agg(F.max("capacity").alias("_cap_max"))
    df = with_scalars(df, cap_max)
    fam = F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(F.col("aircraft_type"), r"\W+", "_"), "([A-Za-z0-9]{1,4})", 1), F.lit("")),
                     F.lit("UNK"))
    cols = {
        "month": F.month("scheduled_time"),
        "day_of_year": F.dayofyear("scheduled_time"),
        "is_delayed": (F.col("delay_minutes") > 0).cast("int"),
        "delay_category": dims.delay_category(F.col("delay_minutes")),
        "capacity_utilization": F.col("capacity") / F.col("_cap_max"),
        "is_peak_hour_int": F.col("hour").isin(DETECTOR_PEAK_HOURS).cast("int"),
        "is_weekend": F.col("day_of_week").isin(5, 6).cast("int"),
        "high_congestion": (F.col("congestion_factor") > 1.5).cast("int"),
        "aircraft_family": fam,
        "is_wide_body": fam.isin(WIDE_BODY).cast("int"),
    }
    for f in COMMON_FAMILIES:
        cols[f"is_{f.lower()}_family"] = F.upper(fam).contains(f).cast("int")
    return df.withColumns(cols).drop("_cap_max")


# F4 (encoded part)
def _clean(c: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("nan")), r"\W+", "_")


def detector_categories(fl: DataFrame, top: int = 10) -> dict[str, list[str]]:
    """The ``top`` airlines by flights (ties: smallest name) and all runways, as a fit keeps them."""
    airlines = fl.groupBy(_clean("airline").alias("v")).count().orderBy(F.desc("count"), "v").limit(top).collect()
    runways = fl.select(_clean("runway").alias("v")).distinct().orderBy("v").collect()  # bounded: runway names
    return {"airline": [r.v for r in airlines], "runway": [r.v for r in runways]}


def detector_flags(feats: DataFrame, categories: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """``feats`` with a flag column per airline and runway of the fit, and the names of all flag inputs. A category
    that the fit has not seen has no flag set."""
    prefix = {"airline": "airline_", "runway": "runway_id_"}
    flags = {f"{prefix[c]}{v}": (_clean(c) == v).cast("int") for c, values in categories.items() for v in values}
    families = [f"is_{f.lower()}_family" for f in COMMON_FAMILIES] + ["is_wide_body"]
    return feats.withColumns(flags), families + list(flags)
