"""Summary tables over the flight table (hash aggregates, conditional aggregates, quantiles).

All are declarative ``groupBy().agg()`` plans: Spark runs a partial (map-side) aggregate per
task and a final aggregate after a shuffle keyed by the group columns, so the shuffle carries
one row per group per task, whatever the table size. Groups here are small (hours, runways,
airlines), so results are tiny and any window over the *aggregated* frame is cheap.
Quantiles use exact ``percentile``; on minute-valued delays its buffer is bounded by the
number of distinct values, not rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import dims
from tarmac.functions.scalars import with_scalars

def _d() -> Column:
    return F.col("delay_minutes")


def _wall() -> Window:
    """Whole-frame window: only ever applied to aggregated (small) frames."""
    return Window.partitionBy()


def _ndistinct_small(col: str) -> Column:
    """Distinct count of a low-cardinality column (runways, hours): a set merged in the partial
    aggregate, so the query keeps one shuffle instead of the expand + two-phase distinct plan."""
    return F.size(F.collect_set(col)).cast("long")


def _rank_flags(df: DataFrame, score: str, key: str, top: int, bottom: int) -> DataFrame:
    """Top-k / bottom-k markers with a total order (score, key) instead of a truncated result."""
    desc = Window.orderBy(F.col(score).desc(), F.col(key))
    asc = Window.orderBy(F.col(score).asc(), F.col(key))
    return df.withColumn("top_rank", F.row_number().over(desc).cast("long")).withColumn(
        "is_top", F.col("top_rank") <= top
    ).withColumn("is_bottom", F.row_number().over(asc) <= bottom)


# A1 / A2 ---------------------------------------------------------------------------------------
def _hour_dow_base(fl: DataFrame) -> DataFrame:
    return fl.groupBy("hour", "day_of_week").agg(
        F.count("flight_id").alias("flight_count"),
        F.avg(_d()).alias("avg_delay"),
        F.stddev_samp(_d()).alias("delay_std"),
        F.max(_d()).alias("max_delay"),
        F.sum("capacity").alias("total_passengers"),
        _ndistinct_small("runway").alias("active_runways"),
    )


def hourly_dow_stats(fl: DataFrame) -> DataFrame:
    """A1: hour x weekday statistics with the weighted congestion score."""
    df = _hour_dow_base(fl).withColumn("flights_per_runway", F.col("flight_count") / F.col("active_runways"))
    return df.withColumn(
        "congestion_score",
        F.col("flight_count") * 0.4 + F.col("avg_delay") * 0.3 + F.col("flights_per_runway") * 0.3,
    )


def hourly_dow_basic(fl: DataFrame) -> DataFrame:
    """A2: same keys, congestion = 0.1 x count."""
    return _hour_dow_base(fl).withColumn("congestion_score", F.col("flight_count") * 0.1)


# A3
def peak_hours(fl: DataFrame, factor: float = 1.2) -> DataFrame:
    h = fl.groupBy("hour").agg(F.count(F.lit(1)).alias("flight_count"))
    h = h.withColumn("_m", F.avg("flight_count").over(_wall()))
    return h.filter(F.col("flight_count") > F.col("_m") * factor).drop("_m")


# A4
def delay_summary(fl: DataFrame) -> DataFrame:
    return fl.agg(
        F.count(F.lit(1)).alias("total_flights"),
        F.count_if(_d() > 0).alias("delayed_flights"),
        (F.count_if(_d() > 0) * 100.0 / F.count(F.lit(1))).alias("delay_rate"),
        F.avg(_d()).alias("avg_delay"),
        F.max(_d()).alias("max_delay"),
        F.percentile(_d(), 0.5).alias("median_delay"),
        F.count_if(_d() > 30).alias("over_30"),
        F.count_if(_d() > 60).alias("over_60"),
    )


# A5
def runway_utilization(fl: DataFrame) -> DataFrame:
    r = fl.groupBy("runway").agg(
        F.count("flight_id").alias("flight_count"), F.avg(_d()).alias("avg_delay"), F.sum("capacity").alias("total_passengers")
    )
    return r.withColumn("utilization_score", F.col("flight_count") * 100.0 / F.max("flight_count").over(_wall()))


# A6
def runway_efficiency(fl: DataFrame) -> DataFrame:
    r = fl.groupBy("runway").agg(
        F.count("flight_id").alias("flight_count"),
        F.avg(_d()).alias("avg_delay"),
        F.sum(_d()).alias("total_delay"),
        F.sum("capacity").alias("total_passengers"),
        _ndistinct_small("hour").alias("hours_used"),
    )
    return r.withColumn("flights_per_hour", F.col("flight_count") / F.col("hours_used")).withColumn(
        "efficiency_score", F.col("flight_count") / (F.col("avg_delay") + 1)
    )


# A7
def runway_delay_table(fl: DataFrame) -> DataFrame:
    return fl.groupBy("runway").agg(
        F.avg(_d()).alias("avg_delay"), F.sum(_d()).alias("total_delay"), F.count(_d()).alias("delayed_flights"),
        F.count("flight_id").alias("total_flights"),
    )


# A8
def airline_performance(fl: DataFrame) -> DataFrame:
    a = fl.groupBy("airline").agg(
        F.count("flight_id").alias("flight_count"),
        F.avg(_d()).alias("avg_delay"),
        F.sum(_d()).alias("total_delay"),
        F.stddev_samp(_d()).alias("delay_std"),
        F.sum("capacity").alias("total_passengers"),
        F.avg("capacity").alias("avg_capacity"),
    )
    return a.withColumn("on_time_rate", 85 - F.col("avg_delay")).withColumn(
        "performance_score", F.col("flight_count") / (F.col("avg_delay") + 1)
    )


# A9
def airline_compare(fl: DataFrame) -> DataFrame:
    a = fl.groupBy("airline").agg(
        F.count("flight_id").alias("total_flights"),
        F.avg(_d()).alias("avg_delay"),
        F.sum(_d()).alias("total_delay"),
        F.avg("capacity").alias("avg_capacity"),
    )
    a = a.withColumn(
        "performance_score",
        (1 / (F.col("avg_delay") + 1)) * F.col("total_flights") / F.max("total_flights").over(_wall()) * 100,
    )
    # idxmax / idxmin: extreme score, ties to the smallest airline
    best = F.min_by(F.struct("airline", "avg_delay"), F.struct(-F.col("performance_score"), F.col("airline"))).over(_wall())
    worst = F.min_by(F.struct("airline", "avg_delay"), F.struct(F.col("performance_score"), F.col("airline"))).over(_wall())
    a = a.withColumn("_b", best).withColumn("_w", worst)
    return a.select(
        "airline", "total_flights", "avg_delay", "total_delay", "avg_capacity", "performance_score",
        F.col("_b.airline").alias("best_airline"), F.col("_w.airline").alias("worst_airline"),
        (F.col("_w.avg_delay") - F.col("_b.avg_delay")).alias("improvement_potential"),
    )


# A10
def airline_delay_rate(fl: DataFrame) -> DataFrame:
    a = fl.groupBy("airline").agg(F.avg(_d()).alias("avg_delay"), F.count(_d()).alias("delayed_flights"),
                                  F.count("flight_id").alias("total_flights"))
    return a.withColumn("delay_rate", F.col("delayed_flights") / F.col("total_flights") * 100)


# A11
def congestion_metrics(fl: DataFrame) -> DataFrame:
    sp = F.col("peak_category") == "super_peak"
    n = F.count(F.lit(1))
    return fl.agg(
        F.count_if(sp).alias("super_peak_flights"),
        (F.count_if(sp) * 100.0 / n).alias("super_peak_pct"),
        F.avg("congestion_factor").alias("avg_congestion"),
        F.avg(F.when(sp, _d())).alias("super_peak_avg_delay"),
        F.avg("runway_efficiency").alias("avg_runway_efficiency"),
        F.count_if(F.col("congestion_factor") > 1.5).alias("high_congestion_flights"),
        (F.count_if(F.col("congestion_factor") > 1.5) * 100.0 / n).alias("high_congestion_pct"),
    )


# A12
def peak_category_breakdown(fl: DataFrame) -> DataFrame:
    return fl.groupBy("peak_category").agg(
        F.count(_d()).alias("flight_count"),
        F.avg(_d()).alias("avg_delay"),
        F.sum(_d()).alias("total_delay"),
        F.avg("congestion_factor").alias("avg_congestion"),
    )


# A13
def delay_by_hour(fl: DataFrame) -> DataFrame:
    return fl.groupBy("hour").agg(
        F.avg(_d()).alias("avg_delay"), F.count(F.lit(1)).alias("flight_count"), F.count_if(_d() > 0).alias("delayed_count")
    )


# A14
def delay_heatmap(fl: DataFrame) -> DataFrame:
    """Day name x hour mean delay, one column per hour h0..h23 (fixed pivot values: no extra pass)."""
    p = (
        fl.withColumn("day_name", F.date_format("scheduled_time", "EEEE"))
        .groupBy("day_of_week", "day_name")
        .pivot("hour", list(range(24)))
        .agg(F.avg(_d()))
    )
    return p.select("day_of_week", "day_name", *[F.col(str(h)).alias(f"h{h}") for h in range(24)])


# A15
def congestion_heatmap(fl: DataFrame) -> DataFrame:
    p = hourly_dow_stats(fl).groupBy("day_of_week").pivot("hour", list(range(24))).agg(F.first("congestion_score"))
    return p.select("day_of_week", *[F.col(str(h)).alias(f"h{h}") for h in range(24)])


# A16
def best_times(fl: DataFrame) -> DataFrame:
    h = fl.groupBy("hour").agg(
        F.count("flight_id").alias("flight_count"),
        F.avg(_d()).alias("avg_delay"),
        F.stddev_samp(_d()).alias("delay_std"),
        F.min(_d()).alias("min_delay"),
        F.max(_d()).alias("max_delay"),
        F.sum("capacity").alias("total_passengers"),
    )
    h = h.withColumn(
        "performance_score", (1 / (F.col("avg_delay") + 1)) * (F.col("flight_count") / F.max("flight_count").over(_wall()))
    )
    return _rank_flags(h, "performance_score", "hour", 5, 3)


# A17
def optimal_hours_quantile(fl: DataFrame, q: float = 0.3, min_flights: int = 5) -> DataFrame:
    h = fl.groupBy("hour").agg(
        F.avg(_d()).alias("avg_delay"), F.stddev_samp(_d()).alias("delay_std"), F.count("flight_id").alias("flight_count")
    )
    h = h.withColumn("_q", F.percentile("avg_delay", q).over(_wall()))
    return h.filter((F.col("avg_delay") < F.col("_q")) & (F.col("flight_count") >= min_flights)).drop("_q")


# A18
def busiest_times(fl: DataFrame) -> DataFrame:
    h = fl.groupBy("hour").agg(
        F.count("flight_id").alias("flight_count"),
        F.avg(_d()).alias("avg_delay"),
        F.sum(_d()).alias("total_delay"),
        F.sum("capacity").alias("total_passengers"),
        _ndistinct_small("runway").alias("runways_used"),
    )
    h = h.withColumn(
        "congestion_score", F.col("flight_count") * F.col("avg_delay") * F.col("total_passengers") / 10000
    ).withColumn("traffic_density", F.col("flight_count") / F.col("runways_used"))
    return _rank_flags(h, "congestion_score", "hour", 5, 5)


# A19
def peaks_to_avoid(fl: DataFrame, q: float = 0.7) -> DataFrame:
    h = fl.groupBy("hour").agg(
        F.count("flight_id").alias("flight_count"), F.avg(_d()).alias("avg_delay"), F.sum("capacity").alias("total_capacity")
    )
    h = h.withColumn("congestion_score", F.col("flight_count") * F.col("avg_delay") / 100)
    h = h.withColumn("_q", F.percentile("congestion_score", q).over(_wall()))
    return h.filter(F.col("congestion_score") >= F.col("_q")).drop("_q")


# A20
def over_under_loaded(fl: DataFrame, high: float = 0.8, low: float = 0.3) -> DataFrame:
    h = fl.groupBy("hour").agg(F.avg(_d()).alias("avg_delay"), F.count(_d()).alias("flight_count"))
    h = h.withColumn("_hi", F.percentile("flight_count", high).over(_wall())).withColumn(
        "_lo", F.percentile("flight_count", low).over(_wall())
    )
    load = F.when(F.col("flight_count") > F.col("_hi"), "overloaded").when(F.col("flight_count") < F.col("_lo"), "underutilized")
    return h.withColumn("load_class", load).filter(F.col("load_class").isNotNull()).drop("_hi", "_lo")


# A21
def capacity_by_hour(fl: DataFrame) -> DataFrame:
    h = fl.groupBy("hour").agg(
        F.count(F.lit(1)).alias("operations"),
        _ndistinct_small("runway").alias("runways_used"),
        F.sum("capacity").alias("passengers"),
    )
    h = h.withColumn("ops_per_runway", F.col("operations") / F.col("runways_used"))
    return h.withColumn("peak_hour", F.max_by("hour", F.struct(F.col("operations"), -F.col("hour"))).over(_wall()))


# A22
def hourly_forecast(fl: DataFrame) -> DataFrame:
    """24-row grid; hours without flights get the fixed defaults 10 / 50 / Low / 5."""
    spark = fl.sparkSession
    h = fl.groupBy("hour").agg(
        F.avg(_d()).alias("hist_avg"), F.stddev_samp(_d()).alias("hist_std"), F.count(_d()).alias("sample_size")
    )
    grid = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    j = grid.join(F.broadcast(h), "hour", "left")  # aggregated side: at most 24 rows
    pred = F.coalesce(F.col("hist_avg"), F.lit(10.0))
    return j.select(
        "hour",
        pred.alias("predicted_delay"),
        F.when(F.col("sample_size").isNull(), F.lit(50)).otherwise(F.least(F.lit(95), F.col("sample_size") * 5)).cast("long").alias("confidence"),
        F.when(pred > 25, "High").when(pred > 15, "Medium").otherwise("Low").alias("risk_level"),
        F.when(F.col("sample_size").isNull(), F.lit(5.0)).otherwise(F.col("hist_std")).alias("variance"),
    )


# A23
def weekly_risk_grid(fl: DataFrame, start_date: str = "2024-02-01") -> DataFrame:
    """7 days x hours 6..22: risk from the hour's history, scaled by weekday and hour factors.

    The start date is a parameter (the reference uses "now") and its random confidence is dropped.
    """
    spark = fl.sparkSession
    h = fl.groupBy("hour").agg(F.avg(_d()).alias("expected_avg_delay"), F.count(F.lit(1)).alias("expected_flights"))
    # fixed 7 x 17 grid generated directly (day = id // 17, hour = 6 + id % 17)
    grid = spark.range(7 * 17).select(
        F.date_add(F.to_date(F.lit(start_date)), (F.col("id") / 17).cast("int")).alias("date"),
        (F.col("id") % 17 + 6).cast("int").alias("hour"),
    )
    g = grid.join(F.broadcast(h), "hour", "inner")  # hours without flights produce no row
    dow = F.weekday("date")
    base = F.least(F.col("expected_avg_delay") * 0.8 + F.col("expected_flights") * 0.3, F.lit(100.0))
    dow_f = F.when(dow.isin(0, 4), 1.2).when(dow.isin(5, 6), 0.8).otherwise(1.0)
    hour_f = F.when(F.col("hour").isin(7, 8, 19, 20), 1.4).when(F.col("hour").isin(11, 12, 13, 14), 1.1).otherwise(1.0)
    risk = base * dow_f * hour_f
    level = F.when(risk >= 70, "Critical").when(risk >= 50, "High").when(risk >= 30, "Medium").otherwise("Low")
    return g.select("date", "hour", risk.alias("delay_risk"), level.alias("risk_level"), "expected_flights", "expected_avg_delay")


# A24
def schedule_tuning(fl: DataFrame) -> DataFrame:
    """Hours with mean delay > 20 are paired with the lowest-numbered hour whose mean delay < 15."""
    h = fl.groupBy("hour").agg(F.count("flight_id").alias("current_flights"), F.avg(_d()).alias("current_delay"))
    target = h.filter(F.col("current_delay") < 15).agg(F.min("hour").alias("recommended_hour"))
    bad = h.filter(F.col("current_delay") > 20)
    j = with_scalars(bad, target).filter(F.col("recommended_hour").isNotNull())  # 1-row right side
    moved = F.least(F.floor(F.col("current_flights") / 3), F.lit(10)).cast("long")
    proj = F.col("current_delay") * 0.7
    return j.select(
        F.col("hour").alias("original_hour"),
        "recommended_hour",
        moved.alias("flights_to_move"),
        "current_delay",
        proj.alias("projected_delay"),
        (F.col("current_delay") - proj).alias("delay_reduction"),
        (moved * (F.col("current_delay") - proj)).alias("impact_score"),
    )


# A25
def redistribution_potential(fl: DataFrame) -> DataFrame:
    r = runway_utilization(fl)
    return r.agg(
        F.sum(F.when(F.col("utilization_score") > 80, F.col("flight_count"))).alias("overused_flights"),
        F.sum(F.when(F.col("utilization_score") < 50, F.col("flight_count"))).alias("underused_flights"),
        F.count_if(F.col("utilization_score") > 80).alias("overused_runways"),
        F.count_if(F.col("utilization_score") < 50).alias("underused_runways"),
    ).withColumn(
        "potential_redistribution",
        F.when(
            (F.col("overused_runways") > 0) & (F.col("underused_runways") > 0),
            F.least(F.col("overused_flights") * 0.2, F.col("underused_flights") * 0.5),
        ),
    )


def hour_redistribution(fl: DataFrame) -> DataFrame:
    """A25 (hours): flights to move = 15% of (mean of the 3 busiest hours - mean of the 3 quietest)."""
    h = fl.groupBy("hour").agg(F.count("flight_id").alias("c"), F.avg(_d()).alias("m"))
    h = h.withColumn("_hi", F.row_number().over(Window.orderBy(F.col("c").desc(), "hour"))).withColumn(
        "_lo", F.row_number().over(Window.orderBy(F.col("c").asc(), "hour")))
    one = h.agg(F.avg(F.when(F.col("_hi") <= 3, F.col("c"))).alias("peak_mean_flights"),
                F.avg(F.when(F.col("_lo") <= 3, F.col("c"))).alias("off_peak_mean_flights"))
    return one.withColumn("flights_to_move", (F.col("peak_mean_flights") - F.col("off_peak_mean_flights")) * 0.15)


# A26
def system_overview(fl: DataFrame) -> DataFrame:
    """One row; busiest key = highest count, ties to the smallest key."""
    def busiest_sorted(col: str) -> DataFrame:
        c = fl.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
        w = Window.orderBy(F.col("n").desc(), F.col(col))
        return c.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(F.col(col).alias(f"busiest_{col}"))

    overall = fl.agg(
        F.count(F.lit(1)).alias("total_flights"),
        F.avg(_d()).alias("avg_delay"),
        F.countDistinct("airline").alias("total_airlines"),
        F.countDistinct("runway").alias("total_runways"),
        (F.count_if(_d() > 0) * 100.0 / F.count(F.lit(1))).alias("delay_rate"),
    )
    return with_scalars(with_scalars(with_scalars(overall, busiest_sorted("runway")), busiest_sorted("airline")), busiest_sorted("hour"))


# A27
def delay_breakdown(fl: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    hourly = fl.groupBy("hour").agg(F.avg(_d()).alias("m"))
    ext = hourly.agg(
        F.max_by("hour", F.struct(F.col("m"), -F.col("hour"))).alias("worst_hour"),
        F.min_by("hour", F.struct(F.col("m"), F.col("hour"))).alias("best_hour"),
    )
    counts = fl.agg(
        n.alias("_n"),
        F.count_if((_d() > 0) & (_d() <= 15)).alias("minor"),
        F.count_if((_d() > 15) & (_d() <= 30)).alias("moderate"),
        F.count_if(_d() > 30).alias("major"),
    )
    rows = counts.select(
        "_n",
        F.inline(
            F.array(
                F.struct(F.lit("Minor (1-15 min)").alias("delay_category"), F.col("minor").alias("flight_count")),
                F.struct(F.lit("Moderate (16-30 min)").alias("delay_category"), F.col("moderate").alias("flight_count")),
                F.struct(F.lit("Major (>30 min)").alias("delay_category"), F.col("major").alias("flight_count")),
            )
        ),
    )
    rows = rows.withColumn("percentage", F.col("flight_count") * 100.0 / F.col("_n")).drop("_n")
    return with_scalars(rows, ext)


# A28
def describe_numeric(fl: DataFrame, cols: tuple[str, ...] = ("delay_minutes", "capacity", "congestion_factor", "runway_efficiency")) -> DataFrame:
    """count/mean/std/min/quartiles/max per column in ONE aggregate pass, then unpivoted."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [
            F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
            F.min(x).alias(f"{c}__min"), F.percentile(x, 0.25).alias(f"{c}__p25"), F.percentile(x, 0.5).alias(f"{c}__p50"),
            F.percentile(x, 0.75).alias(f"{c}__p75"), F.max(x).alias(f"{c}__max"),
        ]
    one = fl.agg(*aggs)
    structs = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"{c}__count").alias("count"), F.col(f"{c}__mean").alias("mean"),
            F.col(f"{c}__std").alias("std"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__p25").alias("p25"),
            F.col(f"{c}__p50").alias("p50"), F.col(f"{c}__p75").alias("p75"), F.col(f"{c}__max").alias("max"),
        )
        for c in cols
    ]
    return one.select(F.inline(F.array(*structs)))


# A29
def operating_cost(fl: DataFrame) -> DataFrame:
    t = F.sum(_d())
    return fl.agg(
        t.alias("total_delay_minutes"),
        (t * 1000).alias("delay_cost"),
        (t * 50).alias("fuel_waste_l"),
        (t * 200).alias("crew_cost"),
        (t * 500).alias("cost_500_per_min"),
        (t * 100).alias("cost_100_per_min"),
    )


# A30
def fleet_utilization(fl: DataFrame, top: int = 10) -> DataFrame:
    a = fl.groupBy("aircraft_id").agg(
        F.count("flight_id").alias("daily_flights"), F.avg(_d()).alias("avg_delay"), F.avg("capacity").alias("avg_capacity")
    )
    a = a.withColumn("utilization_score", F.col("daily_flights") * F.col("avg_capacity") / (F.col("avg_delay") + 1))
    return a.orderBy(F.col("utilization_score").desc(), "aircraft_id").limit(top)


# A31
def aircraft_impact(fl: DataFrame, top: int = 10) -> DataFrame:
    a = fl.groupBy("aircraft_id").agg(
        F.avg(_d()).alias("mean_delay"), F.count(_d()).alias("flight_count"), F.coalesce(F.stddev_samp(_d()), F.lit(0.0)).alias("std_delay")
    )
    a = a.withColumn("impact_score", F.col("mean_delay") * F.col("flight_count") / 100)
    return a.orderBy(F.col("impact_score").desc(), "aircraft_id").limit(top)


# A32
def disruptive_flights(fl: DataFrame, top: int = 10) -> DataFrame:
    a = (
        fl.filter(_d() > 30)
        .groupBy("flight_id")
        .agg(
            F.sum(_d()).alias("total_delay"),
            F.min_by("aircraft_id", "scheduled_time").alias("aircraft_id"),
            F.min_by("airline", "scheduled_time").alias("airline"),
        )
    )
    return a.orderBy(F.col("total_delay").desc(), "flight_id").limit(top)


# A33
def on_time_metrics(fl: DataFrame) -> DataFrame:
    hourly_max = fl.groupBy("hour").agg(F.avg(_d()).alias("m")).agg(F.max("m").alias("worst_hourly_avg_delay"))
    n = F.count(F.lit(1))
    o = fl.agg(
        n.alias("total_ops"),
        (F.count_if(_d() <= 15) * 100.0 / n).alias("on_time_rate"),
        (F.count_if(_d() > 60) * 100.0 / n).alias("severe_delay_rate"),
        F.avg(_d()).alias("avg_turnaround_delay"),
        (n / F.countDistinct("runway")).alias("ops_per_runway"),
    )
    per_runway = fl.groupBy("runway").agg(F.count("aircraft_type").alias("c")).agg(
        F.avg("c").alias("mean_flights_per_runway"), F.max("c").alias("max_flights_per_runway"))
    return with_scalars(with_scalars(o, hourly_max), per_runway)


# A34
def delay_patterns(fl: DataFrame) -> DataFrame:
    hourly = fl.groupBy("hour").agg(F.avg(_d()).alias("m")).agg(
        F.min_by("hour", F.struct("m", "hour")).alias("best_hour"),
        F.max_by("hour", F.struct(F.col("m"), -F.col("hour"))).alias("worst_hour"),
    )
    airline = fl.groupBy("airline").agg(F.avg(_d()).alias("m")).agg(
        F.min_by("airline", F.struct("m", "airline")).alias("best_airline"),
        F.min_by("airline", F.struct(-F.col("m"), F.col("airline"))).alias("worst_airline"),
    )
    daily = fl.groupBy("date").agg(F.avg(_d()).alias("m"))
    w = Window.orderBy(F.col("date").desc())
    recent = daily.withColumn("_r", F.row_number().over(w)).filter("_r <= 3").agg(F.avg("m").alias("recent_avg_delay"))
    return with_scalars(with_scalars(hourly, airline), recent)


# A35
def operational_issues(fl: DataFrame) -> DataFrame:
    """Rules evaluated on one aggregate row, emitted as one row per triggered issue."""
    n = F.count(F.lit(1))
    runway = fl.groupBy("runway").agg(F.count(F.lit(1)).alias("c")).agg(
        F.max("c").alias("rw_max"), F.avg("c").alias("rw_mean")
    )
    one = with_scalars(fl.agg((F.count_if(_d() > 15) / n).alias("late_rate"), F.count_if(_d() > 120).alias("extreme")), runway)
    issues = F.array(
        F.when(F.col("late_rate") > 0.3, F.struct(F.lit("high_delay_rate").alias("issue"), F.col("late_rate").cast("double").alias("value"))),
        F.when(F.col("rw_max") > F.col("rw_mean") * 2,
               F.struct(F.lit("runway_imbalance").alias("issue"), F.col("rw_max").cast("double").alias("value"))),
        F.when(F.col("extreme") > 0, F.struct(F.lit("extreme_delays").alias("issue"), F.col("extreme").cast("double").alias("value"))),
    )
    return one.select(F.inline(F.filter(issues, lambda x: x.isNotNull())))


# A36
def rule_recommendations(fl: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    runway = fl.groupBy("runway").agg(F.count("flight_id").alias("c")).agg(
        F.stddev_samp("c").alias("rw_std"), F.avg("c").alias("rw_mean")
    )
    hourly = fl.groupBy("hour").agg(F.count("flight_id").alias("c")).agg(
        F.max("c").alias("h_max"), F.avg("c").alias("h_mean"),
        F.max_by("hour", F.struct(F.col("c"), -F.col("hour"))).alias("peak_hour"),
    )
    util = runway_utilization(fl).agg(F.count_if(F.col("utilization_score") > 80).alias("overutilized"))
    one = fl.agg(F.avg(_d()).alias("avg_delay"), (F.count_if(_d() > 0) * 100.0 / n).alias("delay_rate"))
    one = with_scalars(with_scalars(with_scalars(one, runway), hourly), util)
    level = (
        F.when(F.col("avg_delay") > 20, "HIGH_PRIORITY").when(F.col("avg_delay") > 10, "MEDIUM_PRIORITY").otherwise("MAINTENANCE")
    )
    def rec(no: int, text: Column) -> Column:
        return F.struct(F.lit(no).alias("rule_no"), text.alias("recommendation"))

    recs = F.array(
        rec(1, level),
        F.when(F.col("rw_std") > F.col("rw_mean") * 0.3, rec(2, F.lit("balance_runways"))),
        F.when(F.col("h_max") > F.col("h_mean") * 1.5,
               rec(3, F.concat(F.lit("redistribute_from_hour_"), F.col("peak_hour").cast("string")))),
        F.when(F.col("delay_rate") > 30, rec(4, F.lit("increase_buffer_times"))),
        F.when(F.col("overutilized") > 0, rec(5, F.lit("high_runway_utilization"))),
    )
    return one.select(F.inline(F.filter(recs, lambda x: x.isNotNull())))


# A37
def slot_comparison(fl: DataFrame) -> DataFrame:
    """By sheet time slot label (C19: before 09:00 -> first sheet, else second)."""
    slot = F.when(F.col("hour") < 9, "6AM - 9AM").otherwise("9AM - 12PM")
    return fl.withColumn("time_slot", slot).groupBy("time_slot").agg(
        F.count(F.lit(1)).alias("flights"),
        F.avg(_d()).alias("avg_delay"),
        F.percentile(_d(), 0.5).alias("median_delay"),
        (F.count_if(_d() <= 5) * 100.0 / F.count(F.lit(1))).alias("on_time_rate"),
        F.count_if(_d() > 15).alias("delayed_over_15"),
        F.stddev_samp(_d()).alias("delay_std"),
    )


# A38
def route_analysis(fl: DataFrame, top: int = 8) -> DataFrame:
    """Top destinations by flight count (semi-join on the k keys), then per-destination stats."""
    counts = fl.groupBy("destination").agg(F.count(F.lit(1)).alias("n"))
    topk = counts.orderBy(F.col("n").desc(), "destination").limit(top).select("destination")
    sel = fl.join(F.broadcast(topk), "destination", "left_semi")  # at most `top` keys
    return sel.groupBy("destination").agg(
        F.count(F.lit(1)).alias("flights"),
        F.avg(_d()).alias("avg_delay"),
        (F.count_if(_d() <= 5) * 100.0 / F.count(F.lit(1))).alias("on_time_pct"),
        F.count_if(_d() > 15).alias("major_delays"),
        F.stddev_samp(_d()).alias("delay_std"),
    )


# A39
def hourly_congestion(fl: DataFrame) -> DataFrame:
    h = fl.groupBy("hour").agg(
        F.count(F.lit(1)).alias("flight_count"), F.avg(_d()).alias("avg_delay"), F.stddev_samp(_d()).alias("delay_std")
    )
    return h.withColumn("congestion_score", F.col("flight_count") * F.col("avg_delay"))


# A40
def hour_performance(fl: DataFrame) -> DataFrame:
    """50/(avg+1) + 30/(std+1) + 20/(score+1); an hour with one flight has no std and no score
    (null, ranked last). Best 3 / worst 2 hours; 20% of the worst hours' flights to redistribute."""
    h = hourly_congestion(fl)
    perf = 50 / (F.col("avg_delay") + 1) + 30 / (F.col("delay_std") + 1) + 20 / (F.col("congestion_score") + 1)
    h = h.withColumn("performance_score", perf)
    best = Window.orderBy(F.col("performance_score").desc_nulls_last(), "hour")
    worst = Window.orderBy(F.col("performance_score").asc_nulls_first(), F.col("hour").desc())
    h = (h.withColumn("rank", F.row_number().over(best).cast("long"))
         .withColumn("is_best", F.col("rank") <= 3)
         .withColumn("is_worst", F.row_number().over(worst) <= 2))
    moved = F.floor(F.sum(F.when(F.col("is_worst"), F.col("flight_count"))).over(_wall()) * 0.2).cast("long")
    return h.withColumn("redistribute_count", moved)


# A41
def cost_potential(fl: DataFrame) -> DataFrame:
    h = fl.groupBy("hour").agg(F.avg(_d()).alias("m"), F.count(F.lit(1)).alias("n"))
    h = h.withColumn("_hi", F.row_number().over(Window.orderBy(F.col("m").desc(), "hour"))).withColumn(
        "_lo", F.row_number().over(Window.orderBy(F.col("m").asc(), "hour"))
    )
    return h.agg(
        F.avg(F.when(F.col("_hi") <= 3, F.col("m"))).alias("worst3_avg"),
        F.avg(F.when(F.col("_lo") <= 3, F.col("m"))).alias("best3_avg"),
        F.sum(F.when(F.col("_hi") <= 3, F.col("n"))).alias("worst3_flights"),
    ).withColumn("potential_minutes_saved", (F.col("worst3_avg") - F.col("best3_avg")) * F.col("worst3_flights"))


# A44
def before_after(original: DataFrame, optimized: DataFrame) -> DataFrame:
    """24-hour grid: original vs optimised mean delay per hour and the deltas."""
    spark = original.sparkSession
    o = original.groupBy("hour").agg(F.avg(_d()).alias("original_avg"), F.max(_d()).alias("original_max"), F.count_if(_d() > 0).alias("original_delayed"))
    n = optimized.groupBy("hour").agg(F.avg(_d()).alias("optimized_avg"), F.max(_d()).alias("optimized_max"), F.count_if(_d() > 0).alias("optimized_delayed"))
    grid = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    j = grid.join(F.broadcast(o), "hour", "left").join(F.broadcast(n), "hour", "left")
    return j.withColumn("avg_reduction", F.col("original_avg") - F.col("optimized_avg")).withColumn(
        "max_reduction", F.col("original_max") - F.col("optimized_max")
    ).withColumn("delayed_reduction", F.col("original_delayed") - F.col("optimized_delayed"))


# A45
def histogram(df: DataFrame, col: str = "delay_minutes", bins: int = 20) -> DataFrame:
    """Fixed-width bins between the column's min and max (one 1-row agg, broadcast)."""
    rng = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    b = F.least(
        F.floor((F.col(col) - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / bins)), F.lit(bins - 1)
    ).cast("int")
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(b)
    j = with_scalars(df.select(col).filter(F.col(col).isNotNull()), rng)
    out = j.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    return out.select("bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
                      (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"), "count")


# A46
def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


# A47
def route_delay_top(fl: DataFrame, top: int = 5) -> DataFrame:
    r = fl.groupBy("origin", "destination").agg(F.avg(_d()).alias("avg_delay"), F.count(F.lit(1)).alias("flights"))
    return r.orderBy(F.col("avg_delay").desc(), "origin", "destination").limit(top)


# A48
def business_leisure_split(fl: DataFrame) -> DataFrame:
    business = F.col("hour").isin(7, 8, 9, 18, 19, 20)
    leisure = F.col("hour").isin(10, 11, 12, 13, 14, 15, 16, 17)
    return fl.agg(
        F.count_if(business).alias("business_flights"),
        F.count_if(leisure).alias("leisure_flights"),
        (F.count_if(business) * F.avg(F.when(business, F.col("capacity"))) * 1.5).alias("business_revenue_potential"),
        (F.count_if(leisure) * F.avg(F.when(leisure, F.col("capacity"))) * 1.0).alias("leisure_revenue_potential"),
    )


# A49
def hourly_peak_mode(labelled: DataFrame, label: str = "peak_category") -> DataFrame:
    """Per hour: mean hourly count, mean delay and the mode of a label (ties -> smallest label)."""
    per_day = labelled.groupBy("date", "hour").agg(F.count(F.lit(1)).alias("c"), F.avg(_d()).alias("m"))
    stats = per_day.groupBy("hour").agg(F.avg("c").alias("avg_flights"), F.avg("m").alias("avg_delay"))
    lab = labelled.groupBy("hour", label).agg(F.count(F.lit(1)).alias("n"))
    mode = lab.groupBy("hour").agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("mode_category"))
    return stats.join(mode, "hour")


# A50
def reschedule_hour(fl: DataFrame, hour: int = 21) -> DataFrame:
    h = fl.groupBy("hour").agg(F.avg(_d()).alias("avg_delay"), F.count(F.lit(1)).alias("flight_count"))
    src = h.filter(F.col("hour") == hour).select(
        F.col("flight_count").alias("source_flights"), F.col("avg_delay").alias("source_avg_delay")
    )
    tgt = h.filter(F.col("hour") != hour).orderBy("avg_delay", "hour").limit(3)
    return with_scalars(tgt, src).withColumn("flights_to_receive", F.floor(F.col("source_flights") / 3).cast("long"))


# ops cube: the three dashboard summaries in one pass
def ops_cube(fl: DataFrame) -> DataFrame:
    return fl.cube("hour", "runway", "airline").agg(
        F.count(F.lit(1)).alias("flights"), F.avg(_d()).alias("avg_delay"), F.grouping_id().alias("gid")
    )


def delay_categories(fl: DataFrame) -> DataFrame:
    """F3 counts: flights per right-closed delay bin."""
    return fl.groupBy(dims.delay_category(_d()).alias("delay_category")).agg(F.count(F.lit(1)).alias("flights"))
