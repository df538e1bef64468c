"""Invariants of the two allocators and their independence from the partitioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import dims
from tarmac.operators import scheduling as K


def test_greedy_invariants(flights):
    out = K.greedy_slot_allocation(flights).cache()
    n = flights.count()
    assert out.count() == n and out.select("flight_id").distinct().count() == n
    # fallback rows are +30 min on the preferred runway and flagged as not improvable
    fallback = (F.timestamp_diff("MINUTE", "scheduled_time", "optimized_time") == 30) & ~F.col("can_improve")
    cap = {r: int(c * 0.85) for r, c in dims.GREEDY_RUNWAY_CAPACITY.items()}
    use = (out.filter(~fallback).groupBy("base_airport", "service_date", "optimized_runway",
                                         F.date_trunc("hour", "optimized_time").alias("h")).count().collect())
    assert all(r["count"] <= cap[r["optimized_runway"]] for r in use)
    # never earlier than scheduled
    assert out.filter(F.col("optimized_time") < F.col("scheduled_time")).count() == 0


def test_runway_slot_invariants(flights):
    out = K.allocate_runway_slots(flights).cache()
    joined = out.join(flights.select("flight_id", "scheduled_time", "runway"), "flight_id")
    n = flights.count()
    assert out.count() == n and out.select("flight_id").distinct().count() == n
    moved = joined.filter(F.col("suitability_score") != 0.5)
    # each (airport, runway, slot) used at most once, also across midnight
    dup = moved.groupBy("base_airport", "optimized_runway", "optimized_time").count().filter("count > 1")
    assert dup.count() == 0
    # within one hour of the schedule, on a 15-minute grid
    assert moved.filter(F.abs(F.col("schedule_change_minutes")) > 60).count() == 0
    assert moved.filter(F.minute("optimized_time") % 15 != 0).count() == 0


def test_runway_slots_across_midnight(spark):
    """Flights at 23:50 fill their own day's last hour first, then free slots after midnight, never one twice."""
    from datetime import datetime

    rows = [(f"L{i:03d}", "BOM", datetime(2024, 1, 1, 23, 50)) for i in range(30)]
    rows += [(f"E{i:03d}", "BOM", datetime(2024, 1, 2, 0, 5)) for i in range(8)]
    fl = spark.createDataFrame(rows, "flight_id string, base_airport string, scheduled_time timestamp_ntz").selectExpr(
        "*", "'09R/27L' AS runway", "'A320' AS aircraft_type", "180 AS capacity", "false AS is_emergency", "false AS is_international")
    out = K.allocate_runway_slots(fl).collect()
    assert len(out) == len({r["flight_id"] for r in out}) == 38
    slots = [(r["optimized_runway"], r["optimized_time"]) for r in out if r["optimized_time"].minute % 15 == 0]
    assert len(slots) == len(set(slots))
    # 23:00 to 23:45 hold four slots on each of four runways; 00:00 to 00:45 the other sixteen, eight of them for E
    late = [r for r in out if r["flight_id"].startswith("L") and r["optimized_time"].minute % 15 == 0]
    assert sum(r["optimized_time"].day == 1 for r in late) == 16
    assert sum(r["optimized_time"].day == 2 for r in late) == 8
    assert all(abs(r["schedule_change_minutes"]) <= 60 for r in out)


def test_allocators_independent_of_partitioning(spark, flights):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(map(tuple, K.allocate_runway_slots(flights).collect()))
    g = sorted(map(tuple, K.greedy_slot_allocation(flights).select("flight_id", "optimized_time", "optimized_runway").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == sorted(map(tuple, K.allocate_runway_slots(flights).collect()))
    assert g == sorted(map(tuple, K.greedy_slot_allocation(flights).select("flight_id", "optimized_time", "optimized_runway").collect()))


def test_model_save_load_roundtrip(spark, flights, tmp_path):
    from tarmac.operators import predict as PR

    feats = PR.features_frame(flights)
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import RandomForestRegressor

    cols = [c for c in feats.columns if c not in ("flight_id", "scheduled_time", "delay_minutes")]
    model = Pipeline(stages=[PR._assembler(cols), RandomForestRegressor(labelCol="delay_minutes", numTrees=5, maxDepth=3,
                                                                       predictionCol="pred_rf", seed=1)]).fit(feats)
    path = str(tmp_path / "model")
    PR.save_model(model, path)
    again = PR.load_model(path)
    a = PR.predict(model, feats).select("flight_id", "predicted_delay").orderBy("flight_id").collect()
    b = PR.predict(again, feats).select("flight_id", "predicted_delay").orderBy("flight_id").collect()
    assert a == b
    assert PR.tree_importance(again, 5).count() == 5


def test_graph_results_independent_of_partitioning(spark, flights):
    from tarmac.operators import graph as G

    def run():
        e = G.build_edges(flights)
        init = flights.filter("delay_minutes > 100").selectExpr("flight_id", "delay_minutes AS delay")
        return (sorted(map(tuple, e.collect())),
                sorted(map(tuple, G.simulate_cascade(flights.select("flight_id"), e, init).collect())))

    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = run()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == run()


def test_cross_validate_mechanism(flights):
    from pyspark.ml.regression import RandomForestRegressor

    from tarmac.operators import predict as PR

    small = [RandomForestRegressor(labelCol="delay_minutes", numTrees=5, maxDepth=3, seed=1, predictionCol="pred_rf")]
    out = {r["metric"]: r for r in PR.cross_validate(PR.features_frame(flights), k=3, estimators=small).collect()}
    assert set(out) == {"mae", "r2"}
    assert out["mae"]["mean"] > 0 and out["mae"]["std"] is not None


def test_schedule_audit_counts_each_airport_alone(spark):
    """20 flights an hour at each of two airports are below the runway's 35; 40 at one are not."""
    from datetime import datetime

    from tarmac.operators import scheduling as K

    def over(bases):
        rows = [(f"F{i}", bases[i % 2], f"A{i}", "09R/27L", datetime(2024, 1, 1, 8, i)) for i in range(40)]
        asg = spark.createDataFrame(rows, "flight_id string, base_airport string, aircraft_id string, optimized_runway string, optimized_time timestamp_ntz")
        return K.schedule_audit(asg).first()["over_capacity_runway_hours"]

    assert over(["ONE", "TWO"]) == 0 and over(["ONE", "ONE"]) == 1


def test_runway_efficiency_is_per_airport_and_day(spark):
    """Seven flights in one hour at each of two airports on two days use a fifth of 35 a runway-hour, not four fifths."""
    from datetime import datetime

    rows = [(b, "09R/27L", datetime(2024, 1, day, 8, i)) for b in ("ONE", "TWO") for day in (1, 2) for i in range(7)]
    asg = spark.createDataFrame(rows, "base_airport string, optimized_runway string, optimized_time timestamp_ntz")
    got = {r["optimized_runway"]: r["utilization_rate"] for r in K.runway_efficiency_metrics(asg).collect()}
    assert got.pop("09R/27L") == 20.0 and set(got.values()) == {0.0}


def test_reschedule_usage_is_per_day(spark):
    """Five flights an hour on each of ten days stay far below a runway's hourly capacity."""
    from datetime import datetime

    rows = [(f"F{d}-{i}", "ONE", "09R/27L", datetime(2024, 1, d, 8, i)) for d in range(1, 11) for i in range(5)]
    fl = spark.createDataFrame(rows, "flight_id string, base_airport string, runway string, scheduled_time timestamp_ntz").selectExpr(
        "*", "hour(scheduled_time) AS hour", "0.0D AS delay_minutes")
    wx = spark.createDataFrame([], (
        "weather_hour timestamp_ntz, weather_condition string, visibility_km double, wind_speed_kts int, precipitation_mm double, "
        "capacity_reduction_factor double, landing_restrictions boolean, takeoff_restrictions boolean, crosswind_runway_closure boolean"))
    got = K.reschedule_candidates(fl, wx).selectExpr("current_usage", "needs_reschedule").distinct().collect()
    assert [tuple(r) for r in got] == [(5, False)]


def test_slot_penalty_prices_the_whole_day(spark):
    fl = spark.sql("""SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2024-01-02 00:03:00'), ('b', TIMESTAMP_NTZ '2024-01-02 12:00:00'), ('c', TIMESTAMP_NTZ '2024-01-02 23:59:00')
        AS t(flight_id, scheduled_time)""").selectExpr("*", "1.5D AS congestion_factor", "'peak' AS peak_category", "true AS is_high_impact", "0.9D AS runway_efficiency")
    got = K.slot_penalty_day(fl).collect()
    preferred = {"a": 0, "b": 48, "c": 96}
    m = 1.5 * 2.0 * 2.5 / 0.9
    assert sorted((r.flight_id, r.slot_offset, r.slot_time.hour * 4 + r.slot_time.minute // 15, r.slot_time.day, r.penalty) for r in got) == sorted(
        (f, k - p, k, 2, int(abs(k - p) * m)) for f, p in preferred.items() for k in range(96))
