"""Peak-hour clustering and recommendations (P1-P3) over the hour x weekday statistics (A1).

The clustered table has at most 7 x 24 rows whatever the flight volume, so MLlib KMeans on it
is cheap; the aggregation that produces it is the distributed part.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.aggregates import hourly_dow_stats
from tarmac.operators.anomaly import dbscan, standardize

# FIXED VALUES: clustering features and the labels given to clusters by falling congestion
CLUSTER_FEATURES = ["flight_count", "avg_delay", "flights_per_runway", "total_passengers"]
LABELS = ["Super Peak", "Peak", "Moderate", "Low Traffic"]


# P1
def peak_clusters(fl: DataFrame, k: int = 4, seed: int = 42) -> DataFrame:
    stats = hourly_dow_stats(fl).withColumn("slot_id", F.concat_ws("_", "hour", "day_of_week"))
    stats = stats.fillna(0.0, subset=CLUSTER_FEATURES)
    z = standardize(stats, CLUSTER_FEATURES)
    zc = [f"z_{c}" for c in CLUSTER_FEATURES]
    pipe = Pipeline(stages=[VectorAssembler(inputCols=zc, outputCol="features"),
                            KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster")])
    out = pipe.fit(z).transform(z)
    sil = ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(out)
    prof = out.groupBy("cluster").agg(F.avg("congestion_score").alias("_cs"))
    rank = prof.withColumn("_r", F.row_number().over(Window.orderBy(F.col("_cs").desc(), "cluster")) - 1)
    lab = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("_r") + 1).cast("int"))
    rank = rank.select("cluster", lab.alias("peak_category"))
    db = dbscan(stats, CLUSTER_FEATURES, eps=0.5, min_samples=2, id_col="slot_id").withColumnRenamed("dbscan_cluster", "anomaly_cluster")
    return out.drop("features", *zc).join(rank, "cluster").join(db, "slot_id").withColumn("silhouette_score", F.lit(sil))


def given_peak_labels(fl: DataFrame) -> DataFrame:
    """Stand-in cluster labels (by hour set) so P2/P3 can be checked against SQL."""
    h = F.col("hour")
    lab = (F.when(h.isin(7, 8, 9, 19, 20, 21), "Super Peak").when(h.isin(6, 10, 18, 22), "Peak")
           .when(h.isin(0, 1, 2, 3, 4, 15, 16), "Low Traffic").otherwise("Moderate"))
    return hourly_dow_stats(fl).withColumn("peak_category", lab)


# P2
def peak_recommendations(labelled: DataFrame) -> DataFrame:
    per_hour = labelled.groupBy("hour", "peak_category").agg(F.avg("flight_count").alias("avg_flights"),
                                                           F.avg("avg_delay").alias("avg_delay"))
    sp = per_hour.filter(F.col("peak_category") == "Super Peak")
    lo = per_hour.filter(F.col("peak_category") == "Low Traffic")
    redis = sp.filter(F.col("avg_flights") > 25).select(
        F.lit("redistribution").alias("type"), "hour", F.lit("high").alias("severity"), F.lit(1).alias("priority"),
        F.floor(F.col("avg_flights") * 0.2).cast("double").alias("value"))
    capa = sp.filter(F.col("avg_delay") > 15).select(
        F.lit("capacity").alias("type"), "hour", F.lit("medium").alias("severity"), F.lit(2).alias("priority"),
        (F.col("avg_delay") * 0.25).alias("value"))
    util = lo.filter(F.col("avg_flights") < 10).select(
        F.lit("utilization").alias("type"), "hour", F.lit("low").alias("severity"), F.lit(3).alias("priority"),
        (20 - F.col("avg_flights")).alias("value"))
    return redis.unionByName(capa).unionByName(util)


# P3
def optimization_opportunities(labelled: DataFrame) -> DataFrame:
    sp = F.col("peak_category") == "Super Peak"
    lo = F.col("peak_category") == "Low Traffic"
    one = labelled.agg(
        (F.sum(F.when(sp, F.col("flight_count"))) * 0.2).alias("excess_flights"),
        F.sum(F.when(lo, 20 - F.col("flight_count"))).alias("available_capacity"),
        F.avg("avg_delay").alias("current_avg_delay"),
        (F.avg(F.when(sp, F.col("avg_delay"))) * 0.25).alias("potential_delay_reduction"),
        F.sum("flight_count").alias("current_throughput"),
        F.countDistinct(F.when(sp, F.col("hour"))).alias("peak_hours_count"),
    )
    feas = F.least(F.coalesce("excess_flights", F.lit(0.0)), F.coalesce("available_capacity", F.lit(0)).cast("double"))
    one = one.withColumn("redistribution_feasible", feas)
    one = one.withColumn("throughput_improvement_pct", F.col("redistribution_feasible") / F.col("current_throughput") * 100)
    one = one.withColumn("delay_improvement_pct", F.col("potential_delay_reduction") / F.col("current_avg_delay") * 100)
    score = F.least(F.lit(95.0), (F.col("potential_delay_reduction") / F.col("current_avg_delay")
                                  + F.col("throughput_improvement_pct") / 100) * 50)
    return one.withColumn("optimization_score", score).drop("excess_flights", "available_capacity")


