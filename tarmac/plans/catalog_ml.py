"""Registered anomaly (M1-M8), prediction (M9-M17, A42, A43) and peak (P1-P3) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import anomaly as M
from tarmac.operators import features as FE
from tarmac.operators import joins as J
from tarmac.operators import peaks as P
from tarmac.operators import predict as PR
from tarmac.plans.oracle import with_flights
from tarmac.plans.registry import register
from tarmac.session import stored
from tarmac.sources import fixture


def _fl(spark, d):
    return fixture.flights(spark, d)


def flagged(fl):
    """Given detector output (FIXTURES 1.9): anomaly = delay > 100, confidence = delay / 100."""
    df = FE.anomaly_features(fl)
    return df.withColumns({
        "isolation_anomaly": (F.col("delay_minutes") > 100).cast("int"),
        "dbscan_anomaly": (F.col("delay_minutes") > 150).cast("int"),
        "combined_anomaly": (F.col("delay_minutes") > 100).cast("int"),
        "anomaly_confidence": F.col("delay_minutes") / 100,
    })


def _typed(spark, d):
    return M.classify_anomaly_types(flagged(_fl(spark, d)))


FLAGGED = """
, af AS (
  SELECT *, CAST(month(scheduled_time) AS INTEGER) AS month, CAST(hour IN (7, 8, 9, 18, 19, 20) AS INTEGER) AS is_peak_hour_int, CAST(congestion_factor > 1.5 AS INTEGER) AS high_congestion,
    count(*) OVER (PARTITION BY runway, hour) AS runway_utilization,
    CAST(delay_minutes > 100 AS INTEGER) AS isolation_anomaly, CAST(delay_minutes > 150 AS INTEGER) AS dbscan_anomaly,
    CAST(delay_minutes > 100 AS INTEGER) AS combined_anomaly, delay_minutes / 100 AS anomaly_confidence
  FROM flights),
q95 AS (SELECT quantile_cont(runway_utilization, 0.95) AS qr, quantile_cont(capacity, 0.95) AS qc FROM af),
typed AS (
  SELECT af.*, CASE WHEN combined_anomaly = 0 THEN 'Normal' WHEN coalesce(delay_minutes, 0) > 60 THEN 'Severe Delay'
    WHEN high_congestion = 1 THEN 'Congestion Anomaly'
    WHEN is_peak_hour_int = 1 AND coalesce(delay_minutes, 0) > 30 THEN 'Peak Hour Disruption'
    WHEN runway_utilization > qr THEN 'Runway Overutilization' WHEN capacity > qc THEN 'Large Aircraft Anomaly'
    ELSE 'General Anomaly' END AS anomaly_type
  FROM af, q95)
"""


@register("anomaly_types", with_flights(FLAGGED + "SELECT flight_id, anomaly_type FROM typed"))
def _at(spark, d):
    return _typed(spark, d).select("flight_id", "anomaly_type")


@register("anomaly_summary", with_flights(FLAGGED + """
SELECT count(*) AS total_samples, CAST(sum(isolation_anomaly) AS BIGINT) AS isolation_anomalies,
  CAST(sum(dbscan_anomaly) AS BIGINT) AS dbscan_anomalies, CAST(sum(combined_anomaly) AS BIGINT) AS combined_anomalies,
  avg(combined_anomaly) * 100 AS anomaly_rate FROM typed
"""))
def _as(spark, d):
    return M.anomaly_summary(_typed(spark, d))


@register("anomaly_patterns", with_flights(FLAGGED + """
SELECT count(*) AS anomalies, avg(delay_minutes) AS mean_delay, quantile_cont(delay_minutes, 0.5) AS median_delay,
  max(delay_minutes) AS max_delay, stddev_samp(delay_minutes) AS std_delay,
  count(*) FILTER (WHERE is_peak_hour_int = 1) * 100.0 / count(*) AS peak_hour_anomaly_rate,
  count(*) FILTER (WHERE high_congestion = 1) * 100.0 / count(*) AS congestion_anomaly_rate
FROM typed WHERE combined_anomaly = 1
"""))
def _ap(spark, d):
    return M.anomaly_patterns(_typed(spark, d))


for _col in ["anomaly_type", "hour", "airline", "runway", "aircraft_type", "day_of_week", "month"]:
    register(f"anomaly_distribution_{_col}", with_flights(FLAGGED + f"""
SELECT {_col}, count(*) AS count FROM typed WHERE combined_anomaly = 1 GROUP BY {_col}
"""))((lambda c: lambda spark, d: M.anomaly_distribution(_typed(spark, d), c))(_col))

for _by in ["date", "hour", "runway"]:
    register(f"anomaly_rollup_{_by}", with_flights(FLAGGED + f"""
SELECT {_by}, CAST(sum(combined_anomaly) AS BIGINT) AS anomalies, count(flight_id) AS flights, avg(delay_minutes) AS avg_delay,
  sum(combined_anomaly) / count(flight_id) * 100 AS anomaly_rate FROM typed GROUP BY {_by}
"""))((lambda b: lambda spark, d: M.anomaly_rollups(_typed(spark, d), b))(_by))


@register("anomaly_alerts", with_flights(FLAGGED + """
, q80 AS (SELECT quantile_cont(anomaly_confidence, 0.8) AS q FROM typed)
SELECT flight_id, airline, scheduled_time, runway, anomaly_type, anomaly_confidence AS confidence, delay_minutes,
  CASE WHEN anomaly_confidence > 1.5 OR delay_minutes > 60 OR anomaly_type = 'Severe Delay' THEN 'Critical'
    WHEN anomaly_confidence > 1.0 OR delay_minutes > 30 THEN 'High'
    WHEN anomaly_confidence > 0.5 OR delay_minutes > 15 THEN 'Medium' ELSE 'Low' END AS severity,
  CASE anomaly_type
    WHEN 'Severe Delay' THEN 'Immediate intervention required - Consider flight rebooking or gate reassignment'
    WHEN 'Congestion Anomaly' THEN 'Activate congestion management protocols'
    WHEN 'Peak Hour Disruption' THEN 'Deploy additional ground crew and expedite turnaround'
    WHEN 'Runway Overutilization' THEN 'Consider runway redistribution or delay non-critical flights'
    WHEN 'Large Aircraft Anomaly' THEN 'Ensure adequate ground support and runway capacity'
    WHEN 'General Anomaly' THEN 'Monitor closely and investigate root cause'
    ELSE 'Monitor and investigate' END AS recommended_action
FROM typed, q80 WHERE combined_anomaly = 1 AND anomaly_confidence > q
"""))
def _aa(spark, d):
    return M.anomaly_alerts(_typed(spark, d))


@register("detection_metrics", with_flights(FLAGGED + """
SELECT true_positives, false_positives, true_negatives, false_negatives, total_predictions,
  (true_positives + true_negatives) / total_predictions AS accuracy, p AS precision, r AS recall,
  CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1_score,
  (true_positives + true_negatives) / total_predictions * 100 AS accuracy_percentage FROM (
  SELECT *, CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives) ELSE 0.0 END AS p,
    CASE WHEN true_positives + false_negatives > 0 THEN true_positives / (true_positives + false_negatives) ELSE 0.0 END AS r FROM (
    SELECT count(*) FILTER (WHERE delay_minutes > 60 AND combined_anomaly = 1) AS true_positives,
      count(*) FILTER (WHERE NOT delay_minutes > 60 AND combined_anomaly = 1) AS false_positives,
      count(*) FILTER (WHERE NOT delay_minutes > 60 AND combined_anomaly = 0) AS true_negatives,
      count(*) FILTER (WHERE delay_minutes > 60 AND combined_anomaly = 0) AS false_negatives,
      count(*) AS total_predictions FROM typed))
"""))
def _dm(spark, d):
    return M.detection_metrics(_typed(spark, d))


@register("known_label_join", with_flights(FLAGGED + """
SELECT t.flight_id, t.combined_anomaly, k.flight_id IS NOT NULL AS is_known
FROM typed t LEFT JOIN (SELECT flight_id FROM flights WHERE delay_minutes > 60) k USING (flight_id)
"""))
def _klj(spark, d):
    typed = _typed(spark, d)
    truth = _fl(spark, d).filter(F.col("delay_minutes") > 60).select("flight_id")
    return J.known_label_join(typed.select("flight_id", "combined_anomaly"), truth)


GIVEN_DETECTORS = """
, af AS (SELECT flight_id, CAST(delay_minutes > 100 AS INTEGER) AS isolation_anomaly,
    CASE WHEN hour = 3 THEN -1 ELSE hour % 5 END AS dbscan_cluster FROM flights),
both_flags AS (SELECT *, CAST(dbscan_cluster = -1 AS INTEGER) AS dbscan_anomaly,
    CAST(isolation_anomaly = 1 OR dbscan_cluster = -1 AS INTEGER) AS combined_anomaly FROM af)
"""


def _combined(spark, d):
    """Given detector output: the forest flags delays over 100, DBSCAN leaves the flights of 3 o'clock as noise."""
    fl = _fl(spark, d)
    scored = fl.select("flight_id", (F.col("delay_minutes") > 100).cast("int").alias("isolation_anomaly"))
    clusters = fl.select("flight_id", F.when(F.col("hour") == 3, -1).otherwise(F.col("hour") % 5).alias("dbscan_cluster"))
    return M.combine_anomalies(scored, clusters)


@register("combine_anomalies", with_flights(GIVEN_DETECTORS + """
SELECT flight_id, isolation_anomaly, dbscan_cluster, dbscan_anomaly, combined_anomaly FROM both_flags
"""))
def _ca(spark, d):
    return _combined(spark, d)


@register("combined_anomaly_summary", with_flights(GIVEN_DETECTORS + """
SELECT count(*) AS total_samples, CAST(sum(isolation_anomaly) AS BIGINT) AS isolation_anomalies,
  CAST(sum(dbscan_anomaly) AS BIGINT) AS dbscan_anomalies, CAST(sum(combined_anomaly) AS BIGINT) AS combined_anomalies,
  avg(combined_anomaly) * 100 AS anomaly_rate,
  count(DISTINCT CASE WHEN dbscan_cluster >= 0 THEN dbscan_cluster END) AS unique_clusters FROM both_flags
"""))
def _cas(spark, d):
    return M.anomaly_summary(_combined(spark, d))


@register("detector_flags", with_flights("""
, top AS (SELECT airline FROM flights GROUP BY airline ORDER BY count(*) DESC, airline LIMIT 10)
SELECT flight_id, CAST(airline = '6E' AND '6E' IN (SELECT airline FROM top) AS INTEGER) AS airline_6E,
  CAST(airline = '9W' AND '9W' IN (SELECT airline FROM top) AS INTEGER) AS airline_9W,
  CAST(runway = '09R/27L' AS INTEGER) AS runway_id_09R_27L, CAST(runway = '14/32' AS INTEGER) AS runway_id_14_32 FROM flights
"""))
def _df(spark, d):
    fl = _fl(spark, d)
    out, _ = FE.detector_flags(fl, FE.detector_categories(fl))
    return out.select("flight_id", "airline_6E", "airline_9W", "runway_id_09R_27L", "runway_id_14_32")


def _fitted_on_early_days(spark, d):
    """Forest of the flights before the middle of the calendar, and the features of all flights."""
    fl = _fl(spark, d)
    feats, flags = FE.detector_flags(FE.anomaly_features(fl), FE.detector_categories(fl))
    feats = stored(feats.select("flight_id", "date", "capacity", *M.ANOMALY_FEATURES, *flags), "features")
    middle = F.expr("date_add(min(date), cast(datediff(max(date), min(date)) / 2 as int))")
    cut = feats.agg(middle.alias("d")).first()["d"]
    return M.fit_isolation_forest(feats.filter(F.col("date") < cut), M.ANOMALY_FEATURES + flags), feats.filter(F.col("date") >= cut)


@register("isolation_forest_new_flights")
def _ifn(spark, d):
    """Fitted with all inputs on the first half of the calendar, it scores the flights of the second half."""
    model, later = _fitted_on_early_days(spark, d)
    return model.score(later).select("flight_id", "isolation_score", "isolation_anomaly", "anomaly_confidence")


@register("detect_new_flights")
def _dnf(spark, d):
    """The whole chain on flights that the forest has not seen. DBSCAN takes three inputs: on all of them at eps 0.5
    every flight of the given tables is noise."""
    model, later = _fitted_on_early_days(spark, d)
    found = M.detect_anomalies(model, later, cluster_features=["hour", "delay_minutes", "capacity_utilization"])
    return found.select("flight_id", "isolation_anomaly", "dbscan_anomaly", "combined_anomaly", "anomaly_confidence", "anomaly_type")


@register("isolation_forest")
def _if(spark, d):
    feats = FE.anomaly_features(_fl(spark, d))
    return M.isolation_forest(feats, M.ANOMALY_FEATURES).select(
        "flight_id", "isolation_score", "isolation_anomaly", "anomaly_confidence")


@register("dbscan_clusters")
def _db(spark, d):
    feats = FE.anomaly_features(_fl(spark, d))
    return M.dbscan(feats, ["hour", "delay_minutes", "capacity_utilization"], eps=0.5, min_samples=5)


IMPORTANCE = ["hour", "delay_minutes", "is_peak_hour_int", "high_congestion", "runway_utilization"]


@register("feature_importance_given", with_flights(FLAGGED + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, abs(corr(CAST({c} AS DOUBLE), abs(anomaly_confidence))) AS importance FROM typed" for c in IMPORTANCE)))
def _fig(spark, d):
    return M.feature_importance_corr(flagged(_fl(spark, d)), IMPORTANCE, score="anomaly_confidence")


@register("feature_importance_corr")
def _fic(spark, d):
    feats = FE.anomaly_features(_fl(spark, d))
    scored = M.isolation_forest(feats, M.ANOMALY_FEATURES)
    return M.feature_importance_corr(scored, M.ANOMALY_FEATURES)


PRED = """
, pr AS (SELECT flight_id, scheduled_time, delay_minutes, delay_minutes * 0.5 + hour AS predicted_delay,
    least(1.0, (delay_minutes * 0.5 + hour) / 120) AS delay_risk FROM flights),
pe AS (SELECT *, abs(delay_minutes - predicted_delay) AS prediction_error,
    predicted_delay * 0.7 + abs(delay_minutes - predicted_delay) * 0.3 AS risk_score FROM pr)
"""


def _given(spark, d):
    return PR.given_predictions(_fl(spark, d))


@register("regression_metrics", with_flights(PRED + """
SELECT avg(abs(delay_minutes - predicted_delay)) AS mae, sqrt(avg((delay_minutes - predicted_delay) ** 2)) AS rmse,
  1 - sum((delay_minutes - predicted_delay) ** 2) / (SELECT sum((delay_minutes - m) ** 2) FROM pr, (SELECT avg(delay_minutes) AS m FROM pr))
    AS r2, count(*) AS n FROM pr
"""))
def _rm(spark, d):
    return PR.regression_metrics(_given(spark, d))


@register("prediction_error", with_flights(PRED + "SELECT flight_id, prediction_error, risk_score FROM pe"))
def _pe(spark, d):
    return PR.prediction_error(_given(spark, d)).select("flight_id", "prediction_error", "risk_score")


RISK_GRID = PRED + """
, g AS (SELECT CAST(scheduled_time AS DATE) AS date, CAST(hour(scheduled_time) AS INTEGER) AS hour,
    avg(predicted_delay) AS predicted_avg_delay, stddev_samp(predicted_delay) AS predicted_delay_std,
    max(predicted_delay) AS max_predicted_delay, avg(delay_minutes) AS actual_avg_delay, count(delay_minutes) AS flight_count,
    avg(risk_score) AS avg_risk_score, avg(prediction_error) AS avg_prediction_error FROM pe GROUP BY 1, 2),
g2 AS (SELECT *, predicted_avg_delay * 0.4 + predicted_delay_std * 0.2 + avg_risk_score * 0.3
    + flight_count / max(flight_count) OVER () * 10 AS delay_risk FROM g),
q AS (SELECT quantile_cont(delay_risk, 0.33) AS q1, quantile_cont(delay_risk, 0.66) AS q2, quantile_cont(delay_risk, 0.85) AS q3 FROM g2),
grid AS (SELECT g2.*, CASE WHEN delay_risk > 0 AND delay_risk <= q1 THEN 'Low' WHEN delay_risk > q1 AND delay_risk <= q2 THEN 'Medium'
    WHEN delay_risk > q2 AND delay_risk <= q3 THEN 'High' WHEN delay_risk > q3 THEN 'Critical' END AS risk_level,
  least(100.0, greatest(0.0, 100 - avg_prediction_error / greatest(predicted_avg_delay, 1.0) * 100)) AS model_confidence
FROM g2, q)
"""


@register("prediction_risk_grid", with_flights(RISK_GRID + "SELECT * FROM grid"))
def _prg(spark, d):
    return PR.prediction_risk_grid(_given(spark, d))


@register("risk_grid_high", with_flights(RISK_GRID + "SELECT * FROM grid WHERE risk_level = 'High' AND model_confidence >= 40"))
def _rgh(spark, d):
    return PR.filter_risk_grid(PR.prediction_risk_grid(_given(spark, d)), "High", 40.0)


@register("risk_heatmap", with_flights(PRED + """
SELECT *, CASE WHEN delay_risk > 0 AND delay_risk <= 0.2 THEN 'Low' WHEN delay_risk > 0.2 AND delay_risk <= 0.4 THEN 'Medium'
  WHEN delay_risk > 0.4 AND delay_risk <= 0.6 THEN 'High' WHEN delay_risk > 0.6 AND delay_risk <= 1.0 THEN 'Critical' END AS risk_level
FROM (SELECT CAST(scheduled_time AS DATE) AS date, CAST(hour(scheduled_time) AS INTEGER) AS hour, avg(delay_risk) AS delay_risk,
  avg(predicted_delay) AS predicted_delay, count(flight_id) AS flight_count FROM pr GROUP BY 1, 2)
"""))
def _rh(spark, d):
    return PR.risk_heatmap(_given(spark, d))


@register("train_test_split", with_flights("""
, hashed AS (SELECT flight_id, CAST(delay_minutes > 0 AS INTEGER) AS stratum,
    ((CAST(regexp_extract(flight_id, '(\\d+)$', 1) AS BIGINT) % 1000003) * 2654435761) % 1000003 AS h FROM flights)
SELECT flight_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY h, flight_id)
  <= (count(*) OVER (PARTITION BY stratum) * 20 + 50) // 100 AS is_test FROM hashed
"""))
def _tts(spark, d):
    return PR.train_test_split(_fl(spark, d)).select("flight_id", "stratum", "is_test")


@register("delay_model_predictions")
def _dmp(spark, d):
    train, test = _split(spark, d)
    pred = PR.predict(PR.train(train, "gbt"), test)
    return PR.prediction_error(pred).select("flight_id", "delay_minutes", "predicted_delay", "exceeds_threshold",
                                            "prediction_error", "risk_score")


def _split(spark, d):
    feats = stored(PR.train_test_split(PR.model_frame(_fl(spark, d))), "model-features")
    return [feats.filter(c).drop("stratum", "is_test") for c in (~F.col("is_test"), F.col("is_test"))]


def _held_out(spark, d, kind):
    train, test = _split(spark, d)
    pred = PR.predict(PR.train(train, estimators=PR.delay_regressor(kind)), test)
    return PR.prediction_error(pred).select("flight_id", "delay_minutes", "predicted_delay", "exceeds_threshold",
                                            "prediction_error", "risk_score")


@register("delay_model_forest")
def _dmf(spark, d):
    return _held_out(spark, d, "rf")


@register("delay_model_ensemble")
def _dme(spark, d):
    return _held_out(spark, d, "ensemble")


@register("delay_feature_importance")
def _dfim(spark, d):
    return PR.tree_importance(PR.train(_split(spark, d)[0], estimators=PR.delay_regressor("ensemble")), 10)


@register("cross_validated_model")
def _cvm(spark, d):
    return PR.cross_validate(PR.model_frame(_fl(spark, d)), 5, estimators=PR.delay_regressor("gbt"))


@register("tuned_delay_model")
def _tdm(spark, d):
    feats = stored(PR.model_frame(_fl(spark, d)), "model-features")
    return PR.tune(feats, trials=6, grid={"maxDepth": [3, 5, 6], "maxIter": [9, 18], "stepSize": [0.1, 0.2], "subsamplingRate": [0.7, 1.0]})[1]


@register("cross_validation_given", with_flights(PRED + """
, f AS (SELECT CAST((((CAST(regexp_extract(flight_id, '(\\d+)$', 1) AS BIGINT) % 1000003) * 2654435761) % 1000003) % 100 % 5 AS INTEGER) AS fold,
    delay_minutes AS y, predicted_delay AS p FROM pr),
m AS (SELECT fold, avg(y) AS my FROM f GROUP BY fold)
SELECT fold, count(*) AS n, avg(abs(y - p)) AS mae, 1 - sum((y - p) ** 2) / sum((y - my) ** 2) AS r2 FROM f JOIN m USING (fold) GROUP BY fold
"""))
def _cvg(spark, d):
    return PR.fold_metrics(_given(spark, d).withColumn("fold", PR.fold_of(F.col("flight_id"))))


CATEGORIES = """
, c AS (SELECT flight_id, 'airline_' || airline AS a, 'aircraft_' || aircraft_type AS t, 'runway_' || runway AS r,
  'cap_' || CASE WHEN capacity > 0 AND capacity <= 150 THEN 'Small' WHEN capacity > 150 AND capacity <= 200 THEN 'Medium'
    WHEN capacity > 200 AND capacity <= 250 THEN 'Large' WHEN capacity > 250 AND capacity <= 350 THEN 'XLarge' END AS k FROM flights)
"""


def _one_hots(spark, d):
    df = FE.delay_model_features(_fl(spark, d)).select("flight_id", *FE.ONE_HOT)
    model = FE.fit_one_hots(df)
    names = [n for slots in FE.one_hot_names(model.stages[0]).values() for n in slots]
    return FE.one_hot_columns(df, model), names


@register("model_one_hots", with_flights(CATEGORIES + """
SELECT flight_id, concat_ws(',', a, t, r, k) AS active,
  CAST((SELECT count(DISTINCT a) + count(DISTINCT t) + count(DISTINCT r) + count(DISTINCT k) FROM c) AS INTEGER) AS n_columns FROM c
"""))
def _moh(spark, d):
    df, names = _one_hots(spark, d)
    return df.select("flight_id", F.concat_ws(",", *[F.when(F.col(f"`{n}`") == 1, n) for n in names]).alias("active"),
                     F.lit(len(names)).alias("n_columns"))


@register("one_hot_totals", with_flights(CATEGORIES + " UNION ALL ".join(
    f"SELECT {x} AS feature, count(*) AS flights FROM c WHERE {x} IS NOT NULL GROUP BY {x}" for x in "atrk")))
def _oht(spark, d):
    df, names = _one_hots(spark, d)
    one = df.agg(*[F.sum(f"`{n}`").alias(n) for n in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("flights")) for n in names])))


@register("ops_clusters")
def _oc(spark, d):
    return PR.ops_clusters(_fl(spark, d))


@register("peak_clusters")
def _pcl(spark, d):
    return P.peak_clusters(_fl(spark, d)).select("hour", "day_of_week", "cluster", "peak_category", "anomaly_cluster",
                                                  "silhouette_score")


LABELLED = """
, hd AS (SELECT hour, day_of_week, count(flight_id) AS flight_count, avg(delay_minutes) AS avg_delay FROM flights GROUP BY 1, 2),
lab AS (SELECT *, CASE WHEN hour IN (7, 8, 9, 19, 20, 21) THEN 'Super Peak' WHEN hour IN (6, 10, 18, 22) THEN 'Peak'
    WHEN hour IN (0, 1, 2, 3, 4, 15, 16) THEN 'Low Traffic' ELSE 'Moderate' END AS peak_category FROM hd),
ph AS (SELECT hour, peak_category, avg(flight_count) AS avg_flights, avg(avg_delay) AS avg_delay FROM lab GROUP BY 1, 2)
"""


@register("peak_recommendations", with_flights(LABELLED + """
SELECT 'redistribution' AS type, hour, 'high' AS severity, 1 AS priority, CAST(floor(avg_flights * 0.2) AS DOUBLE) AS value
  FROM ph WHERE peak_category = 'Super Peak' AND avg_flights > 25
UNION ALL SELECT 'capacity', hour, 'medium', 2, avg_delay * 0.25 FROM ph WHERE peak_category = 'Super Peak' AND avg_delay > 15
UNION ALL SELECT 'utilization', hour, 'low', 3, 20 - avg_flights FROM ph WHERE peak_category = 'Low Traffic' AND avg_flights < 10
"""))
def _prec(spark, d):
    return P.peak_recommendations(P.given_peak_labels(_fl(spark, d)))


@register("optimization_opportunities", with_flights(LABELLED + """
SELECT *, least(95.0, (potential_delay_reduction / current_avg_delay + throughput_improvement_pct / 100) * 50) AS optimization_score
FROM (SELECT *, redistribution_feasible / current_throughput * 100 AS throughput_improvement_pct,
    potential_delay_reduction / current_avg_delay * 100 AS delay_improvement_pct FROM (
  SELECT avg(avg_delay) AS current_avg_delay,
    avg(CASE WHEN peak_category = 'Super Peak' THEN avg_delay END) * 0.25 AS potential_delay_reduction,
    CAST(sum(flight_count) AS BIGINT) AS current_throughput,
    count(DISTINCT CASE WHEN peak_category = 'Super Peak' THEN hour END) AS peak_hours_count,
    least(coalesce(sum(CASE WHEN peak_category = 'Super Peak' THEN flight_count END) * 0.2, 0.0),
          CAST(coalesce(sum(CASE WHEN peak_category = 'Low Traffic' THEN 20 - flight_count END), 0) AS DOUBLE)) AS redistribution_feasible
  FROM lab))
"""))
def _oo(spark, d):
    return P.optimization_opportunities(P.given_peak_labels(_fl(spark, d)))

