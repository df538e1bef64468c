"""Delay model inputs and evaluation: one-hots, input selection, halving, importance, and quantiles under ties."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from tarmac.functions import quantiles as QU
from tarmac.operators import features as FE
from tarmac.operators import predict as PR
from tarmac.plans import catalog_ml as ML
from tarmac.sources import fixture


def test_one_hots_leave_nulls_and_unseen_values_empty(spark):
    schema = "id int, airline string, aircraft_type string, runway string, capacity_category string"
    fit = FE.fit_one_hots(spark.createDataFrame([(1, "AI", "A320", "14/32", "Small"), (2, "6E", "B777", None, "XLarge"), (3, None, "A320", "09R/27L", None)], schema))
    assert FE.one_hot_names(fit.stages[0]) == {
        "airline_vec": ["airline_6E", "airline_AI"], "aircraft_vec": ["aircraft_A320", "aircraft_B777"],
        "runway_vec": ["runway_09R/27L", "runway_14/32"], "cap_vec": ["cap_Small", "cap_XLarge"]}
    new = spark.createDataFrame([(4, "AI", "E190", "14/32", None), (5, None, None, None, "Medium")], schema)
    out = {r["id"]: {k for k, v in r.asDict().items() if v == 1 and "_" in k and k != "id"} for r in FE.one_hot_columns(new, fit).collect()}
    assert out == {4: {"airline_AI", "runway_14/32"}, 5: set()}
    no_runways = FE.fit_one_hots(spark.createDataFrame([(1, "AI", "A320", None, "Small")], schema))
    assert list(FE.one_hot_names(no_runways.stages[0])) == ["airline_vec", "aircraft_vec", "cap_vec"]


def test_select_features_takes_scalars_then_one_hots(flights):
    df = FE.delay_model_features(flights)
    scalars = FE.select_features(df)
    assert scalars == FE.MODEL_FEATURES
    vectors = FE.fit_one_hots(df).transform(df)
    assert FE.select_features(vectors) == FE.MODEL_FEATURES + ["airline_vec", "aircraft_vec", "runway_vec", "cap_vec"]
    flags = FE.select_features(df.withColumn("runway_X", F.lit(1)).withColumn("airline_note", F.lit("x")), ("runway_", "airline_"))
    assert flags == FE.MODEL_FEATURES + ["runway_X"]


def _airline_decides(spark, n=600):
    rnd = random.Random(5)
    rows = [(f"F{i}", rnd.choice(["AI", "6E", "UK"]), float(rnd.randrange(24))) for i in range(n)]
    return spark.createDataFrame([(i, a, h, 50.0 * (a == "UK") + h / 10) for i, a, h in rows],
                                 "flight_id string, airline string, hour double, delay_minutes double")


def test_model_learns_from_a_category_and_votes_on_importance(spark, tmp_path):
    df = _airline_decides(spark)
    trees = [RandomForestRegressor(labelCol=PR.LABEL, numTrees=5, maxDepth=4, seed=s, predictionCol=c) for s, c in ((1, "pred_rf"), (2, "pred_gbt"))]
    model = PR.train(df, estimators=trees)
    top = {r.feature: r.importance for r in PR.tree_importance(model, 9).collect()}
    assert set(top) == {"airline_6E", "airline_AI", "airline_UK", "hour"} and max(top, key=top.get) == "airline_UK"
    assert sum(top.values()) == pytest.approx(1.0)
    PR.save_model(model, str(tmp_path / "m"))
    out = PR.predict(PR.load_model(str(tmp_path / "m")), df)
    assert out.columns == [*df.columns, "pred_rf", "pred_gbt", "predicted_delay", "exceeds_threshold"]
    assert PR.regression_metrics(out).first().r2 > 0.9


def test_training_rows_are_dealt_by_their_number(spark, monkeypatch):
    """More rows than the cores may hold: more tasks, and the same trees."""
    df = _airline_decides(spark)
    trees = lambda: [GBTRegressor(labelCol=PR.LABEL, maxIter=2, maxDepth=3, seed=1, predictionCol="pred_gbt")]
    whole = PR.predict(PR.train(df, estimators=trees()), df)
    tasks, keep = [], PR.cut_lineage
    monkeypatch.setattr(PR, "ROWS_A_TASK", 50)
    monkeypatch.setattr(PR, "cut_lineage", lambda x: tasks.append(keep(x)) or tasks[-1])
    dealt = PR.predict(PR.train(df, estimators=trees()), df)
    assert [t.rdd.getNumPartitions() for t in tasks] == [12] and tasks[0].count() == 600
    assert dealt.columns == whole.columns
    a, b = ({r.flight_id: r.predicted_delay for r in x.collect()} for x in (whole, dealt))
    assert a == {k: pytest.approx(v) for k, v in b.items()}


def test_estimators_read_rows_encoded_once(spark, monkeypatch):
    """Few rows too: all estimators train on one checkpoint of the encoded rows."""
    kept, keep = [], PR.cut_lineage
    monkeypatch.setattr(PR, "cut_lineage", lambda x: kept.append(keep(x)) or kept[-1])
    trees = [RandomForestRegressor(labelCol=PR.LABEL, numTrees=2, maxDepth=2, seed=1, predictionCol="pred_rf"),
             GBTRegressor(labelCol=PR.LABEL, maxIter=2, maxDepth=2, seed=1, predictionCol="pred_gbt")]
    model = PR.train(_airline_decides(spark), estimators=trees)
    assert len(kept) == 1 and kept[0].count() == 600
    assert [type(s).__name__ for s in model.stages[-2:]] == ["RandomForestRegressionModel", "GBTRegressionModel"]


def test_folds_share_one_encoding(spark, monkeypatch):
    """One fit of the inputs for all folds; results as if each fold had fitted its own, also where a value or a whole
    category occurs in the held-out fold only."""
    df = _airline_decides(spark).withColumn("_fold", PR.fold_of(F.col("flight_id"), 3))
    df = df.withColumn("airline", F.when((F.col("_fold") == 1) & (F.col("hour") < 4), "ZZ").otherwise(F.col("airline")))
    df = df.withColumn("runway", F.when(F.col("_fold") == 2, F.concat(F.lit("R"), F.col("hour") % 2))).cache()
    trees = [RandomForestRegressor(labelCol=PR.LABEL, numTrees=4, maxDepth=4, seed=3, featureSubsetStrategy="all", bootstrap=False, predictionCol="pred_rf"),
             GBTRegressor(labelCol=PR.LABEL, maxIter=3, maxDepth=3, seed=3, predictionCol="pred_gbt")]
    alone = []
    for f in range(3):
        model = PR.train(df.filter(F.col("_fold") != f), estimators=trees)
        slots = sum(map(len, FE.one_hot_names(model.stages[0]).values()))
        assert slots == {0: 6, 1: 5, 2: 4}[f]
        alone.append(PR.predict(model, df.filter(F.col("_fold") == f)).select(F.col("_fold").alias("fold"), PR.LABEL, "predicted_delay"))
    each = PR.fold_metrics(alone[0].union(alone[1]).union(alone[2])).agg(*[g(c) for c in ("mae", "r2") for g in (F.avg, F.stddev_samp)]).first()
    fits, inputs = [], PR.input_stages
    monkeypatch.setattr(PR, "input_stages", lambda x: fits.append(1) or inputs(x))
    both = {r.metric: r for r in PR.cross_validate(df.drop("_fold"), 3, estimators=trees).collect()}
    assert len(fits) == 1
    assert [both["mae"]["mean"], both["mae"]["std"], both["r2"]["mean"], both["r2"]["std"]] == [pytest.approx(v) for v in each]


def test_dealt_tasks_fill_the_cores(spark, monkeypatch):
    monkeypatch.setattr(PR, "ROWS_A_TASK", 50)
    cores = spark.sparkContext.defaultParallelism
    ready = spark.range(0, 50 * cores + 1, 1, 3).withColumn(PR.LABEL, F.lit(1.0))
    assert PR._for_training(ready, 50 * cores + 1).rdd.getNumPartitions() == 2 * cores
    assert PR._for_training(ready, 50 * cores).rdd.getNumPartitions() == 3
    assert [PR._folds_at_once(n, 3, 12) for n in (0, 600_000, 6_000_000, 9_000_000, 36_000_000)] == [3, 3, 3, 2, 1]


def test_inputs_of_a_fold():
    values = [{"_fold": 0, "airline": ["AI"]}, {"_fold": 1, "airline": ["AI", "ZZ"]}, {"_fold": None, "airline": ["6E"]}]
    names, slots = ["hour", "airline_vec"], {"airline_vec": ["airline_6E", "airline_AI", "airline_ZZ"]}
    assert [PR._fold_slots(names, slots, values, f) for f in (0, 1)] == [[0, 2, 3], [0, 2]]


@pytest.fixture
def fitted(spark, monkeypatch):
    """Sizes of the trees that the queries of the delay model ask for, on flights of its own; one tree each is trained."""
    rnd = random.Random(7)
    events = [(i, datetime(2024, 1, 1) + timedelta(minutes=7 * i), rnd.randrange(300), rnd.choice(["error", "view"]), rnd.random() * 90, f'{{"k": {rnd.randrange(99)}}}')
              for i in range(400)]
    fl = fixture.flights_from_events(spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"))
    monkeypatch.setattr(ML, "_fl", lambda spark, d: fl)
    sizes = []
    for kind, trees in ((GBTRegressor, "maxIter"), (RandomForestRegressor, "numTrees")):
        def fit(self, rows, kind=kind, trees=trees, whole=kind._fit):
            sizes.append((kind.__name__, self.getOrDefault(trees), self.getMaxDepth()))
            return whole(self.copy({self.getParam(trees): 1, self.maxDepth: 2}), rows)
        monkeypatch.setattr(kind, "_fit", fit)
    return sizes


GBT, FOREST, SECOND = ("GBTRegressor", 120, 6), ("RandomForestRegressor", 120, 12), ("GBTRegressor", 100, 6)


def test_cross_validated_query_trains_whole_models(spark, fitted):
    assert {r.metric for r in ML._cvm(spark, "").collect()} == {"mae", "r2"}
    assert fitted == [GBT] * 5


def test_importance_query_trains_whole_models(spark, fitted):
    assert len(ML._dfim(spark, "").collect()) == 10
    assert fitted == [GBT, FOREST, SECOND]


def test_held_out_queries_train_whole_models(spark, fitted):
    assert ML._dme(spark, "").count() > 50
    assert fitted == [GBT, FOREST, SECOND]
    assert ML._dmf(spark, "").count() > 50
    assert fitted[3:] == [("RandomForestRegressor", 150, 12)]


def test_tune_halves_points_and_keeps_the_best(spark):
    df = _airline_decides(spark)
    grid = {"maxDepth": [1, 4], "maxIter": [3, 9], "stepSize": [0.05, 0.5], "subsamplingRate": [1.0]}
    model, log = PR.tune(df, trials=8, k=4, grid=grid, eta=2)
    rows = log.collect()
    by_rung = {}
    for r in rows:
        by_rung.setdefault(r.rung, []).append(r)
    assert [len(by_rung[r]) for r in sorted(by_rung)] == [8, 4, 2]
    for r in (0, 1):  # the next rung holds exactly the best half
        best = sorted(by_rung[r], key=lambda x: (x.mae, x.point))[:len(by_rung[r]) // 2]
        assert {x.point for x in best} == {x.point for x in by_rung[r + 1]}
    assert all(x.rounds == x.max_iter for x in by_rung[2])
    winner = min(by_rung[2], key=lambda x: (x.mae, x.point))
    assert winner.step_size == 0.5 and model.stages[-1].getMaxIter() == winner.max_iter
    assert PR.regression_metrics(PR.predict(model, df)).first().r2 > 0.8


def test_tune_trains_side_by_side_what_fits(spark, monkeypatch):
    """As many points at a time as their rows allow, with the same scores."""
    df = _airline_decides(spark)
    grid = {"maxDepth": [2, 3], "maxIter": [2, 4], "stepSize": [0.3], "subsamplingRate": [1.0]}
    seen, run = [], PR._together
    monkeypatch.setattr(PR, "_together", lambda jobs, n: seen.append(n) or run(jobs, n))
    logs = []
    for rows in (PR.ROWS_A_CORE, 100):
        monkeypatch.setattr(PR, "ROWS_A_CORE", rows)
        logs.append(sorted(map(tuple, PR.tune(df, trials=4, k=4, grid=grid, eta=2)[1].collect())))
    assert seen == [3, 3, 1, 1]
    assert logs[0] == [(*r[:-1], pytest.approx(r[-1])) for r in logs[1]]


def test_fold_metrics_of_a_constant_fold(spark):
    df = spark.createDataFrame([(0, 5.0, 6.0), (0, 5.0, 4.0), (1, 1.0, 1.0), (1, 3.0, 2.0)], "fold int, delay_minutes double, predicted_delay double")
    assert sorted(map(tuple, PR.fold_metrics(df).collect())) == [(0, 2, 1.0, None), (1, 2, 0.5, 0.5)]


@pytest.mark.parametrize("few", [4, 4096])
def test_quantile_under_ties(spark, monkeypatch, few):
    monkeypatch.setattr(QU, "FEW_VALUES", few)
    rnd = random.Random(3)
    for values in ([7.5] * 5000, [1.0] * 3000 + [rnd.random() for _ in range(2000)], [float(i % 40) for i in range(5000)]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for q in (0.0, 0.5, 0.8, 0.9999, 1.0):
            assert QU.exact_percentile(df, "v", q) == pytest.approx(df.agg(F.percentile("v", q)).first()[0], rel=1e-12)
