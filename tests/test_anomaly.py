"""Isolation forest and DBSCAN sanity / brute-force checks."""

from __future__ import annotations

import math
import random

import pytest

from tarmac.operators import anomaly as M


def test_isolation_forest_ranks_planted_outliers(spark):
    rnd = random.Random(1)
    rows = [(f"n{i}", rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(400)]
    rows += [(f"o{i}", 8.0 + i, -9.0 - i) for i in range(5)]
    df = spark.createDataFrame(rows, "flight_id string, a double, b double")
    out = M.isolation_forest(df, ["a", "b"], n_trees=50, max_samples=128, contamination=0.05, seed=3)
    flagged = {r.flight_id for r in out.filter("isolation_anomaly = 1").collect()}
    assert {f"o{i}" for i in range(5)} <= flagged
    assert abs(len(flagged) - 0.05 * 405) <= 3


def _dbscan_brute(points, eps, min_samples):
    ids = list(points)
    nb = {i: [j for j in ids if math.dist(points[i], points[j]) <= eps] for i in ids}
    core = {i for i in ids if len(nb[i]) >= min_samples}
    comp = {}
    for c in sorted(core):
        if c in comp:
            continue
        stack, comp[c] = [c], c
        while stack:
            x = stack.pop()
            for y in nb[x]:
                if y in core and y not in comp:
                    comp[y] = c
                    stack.append(y)
    label = {}
    for i in ids:
        if i in core:
            label[i] = comp[i]
        else:
            cs = [comp[j] for j in nb[i] if j in core]
            label[i] = min(cs) if cs else None
    return label


def test_dbscan_matches_brute_force(spark):
    rnd = random.Random(4)
    pts = {}
    for c, (cx, cy) in enumerate([(0, 0), (5, 5), (0, 6)]):
        for i in range(25):
            pts[f"c{c}_{i:02d}"] = (cx + rnd.gauss(0, 0.3), cy + rnd.gauss(0, 0.3))
    for i in range(6):
        pts[f"z{i}"] = (rnd.uniform(-3, 9), rnd.uniform(-3, 9))
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in pts.items()], "flight_id string, x double, y double")
    got = {r[0]: r[1] for r in M.dbscan(df, ["x", "y"], eps=0.5, min_samples=4, scaled=False).collect()}
    exp = _dbscan_brute(pts, 0.5, 4)
    assert {k for k, v in got.items() if v == -1} == {k for k, v in exp.items() if v is None}
    # same partition of the clustered points
    groups_got = {}
    groups_exp = {}
    for k in pts:
        if exp[k] is not None:
            groups_got.setdefault(got[k], set()).add(k)
            groups_exp.setdefault(exp[k], set()).add(k)
    assert sorted(map(sorted, groups_got.values())) == sorted(map(sorted, groups_exp.values()))


@pytest.mark.parametrize("dims,eps,least,seed", [(1, 0.4, 3, 1), (2, 0.5, 4, 2), (3, 0.7, 5, 3), (4, 0.9, 1, 4)])
def test_dbscan_on_cells(spark, dims, eps, least, seed):
    """Hot cells of equal points, cells just within and beyond eps, border points between clusters, nulls."""
    rnd = random.Random(seed)
    pts = {f"d{i:03d}": (0.25,) * dims for i in range(120)}  # a third of all points are equal
    pts |= {f"a{i:03d}": tuple(rnd.gauss(1.2 * (i % 4), 0.25) for _ in range(dims)) for i in range(150)}
    pts |= {f"e{i:02d}": (10 + eps * i,) + (0.0,) * (dims - 1) for i in range(6)}  # exactly eps apart
    pts |= {f"f{i:02d}": (-10 - eps * 1.001 * i,) + (0.0,) * (dims - 1) for i in range(6)}
    cols = ", ".join(f"x{i} double" for i in range(dims))
    rows = [(k, *v) for k, v in pts.items()] + [("null", *([None] * dims))]
    pts["null"] = (0.0,) * dims
    df = spark.createDataFrame(rows, f"flight_id string, {cols}").repartition(4)
    got = {r[0]: r[1] for r in M.dbscan(df, [f"x{i}" for i in range(dims)], eps=eps, min_samples=least, scaled=False).collect()}
    exp = _dbscan_brute(pts, eps, least)
    names = sorted({c for c in exp.values() if c is not None})
    assert got == {k: -1 if c is None else names.index(c) for k, c in exp.items()}


def test_dbscan_stores_no_pairs_of_points(spark):
    """Comparisons stay linear: 3,000 equal points make no row per pair."""
    df = spark.range(3000).selectExpr("cast(id as string) as flight_id", "1.0D as x", "2.0D as y")
    out = M.dbscan(df, ["x", "y"], scaled=False)
    assert out.filter("dbscan_cluster = 0").count() == 3000
    assert M.dbscan(df.limit(0), ["x", "y"], scaled=False).count() == 0


def test_fitted_forest_scores_other_rows_and_survives_saving(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"n{i}", rnd.gauss(0, 1), rnd.gauss(5, 2)) for i in range(600)] + [("null", None, 5.0)]
    df = spark.createDataFrame(rows, "flight_id string, a double, b double")
    model = M.fit_isolation_forest(df, ["a", "b"], n_trees=40, max_samples=128, contamination=0.1, seed=3)
    new = spark.createDataFrame([("in", 0.0, 5.0), ("far", 9.0, -9.0), ("far", 9.0, -9.0), ("null", None, 5.0)], "flight_id string, a double, b double")
    got = [(r.flight_id, r.isolation_anomaly, r.isolation_score) for r in model.score(new).collect()]
    assert sorted((i, f) for i, f, _ in got) == [("far", 1), ("far", 1), ("in", 0), ("null", 0)]
    model.save(spark, str(tmp_path / "forest"))
    again = M.IsolationForest.load(spark, str(tmp_path / "forest"))
    assert again == model
    assert [(r.flight_id, r.isolation_anomaly, r.isolation_score) for r in again.score(new).collect()] == got
    flagged = model.score(df).filter("isolation_anomaly = 1").count()
    assert abs(flagged - 0.1 * 601) <= 2
    assert model.score(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.fit_isolation_forest(df.limit(0), ["a", "b"])


def test_forest_depths_match_a_walk_row_by_row(spark):
    rnd = random.Random(5)
    rows = [(f"n{i}", rnd.random(), float(i % 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "flight_id string, a double, b double")
    model = M.fit_isolation_forest(df, ["a", "b"], n_trees=7, max_samples=32, seed=1)
    got = {r.flight_id: r.isolation_score for r in model.score(df).collect()}
    for fid, *x in rows:
        z, total = [(v - m) / s for v, m, s in zip(x, model.mean, model.scale)], 0.0
        for t in model.trees:
            node, depth = 0, 0
            while t["feat"][node] >= 0:
                node = (t["left"] if z[t["feat"][node]] < t["thr"][node] else t["right"])[node]
                depth += 1
            total += depth + M._c(t["size"][node])
        assert got[fid] == pytest.approx(-2 ** (-total / 7 / M._c(32)) - model.offset, abs=1e-12)


def test_detect_combines_both_detectors(spark):
    rnd = random.Random(6)
    rows = [(f"n{i:03d}", rnd.gauss(0, 0.1), rnd.gauss(0, 0.1)) for i in range(150)] + [("far", 30.0, 30.0)]
    df = spark.createDataFrame(rows, "flight_id string, a double, b double").selectExpr(
        "*", "0D delay_minutes", "0 high_congestion", "0 is_peak_hour_int", "1 runway_utilization", "150 capacity")
    model = M.fit_isolation_forest(df, ["a", "b"], n_trees=30, max_samples=64, contamination=0.05)
    out = {r.flight_id: r for r in M.detect_anomalies(model, df).collect()}
    assert len(out) == 151 and out["far"].dbscan_anomaly == 1 and out["far"].anomaly_type == "General Anomaly"
    assert all(r.combined_anomaly == max(r.isolation_anomaly, r.dbscan_anomaly) for r in out.values())
