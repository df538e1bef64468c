"""Anomaly detection (M1-M8).

* M1 isolation forest: no MLlib equivalent. Each tree's <= 256-row subsample is drawn by a
  per-(row, tree) hash test, so a row emits only the trees that picked it (about 100 x 256
  rows in total, independent of the table size). Trees are grown per tree with
  ``applyInPandas`` (one group = one bounded subsample), the forest (at most 100 x 511 nodes)
  is broadcast and every row is scored by an Arrow-batched column, without a join. The fitted object
  holds scaler, trees and offset: it is saved, loaded and scores rows that it has not seen.
* M2 DBSCAN: a graph of cells of side eps / sqrt(d). Full cells hold core points only, points of thin
  cells are compared with their neighbouring cells, and two cells are linked by boxes that are halved
  until decided. Clusters are components of cells; neighbour pairs are never stored.
* M3 flags a flight that either detector flags; M4-M8 work on a flagged table and are plain aggregates.
"""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.functions.components import ranked, smallest_labels
from tarmac.functions.quantiles import exact_percentile
from tarmac.functions.scalars import with_scalars
from tarmac.session import stored

# FIXED VALUES: anomaly type -> recommended action
ACTIONS = {
    "Severe Delay": "Immediate intervention required - Consider flight rebooking or gate reassignment",
    "Congestion Anomaly": "Activate congestion management protocols",
    "Peak Hour Disruption": "Deploy additional ground crew and expedite turnaround",
    "Runway Overutilization": "Consider runway redistribution or delay non-critical flights",
    "Large Aircraft Anomaly": "Ensure adequate ground support and runway capacity",
    "General Anomaly": "Monitor closely and investigate root cause",
}

# FIXED VALUES: detector feature list
ANOMALY_FEATURES = [
    "hour", "day_of_week", "month", "day_of_year", "delay_minutes", "is_delayed", "capacity_utilization",
    "is_peak_hour_int", "is_weekend", "congestion_factor", "high_congestion", "rolling_delay_mean",
    "rolling_delay_std", "hourly_traffic_density", "runway_utilization",
]


def standardize(df: DataFrame, cols: list[str], prefix: str = "z_") -> DataFrame:
    """(x - mean) / population std, like a fitted StandardScaler (std 0 -> scale 1)."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    out = with_scalars(df, stats)
    for c in cols:
        s = F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
        out = out.withColumn(f"{prefix}{c}", (F.col(c).cast("double") - F.col(f"_m_{c}")) / s)
    return out.drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


# ---------------------------------------------------------------- M1 isolation forest
def _c(n: float) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


TREE_SCHEMA = "tree int, feat array<int>, thr array<double>, left array<int>, right array<int>, size array<int>"


def _grow(pdf: pd.DataFrame, n_features: int, seed: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    X = np.vstack(pdf["x"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, n_features))
    rng = np.random.default_rng(seed * 100003 + tree)
    max_depth = int(math.ceil(math.log2(max(len(X), 2))))
    feat, thr, left, right, size = [], [], [], [], []

    def build(idx: np.ndarray, depth: int) -> int:
        node = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return node
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            return node
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[node], thr[node] = f, t
        mask = sub[:, f] < t
        left[node] = build(idx[mask], depth + 1)
        right[node] = build(idx[~mask], depth + 1)
        return node

    build(np.arange(len(X)), 0)
    return pd.DataFrame({"tree": [tree], "feat": [feat], "thr": [thr], "left": [left], "right": [right], "size": [size]})


@dataclass(frozen=True)
class IsolationForest:
    """A fitted forest: the scaler and the trees of at most ``sample_size`` rows each, so its size does not depend on the table."""

    features: list[str]
    mean: list[float]
    scale: list[float]
    trees: list[dict]
    sample_size: int
    offset: float

    def raw_scores(self, df: DataFrame) -> Column:
        """The raw score in (-1, 0) of each row of ``df``: one Arrow-batched column, no join. Nulls count as 0."""
        forest = df.sparkSession.sparkContext.broadcast(self.trees)
        mean, scale, c_psi = np.array(self.mean), np.array(self.scale), max(_c(self.sample_size), 1e-12)

        @F.pandas_udf("double")
        def raw(xs: pd.Series) -> pd.Series:
            z = (np.vstack(xs.to_numpy()) - mean) / scale if len(xs) else np.zeros((0, len(mean)))
            depth = np.zeros(len(z))
            for tree in forest.value:
                depth += _depths(tree, z)
            return pd.Series(-np.power(2.0, -(depth / len(forest.value)) / c_psi))

        return raw(_inputs(self.features))

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with isolation_score (below 0: anomaly), isolation_anomaly and anomaly_confidence. ``df`` may be other
        rows than those of the fit: scaler, trees and offset are the fitted ones."""
        return df.withColumn("isolation_score", self.raw_scores(df) - F.lit(self.offset)).withColumns({
            "isolation_anomaly": (F.col("isolation_score") < 0).cast("int"),
            "anomaly_confidence": F.abs("isolation_score"),
        })

    def save(self, spark: SparkSession, path: str) -> None:
        head = [(self.features, self.mean, self.scale, self.sample_size, self.offset)]
        spark.createDataFrame(head, HEAD_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/head")
        spark.createDataFrame([tuple(t.values()) for t in self.trees], TREE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IsolationForest:
        head = spark.read.parquet(f"{path}/head").first()
        trees = [r.asDict() for r in spark.read.parquet(f"{path}/trees").orderBy("tree").collect()]
        return IsolationForest(head["features"], head["mean"], head["scale"], trees, head["sample_size"], head["offset"])


HEAD_SCHEMA = "features array<string>, mean array<double>, scale array<double>, sample_size int, offset double"


def _inputs(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])


def _depths(tree: dict, z: np.ndarray) -> np.ndarray:
    """Path length of each row in one tree, with the expected rest of the path below its leaf."""
    feat, thr, left, right = (np.asarray(tree[k]) for k in ("feat", "thr", "left", "right"))
    node, depth = np.zeros(len(z), dtype=int), np.zeros(len(z))
    active = np.flatnonzero(feat[node] >= 0)
    while len(active):
        at = node[active]
        node[active] = np.where(z[active, feat[at]] < thr[at], left[at], right[at])
        depth[active] += 1
        active = active[feat[node[active]] >= 0]
    return depth + np.array([_c(n) for n in tree["size"]])[node]


def fit_isolation_forest(df: DataFrame, features: list[str], n_trees: int = 100, max_samples: int = 256, contamination: float = 0.1,
                         seed: int = 42, id_col: str = "flight_id") -> IsolationForest:
    """Scaler, trees and offset from ``df``, whose inputs are computed once. The offset is the exact
    ``contamination`` quantile of the raw scores of all rows of ``df``. An empty table raises ValueError."""
    x = stored(df.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]), "detector-inputs")
    cols = [f"x{i}" for i in range(len(features))]
    n, *stats = x.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    if n == 0:
        raise ValueError("need at least one row to fit an isolation forest")
    mean, scale = stats[:len(cols)], [s if s > 0 else 1.0 for s in stats[len(cols):]]
    psi = min(max_samples, n)
    # a row lists only the trees whose hash test it passes (about 2 x psi rows per tree in expectation), then each tree
    # keeps its psi smallest hashes: the rows that leave their task do not grow with the table
    mod = 2 ** 31 - 1
    bound = int(min(1.0, 2.0 * psi / n) * mod)

    def h(t: Column) -> Column:
        return F.abs(F.xxhash64(F.col("id"), F.lit(seed), t)) % mod

    z = F.array(*[(F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(cols, mean, scale)])
    trees_of_row = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: h(t) <= bound)
    picks = x.select("id", z.alias("x"), F.explode(trees_of_row).alias("tree")).withColumn("_h", h(F.col("tree")))
    sample = picks.withColumn("_r", F.row_number().over(Window.partitionBy("tree").orderBy("_h", "id"))).filter(F.col("_r") <= psi)
    width = len(features)
    grown = sample.select("tree", "x").groupBy("tree").applyInPandas(lambda p: _grow(p, width, seed), TREE_SCHEMA)
    trees = [r.asDict() for r in grown.orderBy("tree").collect()]  # bounded: n_trees x (2 * max_samples - 1) nodes
    plain = IsolationForest(cols, mean, scale, trees, psi, 0.0)
    offset = exact_percentile(stored(x.select(plain.raw_scores(x).alias("raw")), "raw-scores"), "raw", contamination)
    return IsolationForest(list(features), mean, scale, trees, psi, offset)


def isolation_forest(df: DataFrame, features: list[str], n_trees: int = 100, max_samples: int = 256,
                     contamination: float = 0.1, seed: int = 42, id_col: str = "flight_id") -> DataFrame:
    """Fit on ``df`` and score the same rows (``IsolationForest.score``)."""
    return fit_isolation_forest(df, features, n_trees, max_samples, contamination, seed, id_col).score(df)


# ---------------------------------------------------------------- M2 DBSCAN
def _gap(ga: Column, gb: Column) -> Column:
    """Squared least distance of two grid cells in units of the cell's side."""
    return F.aggregate(F.zip_with(ga, gb, lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)).cast("double")), F.lit(0.0), lambda acc, x: acc + x * x)


def _distance2(v: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(v, w, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def _cell_neighbours(cells: DataFrame, side: float, eps: float, grid: list[int]) -> DataFrame:
    """``a, b``: different cells that may hold points within eps. Cells, not points, meet: by coarse bins of
    the ``grid`` dimensions, then by the least distance of the cells on all dimensions."""
    wide = eps + side
    bins = [F.floor(F.element_at("cell", i + 1) * side / wide).alias(f"g{k}") for k, i in enumerate(grid)]
    keyed = cells.select("id", "cell", *bins)
    names = [f"g{k}" for k in range(len(grid))]
    offsets = F.array(*[F.array(*[F.lit(o) for o in off]) for off in itertools.product([-1, 0, 1], repeat=len(grid))])
    other = keyed.select(F.col("id").alias("b"), F.col("cell").alias("b_cell"), F.explode(offsets).alias("_o"), *names) \
        .select("b", "b_cell", *[(F.col(g) + F.col("_o")[k]).alias(g) for k, g in enumerate(names)])
    near = _gap(F.col("cell"), F.col("b_cell")) * (side * side) <= eps * eps * (1 + 1e-9)  # a wider net; points decide
    return keyed.join(other, names).filter((F.col("id") != F.col("b")) & near).select(F.col("id").alias("a"), "b")


def _linked_cells(core: DataFrame, pairs: DataFrame, eps: float, dims: int) -> DataFrame:
    """``a, b`` (a < b): cells with two core points within eps of each other, decided by boxes.

    Bounding boxes of core points whose farthest corners are within eps link their cells; boxes farther
    apart than eps are dropped; the others are halved along every dimension. A box of one distinct point
    is always decided, so this ends, and no two cells' points are ever paired as a whole.
    """
    def boxes(level: int) -> DataFrame:
        sub = F.transform("u", lambda x: F.floor(x * float(2 ** level)).cast("long"))
        up = F.transform("u", lambda x: F.floor(x * float(2 ** max(0, level - 1))).cast("long"))
        edges = [f(F.element_at("v", i + 1)).alias(f"{n}{i}") for i in range(dims) for n, f in (("l", F.min), ("h", F.max))]
        box = core.groupBy("id", sub.alias("sub"), up.alias("up")).agg(*edges)
        return box.select("id", "sub", "up", F.array(*[f"l{i}" for i in range(dims)]).alias("low"), F.array(*[f"h{i}" for i in range(dims)]).alias("high"))

    def side(table: DataFrame, n: str) -> DataFrame:
        return table.select(F.col("id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("sub", "up", "low", "high")])

    open_pairs, links, level = pairs.filter("a < b"), [], 0
    while True:
        table = boxes(level)
        both = open_pairs.join(side(table, "a"), ["a"] if level == 0 else ["a", "a_up"]).join(side(table, "b"), ["b"] if level == 0 else ["b", "b_up"])
        span = lambda f: F.aggregate(F.zip_with(F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y), f), F.lit(0.0), lambda acc, x: acc + x * x)
        far = span(lambda x, y: F.greatest(F.abs(x), F.abs(y)))  # farthest corners
        near = span(lambda x, y: F.greatest(x, y, F.lit(0.0)))
        judged = stored(both.withColumns({"far": far, "near": near}).filter(F.col("near") <= eps * eps).select("a", "b", F.col("a_sub").alias("a_up"), F.col("b_sub").alias("b_up"), "far"), "boxes")
        linked = judged.filter(F.col("far") <= eps * eps).select("a", "b").distinct()
        links.append(linked)
        open_pairs = judged.filter(F.col("far") > eps * eps).drop("far").join(linked, ["a", "b"], "left_anti")
        if open_pairs.isEmpty():
            return functools.reduce(DataFrame.unionByName, links).distinct()
        level += 1


def dbscan(df: DataFrame, features: list[str], eps: float = 0.5, min_samples: int = 5, id_col: str = "flight_id",
           scaled: bool = True, grid_dims: int = 3) -> DataFrame:
    """Exact DBSCAN (Euclidean) on standardised features by a graph of cells. Returns id_col, dbscan_cluster
    (-1 = noise). Border points join the cluster with the smallest core id among their core neighbours.

    Points of a cell of side eps / sqrt(d) are all within eps. A cell with ``min_samples`` points holds core
    points only; a point of another cell is compared with the points of neighbouring cells, and as such a
    cell has fewer than ``min_samples`` points, these comparisons grow with the number of points.
    Clusters are components of cells; no table of neighbour pairs is made.
    """
    z = standardize(df, features) if scaled else df.select(id_col, *[F.col(c).alias(f"z_{c}") for c in features])
    zc = [f"z_{c}" for c in features]
    dims, side = len(zc), eps / math.sqrt(len(zc))
    var = z.agg(*[F.variance(c).alias(c) for c in zc]).first().asDict()
    grid = sorted(range(dims), key=lambda i: -(var[zc[i]] or 0.0))[:grid_dims]
    v = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in zc])
    pts = z.select(F.col(id_col).alias("pid"), v.alias("v")).withColumn("u", F.transform("v", lambda x: x / side))
    pts = stored(pts.withColumn("cell", F.transform("u", lambda x: F.floor(x).cast("long"))), "points")
    cells = stored(pts.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.monotonically_increasing_id()), "cells")
    pts = stored(pts.join(cells, "cell").select("pid", "v", "u", "id", "n"), "points")
    pairs = stored(_cell_neighbours(cells, side, eps, grid), "cell-pairs")

    within = _distance2(F.col("m.v"), F.col("v")) <= eps * eps

    def compared(members: DataFrame, others: DataFrame, *keep: str) -> DataFrame:
        """``m`` (a point of a thin cell) with each point of ``others`` in a neighbouring cell within eps."""
        few = members.groupBy(F.col("id").alias("a")).agg(F.collect_list(F.struct("pid", "v")).alias("few"))  # fewer than min_samples
        return pairs.join(few, "a").join(others.select(F.col("id").alias("b"), "v", *keep), "b").select(F.explode("few").alias("m"), "v", *keep).filter(within)

    thin = pts.filter(F.col("n") < min_samples)
    around = compared(thin, pts).groupBy(F.col("m.pid").alias("pid")).agg(F.count(F.lit(1)).alias("k"))
    full = thin.join(around, "pid", "left").withColumn("core", F.col("n") + F.coalesce("k", F.lit(0)) >= min_samples)
    state = stored(pts.filter(F.col("n") >= min_samples).withColumn("core", F.lit(True)).unionByName(full.drop("k")), "cores")
    core = state.filter("core")
    named = core.groupBy("id").agg(F.min("pid").alias("least"))
    core_cells = named.select(F.col("id").alias("node"))
    core_pairs = pairs.join(core_cells.withColumnRenamed("node", "a"), "a", "left_semi").join(core_cells.withColumnRenamed("node", "b"), "b", "left_semi")
    label = smallest_labels(core_cells, _linked_cells(core, core_pairs, eps, dims))
    least = named.join(label, F.col("id") == F.col("node"))
    cluster = stored(least.join(least.groupBy("lab").agg(F.min("least").alias("name")), "lab").select("id", "name"), "clusters")  # cell -> its cluster's smallest core id

    inside = state.join(cluster, "id", "left").select("pid", "id", "v", "core", "name")  # in a cell with a core point all points are within eps of it
    around = compared(state.filter("not core"), core.join(cluster, "id"), "name").groupBy(F.col("m.pid").alias("pid")).agg(F.min("name").alias("near"))
    out = inside.join(around, "pid", "left").select("pid", F.when(F.col("core"), F.col("name")).otherwise(F.least("name", "near")).alias("name"))
    numbers = ranked(cluster.select("name").distinct(), "_number")
    return out.join(numbers, "name", "left").select(F.col("pid").alias(id_col), F.coalesce(F.col("_number").cast("int"), F.lit(-1)).alias("dbscan_cluster"))


# ---------------------------------------------------------------- M3 - M8 on a flagged table
def combine_anomalies(scored: DataFrame, clusters: DataFrame, id_col: str = "flight_id") -> DataFrame:
    """A flight is an anomaly when the forest flags it or DBSCAN leaves it as noise (-1)."""
    noise = (F.col("dbscan_cluster") == -1).cast("int")
    return scored.join(clusters.select(id_col, "dbscan_cluster"), id_col).withColumns({
        "dbscan_anomaly": noise, "combined_anomaly": F.greatest("isolation_anomaly", noise)})


def detect_anomalies(model: IsolationForest, feats: DataFrame, eps: float = 0.5, min_samples: int = 5,
                     cluster_features: list[str] | None = None) -> DataFrame:
    """Typed anomalies of ``feats``: the fitted forest scores them, DBSCAN, which has no fitted form, clusters them
    anew on ``cluster_features`` (all inputs of the model where not given)."""
    feats = stored(feats, "detector-features")
    clusters = dbscan(feats, cluster_features or model.features, eps, min_samples)
    return classify_anomaly_types(combine_anomalies(model.score(feats), clusters))


def classify_anomaly_types(flagged: DataFrame) -> DataFrame:
    """Ordered type rules; the 95th percentiles are one-row aggregates attached to every row."""
    q = flagged.agg(F.percentile("runway_utilization", 0.95).alias("_qr"), F.percentile("capacity", 0.95).alias("_qc"))
    df = with_scalars(flagged, q)
    d = F.coalesce(F.col("delay_minutes"), F.lit(0.0))
    t = (
        F.when(F.col("combined_anomaly") == 0, "Normal")
        .when(d > 60, "Severe Delay")
        .when(F.col("high_congestion") == 1, "Congestion Anomaly")
        .when((F.col("is_peak_hour_int") == 1) & (d > 30), "Peak Hour Disruption")
        .when(F.col("runway_utilization") > F.col("_qr"), "Runway Overutilization")
        .when(F.col("capacity") > F.col("_qc"), "Large Aircraft Anomaly")
        .otherwise("General Anomaly")
    )
    return df.withColumn("anomaly_type", t).drop("_qr", "_qc")


def anomaly_summary(typed: DataFrame) -> DataFrame:
    one = typed.agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.sum("isolation_anomaly").alias("isolation_anomalies"),
        F.sum("dbscan_anomaly").alias("dbscan_anomalies"),
        F.sum("combined_anomaly").alias("combined_anomalies"),
        (F.avg("combined_anomaly") * 100).alias("anomaly_rate"),
        *([F.count_distinct(F.when(F.col("dbscan_cluster") >= 0, F.col("dbscan_cluster"))).alias("unique_clusters")]
          if "dbscan_cluster" in typed.columns else []),
    )
    return one


def feature_importance_corr(scored: DataFrame, features: list[str], score: str = "isolation_score") -> DataFrame:
    """|corr(feature, |score|)| per feature from ONE aggregate pass, null -> 0, unpivoted."""
    y = F.abs(F.col(score))

    def corr(x: Column) -> Column:  # constant columns give 0 instead of a division error
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    one = scored.agg(*[corr(F.col(c).cast("double")).alias(c) for c in features])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.abs(F.col(c)), F.lit(0.0)).alias("importance")) for c in features])
    return one.select(F.inline(rows))


def anomaly_patterns(typed: DataFrame) -> DataFrame:
    a = typed.filter(F.col("combined_anomaly") == 1)
    return a.agg(
        F.count(F.lit(1)).alias("anomalies"),
        F.avg("delay_minutes").alias("mean_delay"), F.percentile("delay_minutes", 0.5).alias("median_delay"),
        F.max("delay_minutes").alias("max_delay"), F.stddev_samp("delay_minutes").alias("std_delay"),
        (F.count_if(F.col("is_peak_hour_int") == 1) * 100.0 / F.count(F.lit(1))).alias("peak_hour_anomaly_rate"),
        (F.count_if(F.col("high_congestion") == 1) * 100.0 / F.count(F.lit(1))).alias("congestion_anomaly_rate"),
    )


def anomaly_distribution(typed: DataFrame, col: str) -> DataFrame:
    return typed.filter(F.col("combined_anomaly") == 1).groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def anomaly_rollups(typed: DataFrame, by: str) -> DataFrame:
    g = typed.groupBy(by).agg(
        F.sum("combined_anomaly").alias("anomalies"), F.count("flight_id").alias("flights"),
        F.avg("delay_minutes").alias("avg_delay"))
    return g.withColumn("anomaly_rate", F.col("anomalies") / F.col("flights") * 100)


def anomaly_alerts(typed: DataFrame) -> DataFrame:
    """Anomalies whose confidence exceeds the 80th percentile of all confidences (an exact order
    statistic: confidences are continuous detector scores)."""
    q = exact_percentile(typed, "anomaly_confidence", 0.8)
    df = typed.filter((F.col("combined_anomaly") == 1) & (F.col("anomaly_confidence") > F.lit(q)))
    c, d, t = F.col("anomaly_confidence"), F.col("delay_minutes"), F.col("anomaly_type")
    sev = (F.when((c > 1.5) | (d > 60) | (t == "Severe Delay"), "Critical").when((c > 1.0) | (d > 30), "High")
           .when((c > 0.5) | (d > 15), "Medium").otherwise("Low"))
    action = F.coalesce(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[t], F.lit("Monitor and investigate"))
    return df.select("flight_id", "airline", "scheduled_time", "runway", "anomaly_type", c.alias("confidence"),
                     "delay_minutes", sev.alias("severity"), action.alias("recommended_action"))


def detection_metrics(flagged: DataFrame, truth: Column | None = None) -> DataFrame:
    """Confusion counts and accuracy/precision/recall/F1 (0 when undefined); truth defaults to delay > 60."""
    y = (truth if truth is not None else (F.col("delay_minutes") > 60)).cast("int")
    p = F.col("combined_anomaly")
    one = flagged.agg(
        F.count_if((y == 1) & (p == 1)).alias("true_positives"), F.count_if((y == 0) & (p == 1)).alias("false_positives"),
        F.count_if((y == 0) & (p == 0)).alias("true_negatives"), F.count_if((y == 1) & (p == 0)).alias("false_negatives"),
        F.count(F.lit(1)).alias("total_predictions"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("true_positives", "false_positives", "true_negatives", "false_negatives"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return one.withColumns({
        "accuracy": (tp + tn) / F.col("total_predictions"),
        "precision": prec, "recall": rec,
        "f1_score": F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0),
    }).withColumn("accuracy_percentage", F.col("accuracy") * 100)
