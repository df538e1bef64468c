"""The skew-safe window helpers give exactly the plain-window result for any bucket size."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarmac.functions.windows import forward_fill, row_index, with_neighbors


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    rows = []
    for key in ["a", "b", "c"]:
        n = {"a": 300, "b": 5, "c": 1}[key]  # one hot key, one tiny, one single row
        for i in range(n):
            v = rnd.choice([None, None, rnd.randint(0, 99)])
            rows.append((key, rnd.randint(0, 50), i, v, float(rnd.randint(0, 60))))
    return spark.createDataFrame(rows, "k string, t int, id int, v int, x double")


@pytest.mark.parametrize("bucket_size", [1, 3, 7, 1000])
def test_with_neighbors_matches_plain_window(data, bucket_size):
    w = Window.partitionBy("k").orderBy("t", "id")
    expected = data.select(
        "k", "id", F.lag("id").over(w).alias("p"), F.lead("id", 2).over(w).alias("n2"),
        F.avg("x").over(w.rowsBetween(-3, 0)).alias("m"),
    )

    def compute(frame, wb):
        return frame.withColumns({"p": F.lag("id").over(wb), "n2": F.lead("id", 2).over(wb),
                                  "m": F.avg("x").over(wb.rowsBetween(-3, 0))})

    got = with_neighbors(data, ["k"], ["t", "id"], F.floor(F.col("t") / bucket_size), 3, 2, compute).select("k", "id", "p", "n2", "m")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("bucket_size", [1, 4, 1000])
def test_forward_fill_matches_last_ignore_nulls(data, bucket_size):
    df = data.withColumn("o", F.col("t") * 1000 + F.col("id"))
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    expected = df.select("k", "id", F.last("v", ignorenulls=True).over(w).alias("f"))
    got = forward_fill(df, ["k"], "o", {"f": F.col("v")}, F.floor(F.col("o") / (bucket_size * 1000))).select("k", "id", "f")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


@pytest.mark.parametrize("bucket_size", [1, 5, 1000])
def test_row_index_matches_row_number(data, bucket_size):
    w = Window.partitionBy("k").orderBy("t", "id")
    expected = data.select("k", "id", (F.row_number().over(w) - 1).alias("r"))
    got = row_index(data, ["k"], ["t", "id"], F.floor(F.col("t") / bucket_size), "r").select("k", "id", "r")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_exact_percentile_matches_percentile(spark):
    from tarmac.functions.quantiles import exact_percentile

    rnd = random.Random(11)
    df = spark.createDataFrame([(rnd.random() ** 3,) for _ in range(5000)] + [(None,)], "s double")
    for q in (0.0, 0.1, 0.5, 0.8, 0.95, 1.0):
        exp = df.agg(F.percentile("s", q)).first()[0]
        assert exact_percentile(df, "s", q, accuracy=200) == pytest.approx(exp, rel=1e-12, abs=1e-15)


@pytest.mark.parametrize("bucket_size", [1, 3, 1000])
def test_with_neighbors_single_row_halo(data, bucket_size):
    w = Window.partitionBy("k").orderBy("t", "id")
    expected = data.select("k", "id", F.lag("id").over(w).alias("p"), F.lead("x").over(w).alias("n"))

    def compute(frame, wb):
        return frame.withColumns({"p": F.lag("id").over(wb), "n": F.lead("x").over(wb)})

    got = with_neighbors(data, ["k"], ["t", "id"], F.floor(F.col("t") / bucket_size), 1, 1, compute).select("k", "id", "p", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
