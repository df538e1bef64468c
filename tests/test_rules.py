"""Hand-computed rule tables: bins, categories, priorities, parsers, ties."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import dims
from tarmac.operators import cleaning as C
from tarmac.operators.joins import nearest_slot


def _col(spark, values, expr, schema="x double"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_delay_category_right_closed(spark):
    got = _col(spark, [None, -5.0, 0.0, 0.5, 15.0, 15.1, 30.0, 60.0, 61.0], dims.delay_category)
    assert got == [None, "On_Time", "On_Time", "Minor", "Minor", "Moderate", "Moderate", "Major", "Severe"]


def test_peak_category(spark):
    got = _col(spark, [0, 6, 7, 11, 15, 17, 21, 23], dims.peak_category, "x int")
    assert got == ["low", "peak", "super_peak", "moderate", "low", "moderate", "super_peak", "moderate"]


def test_flight_priority(spark):
    df = spark.createDataFrame([(True, True, 10), (None, True, 10), (False, False, 150), (False, False, 50), (False, False, 49)],
                               "e boolean, i boolean, c int")
    got = [r[0] for r in df.select(C.flight_priority(F.col("e"), F.col("i"), F.col("c"))).collect()]
    assert got == [1, 2, 3, 4, 5]


def test_aircraft_category(spark):
    got = _col(spark, ["A320", "B777", "ATR72", "B747-400", "CRJ900", "E190", None], C.aircraft_category, "x string")
    assert got[:6] == ["Medium", "Heavy", "Light", "Heavy", "Light", "Medium"]


def test_parse_clock_time(spark):
    got = _col(spark, ["Landed 8:14 AM", "landed 12:05 am", "12:30 PM", "1:00 pm", "no time", None], C.parse_clock_time, "x string")
    assert got == [8 * 60 + 14, 5, 12 * 60 + 30, 13 * 60, None, None]


def test_clock_delay_wraps_midnight(spark):
    df = spark.createDataFrame([(10, 1430), (1430, 10), (100, 40)], "a int, s int")
    got = [r[0] for r in df.select(C.clock_delay_minutes(F.col("a"), F.col("s"))).collect()]
    assert got == [20.0, -20.0, 60.0]


def test_nearest_slot_tie_goes_earlier(spark):
    df = spark.createDataFrame([("2024-01-01 10:07:30",), ("2024-01-01 10:07:31",), ("2024-01-01 10:00:00",)], "t string")
    got = [str(r[0]) for r in df.select(nearest_slot(F.col("t").cast("timestamp_ntz"))).collect()]
    assert got == ["2024-01-01 10:00:00", "2024-01-01 10:15:00", "2024-01-01 10:00:00"]


def test_list_count(spark):
    got = _col(spark, ["a,b, ,c", "", None, " , "], C.list_count, "x string")
    assert got == [3, 0, 0, 0]


def test_normalize_columns_coalesces_aliases(spark):
    df = spark.createDataFrame([("X1", None, "BOM"), (None, "Y2", "DEL")], "`Flight Number` string, `ID` string, ` To ` string")
    out = C.normalize_columns(df)
    assert out.columns == ["flight_id", "destination"]
    assert [tuple(r) for r in out.collect()] == [("X1", "BOM"), ("Y2", "DEL")]
