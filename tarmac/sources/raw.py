"""A messy, hierarchical schedule sheet derived from ``events`` (FIXTURES §1.5).

Two sheets (``file`` = time-slot name), ``line`` = event id. Every third line pair starts a
flight (serial number + flight number), the lines after it are continuation rows, the first
lines of each sheet have no header above them, some numbers carry non-breaking spaces,
some times end in ``.000``, some rows are entirely empty and arrival is free text
(``Landed 8:14 AM``). Every column is an expression of one event row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import dims
from tarmac.sources.fixture import TYPE_ORDER, _pick, read_events

# FIXED VALUES: sheet names (time slots)
NBSP = "\u00a0"
SHEETS = ["6AM - 9AM", "9AM - 12PM"]


def raw_sheet_from_events(ev: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = F.col("event_id")
    header = (F.floor(e / 2) % 3) == 1
    empty = (F.col("event_type") == "view") & ((k % 10) == 0)
    fn = F.concat(_pick(dims.AIRLINES, F.col("user_id") % 10), (F.col("user_id") + 1000).cast("string"))
    fn = F.when((e % 5) == 0, F.concat(F.lit(NBSP), fn, F.lit(" "))).otherwise(fn)
    ts = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    delay = F.when(F.col("event_type").isin("error", "purchase"), F.floor("value")).otherwise(F.lit(0)).cast("int")
    atd = F.timestamp_add("MINUTE", delay, ts)
    arr = F.timestamp_add("MINUTE", delay + 120, ts)
    std = (
        F.when((k % 10) == 7, F.lit(None))
        .when((k % 3) == 0, F.concat(F.date_format(ts, "HH:mm:ss"), F.lit(".000")))
        .otherwise(F.date_format(ts, "HH:mm"))
    )

    def keep(c):
        return F.when(~empty, c)

    return ev.select(
        _pick(SHEETS, e % 2).alias("file"),
        e.alias("line"),
        keep(F.when(header, e.cast("string"))).alias("s_no"),
        keep(F.when(header, fn)).alias("flight_number"),
        keep(F.when((k % 10) != 3, F.date_format(ts, "yyyy-MM-dd"))).alias("date"),
        keep(F.when((k % 2) == 1, F.lit("Mumbai (BOM)")).otherwise(F.concat(_pick(dims.AIRPORTS, k % 12), F.lit("")))).alias("from"),
        keep(F.when((k % 2) == 1, _pick(dims.AIRPORTS, (k + 1) % 12)).otherwise(F.lit("BOM"))).alias("to"),
        keep(_pick(TYPE_ORDER, F.col("user_id") % 6)).alias("aircraft"),
        keep(F.concat(F.lpad(((k % 4) + 1).cast("string"), 2, "0"), F.lit(":"), F.lpad(((k * 7) % 60).cast("string"), 2, "0"))).alias("flight_time"),
        keep(std).alias("std"),
        keep(F.date_format(atd, "HH:mm")).alias("atd"),
        keep(F.date_format(arr, "HH:mm:ss")).alias("sta"),
        F.lit(None).cast("string").alias("ata_status"),
        keep(F.concat(F.lit("Landed "), F.date_format(arr, "h:mm a"))).alias("ata"),
        _pick(SHEETS, e % 2).alias("time_slot"),
    )


def raw_sheet(spark: SparkSession, sf_dir: str, materialize_table: bool = True) -> DataFrame:
    """The sheet rows as they would arrive in files: derived once per session and stored."""
    if not materialize_table:
        return raw_sheet_from_events(read_events(spark, sf_dir))
    from tarmac.sources.fixture import materialize

    return materialize(spark, "raw_sheet", sf_dir, lambda: raw_sheet_from_events(read_events(spark, sf_dir)), ["file", "line"])


RAW_SHEET_SQL = """
rs0 AS (
  SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k, date_trunc('minute', ts) AS t,
    CAST(CASE WHEN event_type IN ('error', 'purchase') THEN floor(value) ELSE 0 END AS INTEGER) AS dl,
    (event_id // 2) % 3 = 1 AS hdr
  FROM events
),
rs1 AS (
  SELECT *, event_type = 'view' AND k % 10 = 0 AS empty,
    (['AI','6E','UK','SG','G8','QP','I5','9W','VT','IX'])[user_id % 10 + 1] || CAST(user_id + 1000 AS VARCHAR) AS fn0
  FROM rs0
),
raw_sheet AS (
  SELECT (['6AM - 9AM', '9AM - 12PM'])[event_id % 2 + 1] AS file, event_id AS line,
    CASE WHEN NOT empty AND hdr THEN CAST(event_id AS VARCHAR) END AS s_no,
    CASE WHEN NOT empty AND hdr THEN (CASE WHEN event_id % 5 = 0 THEN chr(160) || fn0 || ' ' ELSE fn0 END) END AS flight_number,
    CASE WHEN NOT empty AND k % 10 <> 3 THEN strftime(t, '%Y-%m-%d') END AS date,
    CASE WHEN NOT empty THEN (CASE WHEN k % 2 = 1 THEN 'Mumbai (BOM)'
      ELSE (['BOM','DEL','BLR','MAA','CCU','HYD','AMD','COK','GOI','PNQ','JAI','LKO'])[k % 12 + 1] END) END AS "from",
    CASE WHEN NOT empty THEN (CASE WHEN k % 2 = 1
      THEN (['BOM','DEL','BLR','MAA','CCU','HYD','AMD','COK','GOI','PNQ','JAI','LKO'])[(k + 1) % 12 + 1] ELSE 'BOM' END) END AS "to",
    CASE WHEN NOT empty THEN (['A320','B737','A321','B777','A350','B787'])[user_id % 6 + 1] END AS aircraft,
    CASE WHEN NOT empty THEN lpad(CAST(k % 4 + 1 AS VARCHAR), 2, '0') || ':' || lpad(CAST((k * 7) % 60 AS VARCHAR), 2, '0') END AS flight_time,
    CASE WHEN NOT empty THEN (CASE WHEN k % 10 = 7 THEN NULL WHEN k % 3 = 0 THEN strftime(t, '%H:%M:%S') || '.000'
      ELSE strftime(t, '%H:%M') END) END AS std,
    CASE WHEN NOT empty THEN strftime(t + to_minutes(dl), '%H:%M') END AS atd,
    CASE WHEN NOT empty THEN strftime(t + to_minutes(dl + 120), '%H:%M:%S') END AS sta,
    CAST(NULL AS VARCHAR) AS ata_status,
    CASE WHEN NOT empty THEN 'Landed ' || strftime(t + to_minutes(dl + 120), '%-I:%M %p') END AS ata,
    (['6AM - 9AM', '9AM - 12PM'])[event_id % 2 + 1] AS time_slot
  FROM rs1
)
"""
