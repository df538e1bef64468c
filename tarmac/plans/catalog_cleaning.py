"""Registered cleaning / parsing queries (C*) with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import cleaning as C
from tarmac.plans.oracle import with_flights
from tarmac.plans.registry import register
from tarmac.sources import fixture, raw

RAW = raw.RAW_SHEET_SQL
IS_HDR = "regexp_full_match(replace(s_no, '.', ''), '[0-9]+')"
RUN = "OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
DATA_COLS = ["date", '"from"', '"to"', "aircraft", "flight_time", "std", "atd", "sta", "ata_status", "ata"]


@register("raw_sheet_view", with_flights("SELECT * FROM raw_sheet", RAW))
def _raw(spark, d):
    return raw.raw_sheet(spark, d)


@register("carry_forward_header", with_flights(f"""
SELECT cur_sno AS s_no, cur_fn AS flight_number, file AS sheet_name, file AS time_slot, line, {", ".join(DATA_COLS)} FROM (
  SELECT *, last_value(CASE WHEN {IS_HDR} THEN s_no END IGNORE NULLS) {RUN} AS cur_sno,
    last_value(CASE WHEN {IS_HDR} AND flight_number IS NOT NULL THEN flight_number END IGNORE NULLS) {RUN} AS cur_fn
  FROM raw_sheet)
WHERE ({" OR ".join(c + " IS NOT NULL" for c in DATA_COLS)}) AND (date IS NOT NULL OR "from" IS NOT NULL)
""", RAW))
def _cfh(spark, d):
    return C.carry_forward_header(raw.raw_sheet(spark, d))


@register("clean_messy", with_flights(r"""
, m0 AS (
  SELECT *, coalesce(replace(replace(regexp_replace(flight_number, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g'), chr(160), ''), 'nan', ''), '') AS fn
  FROM raw_sheet
  WHERE coalesce(s_no, flight_number, date, "from", "to", aircraft, flight_time, std, atd, sta, ata_status, ata) IS NOT NULL
),
m1 AS (SELECT * FROM m0 WHERE fn <> '' OR std IS NOT NULL OR "from" IS NOT NULL),
m2 AS (SELECT *, last_value(nullif(fn, '') IGNORE NULLS) OVER (PARTITION BY file ORDER BY line
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fnf FROM m1),
m3 AS (SELECT *, strftime(coalesce(try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%d-%m-%Y')), '%Y-%m-%d') AS day_s,
         trim(replace(std, '.000', '')) AS stdc, trim(replace(sta, '.000', '')) AS stac, trim(replace(atd, '.000', '')) AS atdc
       FROM m2 WHERE fnf IS NOT NULL AND trim(fnf) <> ''),
m4 AS (SELECT *, coalesce(CASE WHEN stdc <> '' AND day_s IS NOT NULL THEN
           coalesce(try_strptime(day_s || ' ' || stdc, '%Y-%m-%d %H:%M:%S'), try_strptime(day_s || ' ' || stdc, '%Y-%m-%d %H:%M')) END,
         TIMESTAMP '2025-07-25 06:00:00') AS scheduled_time FROM m3),
m5 AS (SELECT *,
    coalesce(try_strptime('2025-07-25 ' || stac, '%Y-%m-%d %H:%M:%S'), try_strptime('2025-07-25 ' || stac, '%Y-%m-%d %H:%M'),
             scheduled_time + INTERVAL 2 HOUR) AS scheduled_arrival,
    coalesce(try_strptime(coalesce(day_s, '2025-07-25') || ' ' || atdc, '%Y-%m-%d %H:%M:%S'),
             try_strptime(coalesce(day_s, '2025-07-25') || ' ' || atdc, '%Y-%m-%d %H:%M'), scheduled_time) AS actual_departure
  FROM m4)
SELECT fnf AS flight_id, coalesce(nullif(regexp_extract(fnf, '([A-Z]{1,3})', 1), ''), 'XX') AS airline,
  coalesce("from", 'Unknown') AS origin, coalesce("to", 'Unknown') AS destination, coalesce(aircraft, 'Unknown') AS aircraft_type,
  scheduled_time, scheduled_arrival, actual_departure,
  greatest(coalesce(epoch(actual_departure - scheduled_time) / 60.0, 0.0), 0.0) AS delay_minutes,
  'R1' AS runway, 180 AS capacity, 'Scheduled' AS status, 'TBD' AS gate, day_s AS date, file, line
FROM m5
""", RAW))
def _messy(spark, d):
    return C.clean_messy(raw.raw_sheet(spark, d))


@register("ensure_time_column", with_flights(r"""
SELECT line, coalesce(
    coalesce(try_strptime('2025-07-25 ' || regexp_replace(std, '\.000$|\.0$', ''), '%Y-%m-%d %H:%M:%S'),
             try_strptime('2025-07-25 ' || regexp_replace(std, '\.000$|\.0$', ''), '%Y-%m-%d %H:%M')),
    TIMESTAMP '2025-07-25 09:00:00') AS scheduled_time
FROM raw_sheet
""", RAW))
def _etc(spark, d):
    return C.ensure_time_column(raw.raw_sheet(spark, d)).select("line", "scheduled_time")


@register("sheet_clock_delays", with_flights(r"""
, nb AS (
  SELECT *,
    regexp_extract(ata, '(\d{1,2}):(\d{2})\s*(AM|PM|am|pm|Am|Pm|aM|pM)', 1) AS h,
    regexp_extract(ata, '(\d{1,2}):(\d{2})\s*(AM|PM|am|pm|Am|Pm|aM|pM)', 2) AS mi,
    upper(regexp_extract(ata, '(\d{1,2}):(\d{2})\s*(AM|PM|am|pm|Am|Pm|aM|pM)', 3)) AS p
  FROM raw_sheet
  WHERE "from" IS NOT NULL AND "to" IS NOT NULL AND std IS NOT NULL AND sta IS NOT NULL AND regexp_matches("from", '(?i)Mumbai|BOM')
),
nb2 AS (
  SELECT *, CASE WHEN h <> '' THEN (CASE WHEN p = 'PM' AND CAST(h AS INT) <> 12 THEN CAST(h AS INT) + 12
      WHEN p = 'AM' AND CAST(h AS INT) = 12 THEN 0 ELSE CAST(h AS INT) END) * 60 + CAST(mi AS INT) END AS ata_min,
    CAST(regexp_extract(std, '^\s*(\d{1,2}):(\d{2})', 1) AS INT) * 60 + CAST(regexp_extract(std, '^\s*(\d{1,2}):(\d{2})', 2) AS INT) AS std_min,
    CAST(regexp_extract(sta, '^\s*(\d{1,2}):(\d{2})', 1) AS INT) * 60 + CAST(regexp_extract(sta, '^\s*(\d{1,2}):(\d{2})', 2) AS INT) AS sta_min,
    CAST(regexp_extract(atd, '^\s*(\d{1,2}):(\d{2})', 1) AS INT) * 60 + CAST(regexp_extract(atd, '^\s*(\d{1,2}):(\d{2})', 2) AS INT) AS atd_min
  FROM nb
)
SELECT line, ata_min, std_min,
  round_even(CASE WHEN atd_min - std_min < -720 THEN atd_min - std_min + 1440 WHEN atd_min - std_min > 720
    THEN atd_min - std_min - 1440 ELSE atd_min - std_min END, 2)::DOUBLE AS departure_delay,
  round_even(CASE WHEN ata_min - sta_min < -720 THEN ata_min - sta_min + 1440 WHEN ata_min - sta_min > 720
    THEN ata_min - sta_min - 1440 ELSE ata_min - sta_min END, 2)::DOUBLE AS arrival_delay,
  "from" || ' → ' || "to" AS route,
  CASE WHEN std_min // 60 < 9 THEN '6AM - 9AM' ELSE '9AM - 12PM' END AS time_slot_label,
  CASE WHEN std_min // 60 = 7 THEN 'Super Peak' WHEN std_min // 60 >= 6 AND std_min // 60 < 9 THEN 'Peak'
    WHEN std_min // 60 >= 9 AND std_min // 60 < 11 THEN 'Moderate' ELSE 'Low' END AS peak_classification,
  (std_min // 60) || CASE WHEN std_min < 720 THEN 'AM-' ELSE 'PM-' END || (std_min // 60 + 1) || CASE WHEN std_min < 720 THEN 'AM' ELSE 'PM' END AS std_hour_slot,
  (atd_min // 60) || CASE WHEN atd_min < 720 THEN 'AM-' ELSE 'PM-' END || (atd_min // 60 + 1) || CASE WHEN atd_min < 720 THEN 'AM' ELSE 'PM' END AS atd_hour_slot,
  CASE WHEN std_min < 540 THEN '6AM - 9AM' ELSE '9AM - 12PM' END AS sheet_source
FROM nb2
""", RAW))
def _nb(spark, d):
    df = C.origin_filter(raw.raw_sheet(spark, d))
    std_min, sta_min, atd_min = C.clock_minutes(F.col("std")), C.clock_minutes(F.col("sta")), C.clock_minutes(F.col("atd"))
    ata_min = C.parse_clock_time(F.col("ata"))
    df = df.withColumns({"ata_min": ata_min, "std_min": std_min, "sta_min": sta_min, "atd_min": atd_min})
    df = C.schedule_labels(df, F.col("std_min"), F.col("atd_min"))
    return df.select(
        "line", "ata_min", "std_min",
        C.clock_delay_minutes(F.col("atd_min"), F.col("std_min")).alias("departure_delay"),
        C.clock_delay_minutes(F.col("ata_min"), F.col("sta_min")).alias("arrival_delay"),
        "route", "time_slot_label", "peak_classification", "std_hour_slot", "atd_hour_slot", "sheet_source",
    )


@register("normalize_columns", with_flights("""
SELECT coalesce(flight_number, s_no) AS flight_id, std AS scheduled_time, "to" AS destination, aircraft AS aircraft_type,
  "from" AS "from", line AS line_no
FROM raw_sheet
""", RAW))
def _norm(spark, d):
    messy = raw.raw_sheet(spark, d).select(
        F.col("flight_number").alias("Flight Number"), F.col("s_no").alias("ID"), F.col("std").alias(" STD "),
        F.col("to").alias("To"), F.col("aircraft").alias("Aircraft"), F.col("from").alias("FROM"), F.col("line").alias("Line-No"),
    )
    return C.normalize_columns(messy)


@register("derive_flight_id", with_flights("""
SELECT line, coalesce(flight_number, 'FL' || lpad(pos, CAST(greatest(4, length(pos)) AS INTEGER), '0')) AS flight_id
FROM (SELECT line, flight_number, CAST(row_number() OVER (PARTITION BY file ORDER BY line) - 1 AS VARCHAR) AS pos FROM raw_sheet)
""", RAW))
def _dfi(spark, d):
    return C.derive_flight_id(raw.raw_sheet(spark, d), ["flight_number"], "line").select("line", "flight_id")


_RAW_COLS = ["file", "line", "s_no", "flight_number", "date", "from", "to", "aircraft", "flight_time", "std", "atd", "sta",
             "ata_status", "ata", "time_slot"]
_NULLS = ", ".join(f'count(*) FILTER (WHERE "{c}" IS NULL) AS m_{i}' for i, c in enumerate(_RAW_COLS))
_HEADERS = ", ".join(f"('{c}')" for c in _RAW_COLS)
_TOTAL = " + ".join(f"m_{i}" for i in range(len(_RAW_COLS)))


@register("completeness_profile", with_flights(f"""
, t AS (SELECT count(*) AS n, {_NULLS} FROM raw_sheet)
""" + " UNION ALL ".join(
    f"""SELECT n AS total_rows, ({_TOTAL}) * 100.0 / (n * {len(_RAW_COLS)}) AS missing_pct_total, {len(_RAW_COLS)} AS total_columns,
    (SELECT CAST(count(*) AS INTEGER) FROM (VALUES {_HEADERS}) h(c) WHERE c IN ('flight_number', 'to', 'std', 'aircraft', 'id', 'airline',
      'destination', 'scheduled_time', 'aircraft_type', 'runway', 'delay_minutes', 'flight_id')) AS mapped_columns, '{c}' AS "column", m_{i} AS null_count, m_{i} * 100.0 / n AS null_pct FROM t"""
    for i, c in enumerate(_RAW_COLS)), RAW))
def _cp(spark, d):
    return C.completeness_profile(raw.raw_sheet(spark, d))


@register("clean_standard", with_flights("""
SELECT *, flight_id AS flight_number FROM flights WHERE flight_id IS NOT NULL AND scheduled_time IS NOT NULL
"""))
def _cs(spark, d):
    return C.clean_standard(fixture.flights(spark, d))


@register("filter_flights", with_flights("""
SELECT * FROM flights WHERE date = DATE '2024-01-15' AND airline = 'AI' AND runway = '09R/27L'
"""))
def _ff(spark, d):
    return C.filter_flights(fixture.flights(spark, d), date="2024-01-15", airline="AI", runway="09R/27L")


@register("flight_attributes", with_flights(r"""
SELECT flight_id,
  coalesce(nullif(regexp_extract(flight_id, '^([A-Z0-9]{2,3})', 1), ''), 'AA') AS id_airline,
  CASE WHEN hour BETWEEN 6 AND 10 OR hour BETWEEN 18 AND 22 THEN 'high' WHEN hour BETWEEN 11 AND 17 THEN 'medium' ELSE 'low' END AS peak_band,
  CAST(dayofyear(scheduled_time) AS INTEGER) AS day_of_year, CAST(month(scheduled_time) AS INTEGER) AS month,
  dayname(scheduled_time) AS day_name,
  CASE aircraft_type WHEN 'A320' THEN 'Medium' WHEN 'A321' THEN 'Medium' WHEN 'A330' THEN 'Heavy' WHEN 'A350' THEN 'Heavy'
    WHEN 'B737' THEN 'Medium' WHEN 'B777' THEN 'Heavy' WHEN 'B787' THEN 'Heavy' WHEN 'ATR72' THEN 'Light' WHEN 'Q400' THEN 'Light'
    ELSE 'Medium' END AS aircraft_category,
  CASE WHEN is_emergency THEN 1 WHEN is_international THEN 2 WHEN capacity >= 150 THEN 3 WHEN capacity >= 50 THEN 4 ELSE 5 END AS priority,
  CAST(len(list_filter(string_split(aircraft_id || ',' || runway || ', ,', ','), lambda x: trim(x) <> '')) AS INTEGER) AS list_items,
  regexp_replace(runway, '\W+', '_', 'g') AS runway_safe
FROM flights
"""))
def _fa(spark, d):
    fl = C.derive_time_columns(fixture.flights(spark, d))
    return fl.select(
        "flight_id",
        C.airline_from_id(F.col("flight_id")).alias("id_airline"),
        C.peak_band_3(F.col("hour")).alias("peak_band"),
        "day_of_year", "month", "day_name",
        C.aircraft_category(F.col("aircraft_type")).alias("aircraft_category"),
        C.flight_priority(F.col("is_emergency"), F.col("is_international"), F.col("capacity")).alias("priority"),
        C.list_count(F.concat_ws(",", "aircraft_id", "runway", F.lit(" ,"))).alias("list_items"),
        F.regexp_replace("runway", r"\W+", "_").alias("runway_safe"),
    )


@register("standardize_defaults", with_flights("""
SELECT flight_number AS flight_id, std AS scheduled_time, "from" AS origin, "to" AS destination, aircraft AS aircraft_type,
  atd AS actual_departure, sta AS scheduled_arrival, ata AS actual_arrival, date, line,
  0.0::DOUBLE AS delay_minutes, 'R1' AS runway, 180 AS capacity
FROM raw_sheet
""", RAW))
def _sd(spark, d):
    r = raw.raw_sheet(spark, d).select(
        F.col("flight_number").alias("Flight_Number"), F.col("std").alias("STD"), F.col("from").alias("From"),
        F.col("to").alias("To"), F.col("aircraft").alias("Aircraft"), F.col("atd").alias("ATD"), F.col("sta").alias("STA"),
        F.col("ata").alias("ATA"), F.col("date").alias("Date"), "line",
    )
    return C.standardize_defaults(r)


@register("csv_sheets_roundtrip", with_flights("""
SELECT s_no, flight_number, date, "from", "to", aircraft, flight_time, std, atd, sta, ata_status, ata, line, file, time_slot
FROM raw_sheet
""", RAW))
def _csv_rt(spark, d):
    """The sheet view written as one CSV directory per sheet, read back as a union."""
    import uuid

    from tarmac.session import checkpoint_dir
    from tarmac.sources import files

    base = f"{checkpoint_dir(spark).rstrip('/')}/sheets-{uuid.uuid4().hex}"
    sheet = raw.raw_sheet(spark, d)
    dirs = []
    for name in raw.SHEETS:
        p = f"{base}/{name}"
        cols = ["s_no", "flight_number", "date", "from", "to", "aircraft", "flight_time", "std", "atd", "sta", "ata_status",
                "ata", "line"]
        sheet.filter(F.col("file") == name).select(*[F.col(f"`{c}`") for c in cols]).write.option("header", True) \
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(p)
        dirs.append(p)
    return files.union_sheets(spark, dirs)


@register("parquet_schedule_roundtrip", with_flights("""
SELECT flight_id, airline, runway, delay_minutes, date FROM flights WHERE date = DATE '2024-01-15'
"""))
def _pq_rt(spark, d):
    """Results written partitioned by date, read back from the first existing candidate
    path; the date filter prunes to one partition directory."""
    import uuid

    from tarmac.session import checkpoint_dir
    from tarmac.sources import files

    base = f"{checkpoint_dir(spark).rstrip('/')}/schedule-{uuid.uuid4().hex}"
    files.write_schedule(fixture.flights(spark, d).select("flight_id", "airline", "runway", "delay_minutes", "date"), base)
    df = files.read_schedule(spark, [f"{base}-missing", base], fmt="parquet")
    return df.filter(F.col("date") == F.lit("2024-01-15").cast("date")).select("flight_id", "airline", "runway", "delay_minutes", "date")


@register("derive_scheduled_time", with_flights("""
SELECT line, coalesce(try_strptime(date || ' ' || replace(std, '.000', ''), '%Y-%m-%d %H:%M:%S'),
                      try_strptime(date || ' ' || replace(std, '.000', ''), '%Y-%m-%d %H:%M'),
                      TIMESTAMP '2025-07-25 06:00:00' + to_minutes(CAST(30 * (row_number() OVER (PARTITION BY file ORDER BY line) - 1) AS BIGINT)))
  AS scheduled_time
FROM raw_sheet
""", RAW))
def _dst(spark, d):
    cand = F.concat_ws(" ", F.col("date"), F.replace(F.col("std"), F.lit(".000"), F.lit("")))
    cand = F.when(F.col("date").isNotNull() & F.col("std").isNotNull(), cand)
    return C.derive_scheduled_time(raw.raw_sheet(spark, d), [cand]).select("line", "scheduled_time")


@register("sanitize_strings", with_flights(r"""
SELECT flight_id, regexp_replace(runway, '\W+', '_', 'g') AS runway, regexp_replace(aircraft_type, '\W+', '_', 'g') AS aircraft_type,
  regexp_replace(airline, '\W+', '_', 'g') AS airline, CAST(capacity AS DOUBLE) AS capacity FROM flights
"""))
def _ss(spark, d):
    out = C.sanitize_strings(fixture.flights(spark, d), ["runway", "aircraft_type", "airline"])
    return out.select("flight_id", "runway", "aircraft_type", "airline", "capacity")


@register("coerce_types", with_flights("""
SELECT line, coalesce(TRY_CAST(s_no AS DOUBLE), 0.0) AS s_no_num, TRY_CAST(flight_time AS DOUBLE) AS flight_time_num,
  coalesce(try_strptime(date, '%Y-%m-%d %H:%M:%S'), try_strptime(date, '%Y-%m-%d %H:%M'), try_strptime(date, '%Y-%m-%d')) AS date_ts
FROM raw_sheet
""", RAW))
def _coerce(spark, d):
    """to_numeric / to_datetime with coercion (unparsable -> null, numeric null -> default)."""
    r = raw.raw_sheet(spark, d)
    return r.select("line", C.coerce_number(F.col("s_no"), 0.0).alias("s_no_num"),
                    C.coerce_number(F.col("flight_time"), None).alias("flight_time_num"),
                    C.parse_timestamp(F.col("date")).alias("date_ts"))
