"""Cleaning, normalisation and row-local derivations.

All row-local work is ``Column`` expressions (one narrow projection, whole-stage codegen).
The two forward fills (C11, C12) use the bucketed fill of ``tarmac.functions.windows`` so a
single huge sheet never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import dims
from tarmac.functions.windows import forward_fill, row_index

BASE_DATE = "2025-07-25"
LINE_BUCKET = 1 << 16  # lines per fill bucket

# FIXED VALUES: header aliases -> canonical column (first table)
COLUMN_ALIASES = {
    "flight_id": "flight_id", "flightid": "flight_id", "flight_number": "flight_id", "flightnumber": "flight_id",
    "flight_no": "flight_id", "flightno": "flight_id", "flight": "flight_id", "id": "flight_id", "flight_code": "flight_id",
    "airline": "airline", "carrier": "airline", "airline_code": "airline", "operator": "airline", "company": "airline",
    "scheduled_time": "scheduled_time", "scheduledtime": "scheduled_time", "departure_time": "scheduled_time",
    "departuretime": "scheduled_time", "std": "scheduled_time", "scheduled_departure": "scheduled_time",
    "dep_time": "scheduled_time", "time": "scheduled_time", "scheduled": "scheduled_time",
    "destination": "destination", "dest": "destination", "arrival_airport": "destination", "to": "destination",
    "airport": "destination", "destination_code": "destination",
    "aircraft_type": "aircraft_type", "aircrafttype": "aircraft_type", "aircraft": "aircraft_type",
    "plane_type": "aircraft_type", "equipment": "aircraft_type", "ac_type": "aircraft_type",
    "runway": "runway", "rwy": "runway", "runway_id": "runway",
    "delay_minutes": "delay_minutes", "delayminutes": "delay_minutes", "delay": "delay_minutes",
    "delay_mins": "delay_minutes", "actual_delay": "delay_minutes",
}


def normalize_header(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


# C1
def normalize_columns(df: DataFrame, aliases: dict[str, str] = COLUMN_ALIASES) -> DataFrame:
    """Lower/strip/underscore headers, rename aliases; two headers mapping to one name are
    coalesced in header order. Unmapped columns keep their normalised name."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        n = normalize_header(c)
        groups.setdefault(aliases.get(n, n), []).append(c)
    cols = []
    for target, srcs in groups.items():
        expr = F.col(f"`{srcs[0]}`") if len(srcs) == 1 else F.coalesce(*[F.col(f"`{s}`") for s in srcs])
        cols.append(expr.alias(target))
    return df.select(*cols)


# C2
def derive_flight_id(df: DataFrame, candidates: list[str], order: str = "line", file_col: str = "file") -> DataFrame:
    """First candidate column, else 'FL' + position within the file, padded to at least 4 digits, (by ``order``)."""
    existing = [c for c in candidates if c in df.columns]
    df = row_index(df, [file_col], [order], _bucket(order), "_pos")
    digits = F.col("_pos").cast("string")
    synthetic = F.concat(F.lit("FL"), F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), "0"))
    value = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in existing], synthetic) if existing else synthetic
    return df.withColumn("flight_id", value).drop("_pos")


# C3
def airline_from_id(flight_id: Column, messy: bool = False) -> Column:
    if messy:
        code = F.regexp_extract(flight_id, r"([A-Z]{1,3})", 1)
        return F.coalesce(F.nullif(code, F.lit("")), F.lit("XX"))
    code = F.regexp_extract(flight_id, r"^([A-Z0-9]{2,3})", 1)
    return F.coalesce(F.nullif(code, F.lit("")), F.lit("AA"))


# C4 / C8
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd"]


def parse_timestamp(c: Column) -> Column:
    """``to_datetime(errors='coerce')`` for the formats a schedule sheet uses: null when unparsable."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in TIME_FORMATS]).cast("timestamp_ntz")


def coerce_number(c: Column, default: float | None = 0.0) -> Column:
    x = c.try_cast("double")
    return F.coalesce(x, F.lit(default)) if default is not None else x


def derive_scheduled_time(df: DataFrame, candidates: list[Column], base_time: str = "2025-07-25 06:00:00",
                          file_col: str = "file", order: str = "line") -> DataFrame:
    """C4: first candidate that parses; otherwise base + 30 min x the row's position in its file."""
    df = row_index(df, [file_col], [order], _bucket(order), "_pos")
    grid = F.timestamp_add("MINUTE", F.col("_pos") * 30, F.lit(base_time).cast("timestamp_ntz"))
    return df.withColumn("scheduled_time", F.coalesce(*[parse_timestamp(c) for c in candidates], grid)).drop("_pos")


# C5
def derive_time_columns(df: DataFrame, ts: str = "scheduled_time") -> DataFrame:
    t = F.col(ts)
    return df.withColumns({
        "hour": F.hour(t),
        "day_of_week": F.weekday(t),
        "date": F.to_date(t),
        "day_name": F.date_format(t, "EEEE"),
        "month": F.month(t),
        "day_of_year": F.dayofyear(t),
    })


# C6
def peak_band_3(hour: Column) -> Column:
    return (
        F.when(hour.between(6, 10) | hour.between(18, 22), "high")
        .when(hour.between(11, 17), "medium")
        .otherwise("low")
    )


# C7
def actual_time(sched: Column, delay: Column) -> Column:
    return F.timestamp_add("MINUTE", delay.cast("int"), sched)


# C9
def mapped_headers(headers: list[str], aliases: dict[str, str] = COLUMN_ALIASES) -> int:
    """How many of a sheet's headers ``normalize_columns`` gives a name of the alias table."""
    return sum(normalize_header(h) in aliases for h in headers)


def completeness_profile(df: DataFrame, headers: list[str] | None = None) -> DataFrame:
    """Per-column null count/% plus table totals, from ONE aggregate pass, then unpivoted. ``headers`` are those of
    the sheet before normalising (default: the table's own); ``mapped_columns`` counts the ones with an alias."""
    cols = df.columns
    mapped_columns = mapped_headers(cols if headers is None else headers)
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_m{i}") for i, c in enumerate(cols)])
    total_nulls = sum((F.col(f"_m{i}") for i in range(len(cols))), F.lit(0))
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_m{i}").alias("null_count")) for i, c in enumerate(cols)])
    out = one.select(
        "_n",
        (total_nulls * 100.0 / (F.col("_n") * len(cols))).alias("missing_pct_total"),
        F.inline(rows),
    )
    return out.select(
        F.col("_n").alias("total_rows"), "missing_pct_total", F.lit(len(cols)).alias("total_columns"),
        F.lit(mapped_columns).alias("mapped_columns"), "column", "null_count",
        (F.col("null_count") * 100.0 / F.col("_n")).alias("null_pct"),
    )


# C10
def clean_standard(df: DataFrame) -> DataFrame:
    """Drop all-null rows, rows without id or time; origin default BOM; delay from actual - scheduled."""
    df = df.dropna(how="all").dropna(subset=["flight_id", "scheduled_time"])
    out = df.withColumn("flight_number", F.col("flight_id"))
    if "origin" not in out.columns:
        out = out.withColumn("origin", F.lit("BOM"))
    out = out.withColumn("origin", F.coalesce(F.col("origin"), F.lit("BOM")))
    if "actual_time" in out.columns:
        derived = F.timestamp_diff("SECOND", F.col("scheduled_time"), F.col("actual_time")) / 60.0
        base = F.col("delay_minutes") if "delay_minutes" in out.columns else F.lit(None).cast("double")
        out = out.withColumn("delay_minutes", F.coalesce(base, derived))
    return out


def _strip_ws(c: Column) -> Column:
    """Python ``str.strip()`` (Unicode whitespace incl. no-break space)."""
    return F.regexp_replace(c, "^[\\s\u00a0]+|[\\s\u00a0]+$", "")


def _bucket(line: str = "line") -> Column:
    return F.floor(F.col(line) / LINE_BUCKET)


# C12
def carry_forward_header(raw: DataFrame) -> DataFrame:
    """Hierarchical sheet: a numeric S.No row starts a flight; later rows inherit S.No and number."""
    is_header = F.regexp_replace(F.col("s_no").cast("string"), r"\.", "").rlike(r"^[0-9]+$")
    filled = forward_fill(
        raw,
        ["file"],
        "line",
        {
            "cur_sno": F.when(is_header, F.col("s_no")),
            "cur_fn": F.when(is_header & F.col("flight_number").isNotNull(), F.col("flight_number")),
        },
        _bucket(),
    )
    data_cols = ["date", "from", "to", "aircraft", "flight_time", "std", "atd", "sta", "ata_status", "ata"]
    has_data = F.lit(False)
    for c in data_cols:
        has_data = has_data | F.col(f"`{c}`").isNotNull()
    keep = has_data & (F.col("date").isNotNull() | F.col("from").isNotNull())
    return filled.filter(keep).select(
        F.col("cur_sno").alias("s_no"), F.col("cur_fn").alias("flight_number"), F.col("file").alias("sheet_name"),
        F.col("file").alias("time_slot"), "line", *[F.col(f"`{c}`") for c in data_cols],
    )


# C11
def clean_messy(raw: DataFrame) -> DataFrame:
    """Messy-sheet cleaning: strip no-break spaces, keep rows with id/std/from, forward-fill the
    flight number within a sheet, combine date + std, defaults. The actual departure is placed
    on the row's own date (the reference puts it on a fixed base date)."""
    fn = F.regexp_replace(F.regexp_replace(_strip_ws(F.col("flight_number").cast("string")), "\u00a0", ""), "nan", "")
    df = raw.dropna(how="all", subset=[c for c in raw.columns if c not in ("file", "line", "time_slot")])
    df = df.withColumn("_fn", F.coalesce(fn, F.lit("")))
    df = df.filter((F.col("_fn") != "") | F.col("std").isNotNull() | F.col("from").isNotNull())
    df = forward_fill(df, ["file"], "line", {"_fnf": F.nullif(F.col("_fn"), F.lit(""))}, _bucket())
    df = df.filter(F.col("_fnf").isNotNull() & (F.trim(F.col("_fnf")) != ""))

    def clean_time(c: str) -> Column:
        return F.trim(F.replace(F.col(c).cast("string"), F.lit(".000"), F.lit("")))

    day = F.coalesce(F.try_to_date(F.col("date"), "yyyy-MM-dd"), F.try_to_date(F.col("date"), "dd-MM-yyyy"))
    day_s = F.date_format(day, "yyyy-MM-dd")
    std = clean_time("std")
    sched = F.when((std != "") & day.isNotNull(), parse_timestamp(F.concat_ws(" ", day_s, std)))
    sched = F.coalesce(sched, F.lit(f"{BASE_DATE} 06:00:00").cast("timestamp_ntz"))
    df = df.withColumn("scheduled_time", sched)
    sta = parse_timestamp(F.concat(F.lit(BASE_DATE + " "), clean_time("sta")))
    atd = parse_timestamp(F.concat_ws(" ", F.coalesce(day_s, F.lit(BASE_DATE)), clean_time("atd")))
    df = df.withColumns({
        "scheduled_arrival": F.coalesce(sta, F.timestamp_add("HOUR", F.lit(2), F.col("scheduled_time"))),
        "actual_departure": F.coalesce(atd, F.col("scheduled_time")),
    })
    delay = F.timestamp_diff("SECOND", F.col("scheduled_time"), F.col("actual_departure")) / 60.0
    return df.select(
        F.col("_fnf").alias("flight_id"),
        airline_from_id(F.col("_fnf"), messy=True).alias("airline"),
        F.coalesce(F.col("from"), F.lit("Unknown")).alias("origin"),
        F.coalesce(F.col("to"), F.lit("Unknown")).alias("destination"),
        F.coalesce(F.col("aircraft"), F.lit("Unknown")).alias("aircraft_type"),
        "scheduled_time", "scheduled_arrival", "actual_departure",
        F.greatest(F.coalesce(delay, F.lit(0.0)), F.lit(0.0)).alias("delay_minutes"),
        F.lit("R1").alias("runway"), F.lit(180).alias("capacity"), F.lit("Scheduled").alias("status"),
        F.lit("TBD").alias("gate"), day_s.alias("date"), "file", "line",
    )


# C13
def ensure_time_column(df: DataFrame) -> DataFrame:
    std = F.regexp_replace(F.col("std").cast("string"), r"\.000$|\.0$", "")
    t = parse_timestamp(F.concat(F.lit(BASE_DATE + " "), std))
    return df.withColumn("scheduled_time", F.coalesce(t, F.lit(f"{BASE_DATE} 09:00:00").cast("timestamp_ntz")))


# C14 (second alias table; random fills replaced by constants)
STANDARD_ALIASES = {
    "flight_number": "flight_id", "flight_no": "flight_id", "std": "scheduled_time", "from": "origin",
    "to": "destination", "aircraft": "aircraft_type", "atd": "actual_departure", "sta": "scheduled_arrival",
    "ata": "actual_arrival", "date": "date", "delay": "delay_minutes",
}


def standardize_defaults(df: DataFrame) -> DataFrame:
    out = normalize_columns(df, STANDARD_ALIASES)
    defaults = {"delay_minutes": F.lit(0.0), "runway": F.lit("R1"), "capacity": F.lit(180)}
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), v) if c in out.columns else v)
    return out


# C15
def filter_flights(df: DataFrame, date=None, airline="All", runway="All", origin="All", destination="All", slot="All") -> DataFrame:
    """Conjunctive equality filters; 'All' is a no-op. Pushed to the scan by Catalyst."""
    out = df
    if date is not None:
        out = out.filter(F.col("date") == F.lit(date).cast("date"))
    for col, val in (("airline", airline), ("runway", runway), ("origin", origin), ("destination", destination), ("time_slot", slot)):
        if val not in (None, "All") and col in out.columns:
            out = out.filter(F.col(col) == val)
    return out


# C16
def origin_filter(df: DataFrame, pattern: str = "Mumbai|BOM") -> DataFrame:
    return df.dropna(subset=["from", "to", "std", "sta"]).filter(F.col("from").rlike(f"(?i){pattern}"))


# C17
def parse_clock_time(text: Column) -> Column:
    """Minute of day from '8:14 AM' style text; null when there is no such time."""
    rx = r"(?i)(\d{1,2}):(\d{2})\s*(AM|PM)"
    h = F.regexp_extract(text, rx, 1)
    m = F.regexp_extract(text, rx, 2)
    p = F.upper(F.regexp_extract(text, rx, 3))
    hour = h.try_cast("int")
    hour24 = F.when((p == "PM") & (hour != 12), hour + 12).when((p == "AM") & (hour == 12), F.lit(0)).otherwise(hour)
    return F.when(h != "", hour24 * 60 + m.try_cast("int"))


def clock_minutes(text: Column) -> Column:
    """Minute of day of 'HH:MM[:SS]' text."""
    rx = r"^\s*(\d{1,2}):(\d{2})"
    h = F.regexp_extract(text, rx, 1)
    return F.when(h != "", h.try_cast("int") * 60 + F.regexp_extract(text, rx, 2).try_cast("int"))


# C18
def clock_delay_minutes(actual_min: Column, sched_min: Column) -> Column:
    diff = (actual_min - sched_min).cast("double")
    return F.bround(F.when(diff < -720, diff + 1440).when(diff > 720, diff - 1440).otherwise(diff), 2)


# C19
def schedule_labels(df: DataFrame, std_min: Column, atd_min: Column) -> DataFrame:
    def hour_slot(m: Column) -> Column:
        h = F.floor(m / 60).cast("int")
        return F.when(h < 12, F.concat(h.cast("string"), F.lit("AM-"), (h + 1).cast("string"), F.lit("AM"))).otherwise(
            F.concat(h.cast("string"), F.lit("PM-"), (h + 1).cast("string"), F.lit("PM"))
        )

    h = F.floor(std_min / 60)
    return df.withColumns({
        "route": F.concat_ws(" → ", F.col("from"), F.col("to")),
        "time_slot_label": F.when(h < 9, "6AM - 9AM").otherwise("9AM - 12PM"),
        "peak_classification": F.when(h == 7, "Super Peak").when((h >= 6) & (h < 9), "Peak")
        .when((h >= 9) & (h < 11), "Moderate").otherwise("Low"),
        "std_hour_slot": hour_slot(std_min),
        "atd_hour_slot": hour_slot(atd_min),
    }).withColumn("sheet_source", F.col("time_slot_label"))  # a generated schedule names its sheets by the slot


# C20
def sanitize_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    out = df.withColumns({c: F.regexp_replace(F.col(c).cast("string"), r"\W+", "_") for c in cols})
    if "aircraft_id" not in out.columns:
        out = out.withColumn("aircraft_id", F.col("aircraft_type"))
    return out.withColumns({
        "capacity": F.coalesce(F.col("capacity").try_cast("double"), F.lit(150.0)) if "capacity" in out.columns else F.lit(150.0),
        "runway": F.coalesce(F.col("runway"), F.lit("R1")) if "runway" in out.columns else F.lit("R1"),
    })


# C21 -- FIXED VALUES: aircraft model -> (category, minimum runway length, preferred runways)
AIRCRAFT = {
    "A320": ("Medium", 2400, ["09R/27L", "09L/27R", "14/32"]),
    "A321": ("Medium", 2500, ["09R/27L", "09L/27R", "14/32"]),
    "A330": ("Heavy", 2500, ["09R/27L", "09L/27R"]),
    "A350": ("Heavy", 2600, ["09R/27L", "09L/27R"]),
    "B737": ("Medium", 2100, ["09R/27L", "09L/27R", "14/32", "27/09"]),
    "B777": ("Heavy", 2600, ["09R/27L", "09L/27R"]),
    "B787": ("Heavy", 2600, ["09R/27L", "09L/27R"]),
    "ATR72": ("Light", 1200, ["14/32", "27/09"]),
    "Q400": ("Light", 1425, ["14/32", "27/09"]),
}
HEAVY_MARKERS = ["777", "787", "330", "350", "747", "380"]
LIGHT_MARKERS = ["ATR", "Q400", "CRJ", "ERJ"]


def aircraft_category(model: Column) -> Column:
    """Known model -> its category; otherwise substring rules (heavy markers, light markers, else Medium)."""
    known = dims.lit_map({m: v[0] for m, v in AIRCRAFT.items()})[model]
    up = F.upper(model)
    heavy = F.lit(False)
    for m in HEAVY_MARKERS:
        heavy = heavy | up.contains(m)
    light = F.lit(False)
    for m in LIGHT_MARKERS:
        light = light | up.contains(m)
    return F.coalesce(known, F.when(heavy, "Heavy").when(light, "Light").otherwise("Medium"))


# C22
def flight_priority(emergency: Column, international: Column, capacity: Column) -> Column:
    return (
        F.when(F.coalesce(emergency, F.lit(False)), 1)
        .when(F.coalesce(international, F.lit(False)), 2)
        .when(capacity >= 150, 3)
        .when(capacity >= 50, 4)
        .otherwise(5)
    )


# C23
def list_count(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.split(c, ","), lambda x: F.trim(x) != "")))

