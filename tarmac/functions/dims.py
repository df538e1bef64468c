"""Dimension tables kept as code.

Everything under "FIXED VALUES" must equal the reference's numbers for results to agree;
they are listed plainly, in their natural order.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reference)
# ---------------------------------------------------------------------------

AIRLINES = ["AI", "6E", "UK", "SG", "G8", "QP", "I5", "9W", "VT", "IX"]

# destination code -> (congestion factor, priority)
DESTINATIONS = {
    "BOM": (1.8, "high"),
    "DEL": (1.9, "high"),
    "BLR": (1.6, "high"),
    "MAA": (1.4, "medium"),
    "CCU": (1.3, "medium"),
    "HYD": (1.5, "medium"),
    "AMD": (1.1, "normal"),
    "COK": (1.2, "normal"),
    "GOI": (0.9, "normal"),
    "PNQ": (1.3, "medium"),
    "JAI": (1.0, "normal"),
    "LKO": (1.1, "normal"),
}
AIRPORTS = list(DESTINATIONS)

# runway -> (hourly capacity, efficiency)
RUNWAYS = {
    "09R/27L": (35, 0.85),
    "09L/27R": (32, 0.90),
    "14/32": (28, 0.80),
}

# aircraft type -> (seats, turnaround minutes)
AIRCRAFT_TYPES = {
    "A320": (180, 45),
    "B737": (160, 40),
    "A321": (220, 50),
    "B777": (300, 90),
    "A350": (280, 85),
    "B787": (250, 80),
}

PEAK_HOURS = {
    "super_peak": [7, 8, 9, 19, 20, 21],
    "peak": [6, 10, 18, 22],
    "moderate": [5, 11, 12, 13, 14, 17, 23],
    "low": [0, 1, 2, 3, 4, 15, 16],
}
IS_PEAK_HOURS = [6, 7, 8, 9, 18, 19, 20, 21]
MAJOR_DESTINATIONS = ["BOM", "DEL", "BLR", "MAA", "CCU", "HYD"]
LARGE_AIRCRAFT = ["B777", "A350", "B787"]

# weather condition -> (visibility km, wind kts, precipitation mm, capacity factor,
#                       landing restriction, takeoff restriction, crosswind closure, delay minutes)
WEATHER = {
    "Clear": (10.0, 5, 0.0, 1.0, False, False, False, 0),
    "Light Rain": (8.0, 8, 2.5, 0.9, False, False, False, 2),
    "Moderate Rain": (5.0, 12, 7.5, 0.75, True, False, False, 8),
    "Heavy Rain": (2.0, 15, 15.0, 0.6, True, True, True, 15),
    "Fog": (0.8, 3, 0.0, 0.5, True, True, False, 20),
    "Thunderstorm": (3.0, 25, 20.0, 0.3, True, True, True, 30),
    "Strong Winds": (10.0, 30, 0.0, 0.7, True, False, True, 10),
    "Snow": (1.5, 10, 8.0, 0.4, True, True, True, 25),
}
WEATHER_CONDITIONS = list(WEATHER)

# runway -> weather sensitivity (wind, rain, fog, length advantage); other runways 1.0
RUNWAY_WEATHER_SENSITIVITY = {
    "09R/27L": (0.8, 0.9, 1.0, 1.1),
    "09L/27R": (0.8, 0.9, 1.0, 1.1),
    "14/32": (1.3, 1.2, 1.1, 0.9),
}

# hour -> (demand multiplier, revenue multiplier, willingness to pay, business ratio); default hour 12
REVENUE_SLOTS = {
    5: (0.8, 1.3, 1.2, 0.6),
    6: (1.4, 1.6, 1.4, 0.7),
    7: (1.8, 1.8, 1.5, 0.8),
    8: (1.9, 1.7, 1.4, 0.8),
    9: (1.6, 1.5, 1.3, 0.7),
    10: (1.2, 1.2, 1.1, 0.5),
    11: (1.1, 1.1, 1.0, 0.4),
    12: (1.3, 1.3, 1.2, 0.5),
    13: (1.4, 1.3, 1.1, 0.5),
    14: (1.2, 1.2, 1.0, 0.4),
    15: (1.0, 1.0, 0.9, 0.3),
    16: (1.1, 1.1, 1.0, 0.4),
    17: (1.5, 1.4, 1.3, 0.6),
    18: (1.8, 1.7, 1.5, 0.7),
    19: (2.0, 1.8, 1.5, 0.8),
    20: (1.9, 1.7, 1.4, 0.7),
    21: (1.6, 1.5, 1.3, 0.6),
    22: (1.3, 1.3, 1.2, 0.5),
    23: (0.7, 0.9, 0.8, 0.2),
    0: (0.5, 0.7, 0.6, 0.1),
    1: (0.5, 0.7, 0.6, 0.1),
    2: (0.5, 0.7, 0.6, 0.1),
    3: (0.6, 0.8, 0.7, 0.2),
    4: (0.7, 0.9, 0.8, 0.3),
}
BASE_PRICES = {"high": 12000.0, "medium": 8500.0, "normal": 6200.0}
PEAK_PREMIUMS = {"super_peak": 0.35, "peak": 0.20, "moderate": 0.05, "low": -0.15}

# runway -> (length ft, max operations per hour, preferred aircraft categories)
SUITABILITY_RUNWAYS = {
    "09R/27L": (4430, 35, ["Heavy", "Medium"]),
    "09L/27R": (4430, 35, ["Heavy", "Medium"]),
    "14/32": (2925, 25, ["Medium", "Light"]),
    "27/09": (3445, 28, ["Medium", "Light"]),
}

# wake separation minutes, leader category -> follower category
WAKE_SEPARATION = {
    ("Heavy", "Heavy"): 4, ("Heavy", "Medium"): 5, ("Heavy", "Light"): 6,
    ("Medium", "Heavy"): 3, ("Medium", "Medium"): 3, ("Medium", "Light"): 5,
    ("Light", "Heavy"): 3, ("Light", "Medium"): 3, ("Light", "Light"): 3,
}

# greedy optimiser hourly capacity per runway, used at 85%
GREEDY_RUNWAY_CAPACITY = {"09R/27L": 30, "09L/27R": 30, "14/32": 25}

AIRLINE_REPUTATION = {
    "AI": 0.82, "6E": 0.78, "UK": 0.70, "SG": 0.72, "G8": 0.68,
    "QP": 0.65, "I5": 0.66, "9W": 0.70, "VT": 0.74, "IX": 0.69,
}
DEFAULT_REPUTATION = 0.65

# ---------------------------------------------------------------------------
# Column helpers over the fixed values
# ---------------------------------------------------------------------------


def lit_map(d: dict) -> Column:
    """``create_map`` literal for small lookups (stays inside codegen, no join)."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def peak_category(hour: Column) -> Column:
    """four-way category from the hour sets."""
    expr = None
    for name in ("super_peak", "peak", "moderate"):
        cond = hour.isin(PEAK_HOURS[name])
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr.otherwise("low")


def delay_category(delay: Column) -> Column:
    """right-closed bins (-inf,0],(0,15],(15,30],(30,60],(60,inf)."""
    return (
        F.when(delay.isNull(), None)
        .when(delay <= 0, "On_Time")
        .when(delay <= 15, "Minor")
        .when(delay <= 30, "Moderate")
        .when(delay <= 60, "Major")
        .otherwise("Severe")
    )


def weather_dim(spark: SparkSession) -> DataFrame:
    rows = [(k, *v) for k, v in WEATHER.items()]
    return spark.createDataFrame(
        rows,
        "weather_condition string, visibility_km double, wind_speed_kts int, precipitation_mm double, "
        "capacity_reduction_factor double, landing_restrictions boolean, takeoff_restrictions boolean, "
        "crosswind_runway_closure boolean, condition_delay int",
    )
