"""Sequential delay folds (W3 turnaround propagation, W4 runway congestion) and J7 trailing load.

Both folds are order-dependent recurrences. They run JVM-side as a SQL ``aggregate`` over the
time-sorted flights of one *bounded* group:

* W4 is defined per (runway, day) by the reference, so one group is one runway-day.
* W3 runs per aircraft over its whole history. We fold per (aircraft, day) and stitch the days
  together: the actual time leaving one day is the carry into the next non-empty day. Each
  round refolds the days with the carries of the previous round and stops once no carry
  changes, so the number of rounds is the longest chain of days linked by an overnight
  turnaround, not the history length. ``mode='max'`` (actual =
  max(own, prev + turnaround)) is a max-plus recurrence with a closed form: a running maximum,
  computed with the bucketed prefix tools instead of a fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.session import cut_lineage


def _minutes(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", a, b) / 60.0


def _fold_day(flights: Column, carry: Column, turn: int) -> Column:
    """Fold one aircraft-day (sorted array of structs s, flight_id, delay, actual) given the carry-in
    actual time (null = none). Returns struct(prev, out array)."""
    empty = F.array().cast("array<struct<flight_id:string,delay:double,actual:timestamp_ntz>>")
    init = F.struct(carry.alias("prev"), empty.alias("out"))

    def step(acc, x):
        earliest = F.timestamp_add("MINUTE", F.lit(turn), acc["prev"])
        trig = acc["prev"].isNotNull() & (earliest > x["s"])
        new_act = F.when(trig, earliest).otherwise(x["actual"])
        new_delay = F.when(trig, x["delay"] + _minutes(x["s"], earliest)).otherwise(x["delay"])
        rec = F.struct(x["flight_id"].alias("flight_id"), new_delay.alias("delay"), new_act.alias("actual"))
        return F.struct(new_act.alias("prev"), F.concat(acc["out"], F.array(rec)).alias("out"))

    return F.aggregate(flights, init, step)


# W3
def propagate_turnaround(fl: DataFrame, min_turnaround: int = 45, mode: str = "overwrite") -> DataFrame:
    """Per aircraft in (scheduled, id) order: if prev_actual + 45 > scheduled, the flight's delay grows
    by the gap and its actual becomes prev_actual + 45 (overwriting a later own actual, as the
    reference does). Returns flight_id, aircraft_id, scheduled_time, delay_minutes, actual_time."""
    if mode == "max":
        return _propagate_max(fl, min_turnaround)
    rows = fl.select(
        "aircraft_id", F.to_date("scheduled_time").alias("day"),
        F.struct(F.col("scheduled_time").alias("s"), "flight_id", F.col("delay_minutes").cast("double").alias("delay"),
                 F.col("actual_time").alias("actual")).alias("x"),
    )
    groups = rows.groupBy("aircraft_id", "day").agg(F.sort_array(F.collect_list("x")).alias("fl"))
    groups = cut_lineage(groups.withColumn("carry", F.lit(None).cast("timestamp_ntz")))
    prev_w = Window.partitionBy("aircraft_id").orderBy("day")
    while True:
        folded = groups.withColumn("r", _fold_day(F.col("fl"), F.col("carry"), min_turnaround))
        folded = cut_lineage(folded.select("aircraft_id", "day", "fl", "carry", F.col("r.prev").alias("last"), F.col("r.out").alias("out")))
        # carry-in from the previous non-empty day of the same aircraft (one row per aircraft-day)
        nxt = folded.withColumn("new_carry", F.lag("last").over(prev_w))
        changed = nxt.filter(~F.col("new_carry").eqNullSafe(F.col("carry")))
        if changed.isEmpty():
            break
        groups = cut_lineage(nxt.select("aircraft_id", "day", "fl", F.col("new_carry").alias("carry")))
    out = folded.select("aircraft_id", F.inline("out"))
    base = fl.select("flight_id", "scheduled_time")
    return out.join(base, "flight_id").select(
        "flight_id", "aircraft_id", "scheduled_time", F.col("delay").alias("delay_minutes"), F.col("actual").alias("actual_time")
    )


def _propagate_max(fl: DataFrame, turn: int) -> DataFrame:
    """a_i = max(A_i, a_{i-1} + turn) = turn * i + max_{j <= i}(A_j - turn * j): a running maximum."""
    from tarmac.functions.windows import BK, row_index

    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    df = row_index(fl, ["aircraft_id"], ["scheduled_time", "flight_id"], F.to_date("scheduled_time"), "_i")
    df = df.withColumn("_v", F.timestamp_diff("MINUTE", epoch, F.col("actual_time")) - F.col("_i") * turn)
    df = df.withColumn(BK, F.to_date("scheduled_time"))
    run = Window.partitionBy("aircraft_id", BK).orderBy("scheduled_time", "flight_id").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_run", F.max("_v").over(run))
    tails = df.groupBy("aircraft_id", BK).agg(F.max("_v").alias("_t"))
    prior = Window.partitionBy("aircraft_id").orderBy(BK).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select("aircraft_id", BK, F.max("_t").over(prior).alias("_c"))
    df = df.join(carry, ["aircraft_id", BK], "left")
    best = F.greatest(F.col("_run"), F.coalesce(F.col("_c"), F.col("_run")))
    act = F.timestamp_add("MINUTE", best + F.col("_i") * turn, epoch)
    df = df.withColumn("_a", act)
    return df.select(
        "flight_id", "aircraft_id", "scheduled_time",
        (F.col("delay_minutes") + F.greatest(F.lit(0.0), _minutes(F.col("actual_time"), F.col("_a")))).alias("delay_minutes"),
        F.col("_a").alias("actual_time"),
    )


# J7
def trailing_hour_load(fl: DataFrame) -> DataFrame:
    """Flights on the same runway-day scheduled in [t - 1h, t], same-minute peers included."""
    m = F.timestamp_diff("MINUTE", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("scheduled_time"))
    w = Window.partitionBy("base_airport", "runway", "date").orderBy("_m").rangeBetween(-60, 0)
    return fl.withColumn("_m", m).withColumn("trailing_hour_load", F.count(F.lit(1)).over(w)).drop("_m")


# W4
def propagate_runway_congestion(fl: DataFrame) -> DataFrame:
    """Per (base, runway, day) in (time, id) order: utilisation = trailing-hour load / runway capacity;
    if utilisation > 0.8 and accumulated > 0: c = min(60, 0.3 * acc * util), delay += int(c), acc += c;
    otherwise acc decays by 0.8; then a delayed flight adds 0.1 x its delay to acc."""
    loaded = trailing_hour_load(fl)
    rows = loaded.select(
        "base_airport", "runway", "date",
        F.struct(F.col("scheduled_time").alias("s"), "flight_id", F.col("delay_minutes").cast("double").alias("delay"),
                 (F.col("trailing_hour_load") / F.col("runway_capacity")).alias("util")).alias("x"),
    )
    groups = rows.groupBy("base_airport", "runway", "date").agg(F.sort_array(F.collect_list("x")).alias("fl"))
    empty = F.array().cast("array<struct<flight_id:string,delay:double,util:double>>")

    def step(acc, x):
        a = acc["acc"]
        hot = (x["util"] > 0.8) & (a > 0)
        c = F.least(F.lit(60.0), a * 0.3 * x["util"])
        delay = F.when(hot, x["delay"] + F.floor(c)).otherwise(x["delay"])
        a2 = F.when(hot, a + c).otherwise(F.greatest(F.lit(0.0), a * 0.8))
        a3 = F.when(delay > 0, a2 + delay * 0.1).otherwise(a2)
        rec = F.struct(x["flight_id"].alias("flight_id"), delay.alias("delay"), x["util"].alias("util"))
        return F.struct(a3.alias("acc"), F.concat(acc["out"], F.array(rec)).alias("out"))

    folded = groups.select(F.aggregate("fl", F.struct(F.lit(0.0).alias("acc"), empty.alias("out")), step)["out"].alias("out"))
    return folded.select(F.inline("out")).select("flight_id", F.col("delay").alias("delay_minutes"), F.col("util").alias("runway_utilization"))
