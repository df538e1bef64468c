"""Exact quantiles of continuous columns without a single all-values buffer.

``percentile`` keeps a map of every distinct value in one aggregation buffer: fine for minute
counts, not for a continuous score over billions of rows. ``exact_percentile`` finds the two
order statistics around the target rank instead: an approximate quantile pair brackets the
rank, two counts confirm the bracket, and the rows inside it become a histogram of (value, count),
so a value that many rows share is one row. The histogram is refined level by level: 64 value ranges are
counted, the range that holds the rank is kept, until few values are left. The result equals
``percentile`` (linear interpolation between the two neighbouring order statistics).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.session import stored

#: distinct values that the driver may read at the last level
FEW_VALUES = 4096


def _order_statistic(hist: DataFrame, rank: int) -> float:
    """The value with the 0-based ``rank`` among the values of ``hist`` (v, c), each taken c times."""
    while True:
        values, cuts = hist.agg(F.count(F.lit(1)), F.percentile_approx("v", [i / 64 for i in range(1, 64)], 10_000)).first()
        if values <= FEW_VALUES:
            break
        bucket = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col("v")))
        sizes = sorted((r.b, r.c) for r in hist.groupBy(bucket.alias("b")).agg(F.sum("c").alias("c")).collect())  # at most 64
        for b, c in sizes:
            if rank < c:
                hist = hist.filter(bucket == b)
                break
            rank -= c
    for v, c in sorted((r.v, r.c) for r in hist.collect()):
        if rank < c:
            return v
        rank -= c
    raise ValueError("rank beyond the rows")


def exact_percentile(df: DataFrame, col: str, q: float, accuracy: int = 100_000) -> float | None:
    """Linear-interpolated q-quantile (same value as ``percentile``) in a few small jobs."""
    x = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    eps = 2.0 / accuracy
    lo_q, hi_q = max(0.0, q - eps), min(1.0, q + eps)
    # job 1: size and an approximate bracket around the target rank
    n, (lo, hi) = x.agg(F.count(F.lit(1)), F.percentile_approx("v", [lo_q, hi_q], accuracy)).first()
    if n == 0:
        return None
    pos = q * (n - 1)
    k0, k1 = math.floor(pos), math.ceil(pos)
    lo_v = F.lit(lo) if lo_q > 0 else F.lit(float("-inf"))
    hi_v = F.lit(hi) if hi_q < 1 else F.lit(float("inf"))
    in_band = (F.col("v") >= lo_v) & (F.col("v") <= hi_v)
    # job 2: confirm the bracket
    below, m = x.agg(F.count_if(F.col("v") < lo_v), F.count_if(in_band)).first()
    band = x.filter(in_band)
    if not (below <= k0 and k1 < below + m):  # bracket missed (ties at the edges): all rows
        band, below = x, 0
    # then the histogram of the band, and the two ranks in it
    hist = stored(band.groupBy("v").agg(F.count(F.lit(1)).alias("c")), "quantile")
    v0 = _order_statistic(hist, k0 - below)
    v1 = v0 if k1 == k0 else _order_statistic(hist, k1 - below)
    return v0 + (v1 - v0) * (pos - k0)
