"""Skew-safe ordered windows.

A plain ``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one task. With a key
that holds a large share of the data (one busy airport, one aircraft, one sheet) that task
becomes the whole job. The helpers here partition by ``(key, bucket)`` where ``bucket`` is a
coarse slice of the ordering column (a day, a block of line numbers) and repair the bucket
edges with a small amount of borrowed context:

* ``forward_fill``: last non-null value over an unbounded frame. Each bucket computes its own
  running value; the value carried into a bucket comes from a per-bucket summary table
  (one row per bucket) scanned with a window - that table is rows/bucket_size in size.
* ``with_neighbors``: frames of a bounded number of rows before/after (lag, lead, rolling k).
  The ``before`` last rows of every bucket and the ``after`` first rows are copied into the
  neighbouring non-empty buckets as halo rows, the window runs per (key, bucket) and the
  halo rows are dropped. Halo tables hold at most (before+after) rows per bucket.

Both give exactly the result of the un-bucketed window for any bucket choice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BK = "_bk"
HALO = "_halo"


def forward_fill(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: dict[str, Column],
    bucket: Column,
) -> DataFrame:
    """Add columns ``name = last(value, ignorenulls) over (keys order by order rows unbounded..current)``."""
    df = df.withColumn(BK, bucket)
    for name, value in values.items():
        df = df.withColumn(f"_v_{name}", value)
    running = Window.partitionBy(*keys, BK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for name in values:
        df = df.withColumn(f"_in_{name}", F.last(f"_v_{name}", ignorenulls=True).over(running))
    tails = df.groupBy(*keys, BK).agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_t_{n}") for n in values]
    )
    prior = Window.partitionBy(*keys).orderBy(BK).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(
        *keys, BK, *[F.last(f"_t_{n}", ignorenulls=True).over(prior).alias(f"_c_{n}") for n in values]
    )
    out = df.join(carry, [*keys, BK], "left")
    for name in values:
        out = out.withColumn(name, F.coalesce(F.col(f"_in_{name}"), F.col(f"_c_{name}")))
    drop = [BK] + [f"_{p}_{n}" for n in values for p in ("v", "in", "c")]
    return out.drop(*drop)


def _halo(
    df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], n: int, side: str
) -> DataFrame:
    """Rows copied into neighbouring buckets: the last ``n`` rows before a bucket (side='before')
    or the first ``n`` rows after it (side='after')."""
    if n == 1:
        # one row per bucket: an aggregate (partial per map task, so only one row per bucket and
        # task is shuffled); the neighbouring non-empty bucket's row is then a lag/lead over the
        # one-row-per-bucket summary, which needs no positions, anchors or joins
        pick = F.max_by if side == "before" else F.min_by
        row = F.struct(*[F.col(c) for c in df.columns if c != BK])
        summary = df.groupBy(*keys, BK).agg(pick(row, F.struct(*order_cols)).alias("_row"))
        w = Window.partitionBy(*keys).orderBy(BK)
        nb = (F.lag if side == "before" else F.lead)("_row").over(w)
        return summary.select(F.col(BK), nb.alias("_nb")).filter(F.col("_nb").isNotNull()).select("_nb.*", BK)
    else:
        in_bucket = Window.partitionBy(*keys, BK).orderBy(
            *[F.col(c).desc() if side == "before" else F.col(c).asc() for c in order_cols]
        )
        edge = df.withColumn("_e", F.row_number().over(in_bucket)).filter(F.col("_e") <= n).drop("_e")
    # global position of edge rows per key (edge table is tiny: <= n rows per bucket)
    pos_w = Window.partitionBy(*keys).orderBy(*order_cols)
    edge = edge.withColumn("_p", F.row_number().over(pos_w))
    if side == "before":
        anchor = edge.groupBy(*keys, BK).agg(F.min("_p").alias("_a"))
        shifts = F.sequence(F.lit(1), F.lit(n))
    else:
        anchor = edge.groupBy(*keys, BK).agg(F.max("_p").alias("_a"))
        shifts = F.sequence(F.lit(-n), F.lit(-1))
    copies = edge.withColumn("_s", F.explode(shifts)).withColumn("_a", F.col("_p") + F.col("_s"))
    copies = copies.drop(BK, "_s", "_p")
    targets = anchor.select(*keys, F.col(BK), "_a")
    halo = copies.join(targets, [*keys, "_a"], "inner").drop("_a")
    # a copy landing in its own bucket is not a halo row
    return halo


def with_neighbors(
    df: DataFrame,
    keys: Sequence[str],
    order_cols: Sequence[str],
    bucket: Column,
    before: int,
    after: int,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    tasks: int | None = None,
) -> DataFrame:
    """Run ``compute(frame, window)`` with ``window = partitionBy(keys, bucket).orderBy(order_cols)``
    where each bucket also sees the ``before`` rows preceding it and the ``after`` rows following it.
    ``tasks``: number of tasks to which the buckets are dealt, in place of the session's."""
    base = df.withColumn(BK, bucket)
    parts = [base.withColumn(HALO, F.lit(False))]
    if before > 0:
        parts.append(_halo_from(base, keys, order_cols, before, "before"))
    if after > 0:
        parts.append(_halo_from(base, keys, order_cols, after, "after"))
    frame = parts[0]
    for p in parts[1:]:
        frame = frame.unionByName(p)
    if tasks:
        frame = frame.repartition(tasks, *keys, BK)
    w = Window.partitionBy(*keys, BK).orderBy(*order_cols)
    out = compute(frame, w)
    return out.filter(~F.col(HALO)).drop(HALO, BK)


def _halo_from(base: DataFrame, keys, order_cols, n: int, side: str) -> DataFrame:
    h = _halo(base, keys, order_cols, n, side)
    # keep only rows that really sit outside their target bucket
    return h.withColumn(HALO, F.lit(True)).select(*base.columns, HALO)


def row_index(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], bucket: Column, name: str = "row_idx") -> DataFrame:
    """0-based ``row_number() - 1`` over (keys order by order_cols) without a single-task window:
    position in bucket + rows in earlier buckets (prefix sum over a one-row-per-bucket table)."""
    base = df.withColumn(BK, bucket)
    local = Window.partitionBy(*keys, BK).orderBy(*order_cols)
    base = base.withColumn("_li", F.row_number().over(local) - 1)
    counts = base.groupBy(*keys, BK).agg(F.count(F.lit(1)).alias("_bn"))
    prior = Window.partitionBy(*keys).orderBy(BK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, BK, F.coalesce(F.sum("_bn").over(prior), F.lit(0)).alias("_off"))
    out = base.join(offsets, [*keys, BK], "left")
    return out.withColumn(name, F.col("_off") + F.col("_li")).drop(BK, "_li", "_off")
