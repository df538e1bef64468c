"""Betweenness centrality (G9): Brandes' algorithm level by level over DataFrames.

All sources of a block advance together: a row is a (source, node) pair. One join with the edges and one
aggregate find the next level; levels are stored, and the way back sends (1 + dependency) / paths along
the reversed edges, again one join and one aggregate a level. No task holds the graph or a source's
search tree, so the same code serves any size:

* what a source has reached is kept as bits, one row per node and 64 sources;
* a block has at most ``block_pairs`` (source, node) pairs, more blocks follow one another;
* pairs exist only inside a source's component, so separate airports cost nothing to each other: blocks of
  all sources are cut by the sizes of their components, and a block of pivots is halved only if its pairs
  turn out to be too many.

Exact betweenness is O(V x E) however it is run. ``sources=k`` draws k pivots by a hash of their ids and
scales their sum by n / k: an unbiased estimate for one block of work on large graphs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.components import smallest_labels
from tarmac.functions.windows import row_index
from tarmac.operators.graph import edge_tasks
from tarmac.session import stored

BLOCK_PAIRS = 1_000_000_000  # (source, node) pairs that a block of sources may have
ID_BUCKETS = 1 << 14  # hash buckets for dense ids: parallelism of the id assignment
WORD = 64
PIVOTS_AT_ONCE = 8  # blocks of pivots that are first tried as one: they reach all nodes at worst
KEPT_APART = 8  # levels whose bits are merged when read, before they are stored with the rest


def _bits(frontier: DataFrame) -> DataFrame:
    """``node, word, mask``: the sources of a level as bits."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(source, {WORD}) as int))")
    return frontier.groupBy("node", F.floor(F.col("source") / WORD).alias("word")).agg(F.bit_or(bit).alias("mask"))


def _merged(masks: DataFrame) -> DataFrame:
    return masks.groupBy("node", "word").agg(F.bit_or("mask").alias("mask"))


def _levels(start: DataFrame, edges: DataFrame, most: int | None = None) -> list[DataFrame] | None:
    """Stored levels of (source, node, sigma): sigma shortest paths lead from the source to the node. None as soon
    as there are more than ``most`` pairs."""
    levels = [stored(start.select("source", "node", F.lit(1.0).alias("sigma")), "bfs")]
    pairs = 0
    seen, fresh = None, [_bits(levels[0])]
    held = F.expr(f"mask is not null and (shiftrightunsigned(mask, cast(pmod(source, {WORD}) as int)) & 1) = 1")
    while True:
        known = _merged(reduce(DataFrame.unionByName, fresh if seen is None else [seen, *fresh]))
        if len(fresh) == KEPT_APART:
            seen, fresh = stored(known, "seen"), []
            known = seen
        reached = levels[-1].join(edges, F.col("node") == F.col("s")).groupBy("source", F.col("t").alias("node")).agg(F.sum("sigma").alias("sigma"))
        new = reached.withColumn("word", F.floor(F.col("source") / WORD)).join(known, ["node", "word"], "left").filter(~held)
        new = stored(new.select("source", "node", "sigma"), "bfs")
        more = new.count()
        if not more:
            return levels
        pairs += more
        if most is not None and pairs > most:
            return None
        levels.append(new)
        fresh.append(_bits(new))


def _dependencies(levels: list[DataFrame], edges: DataFrame) -> DataFrame:
    """``vid, b``: summed dependencies of the block's sources on each node between them and others."""
    if len(levels) > 3:  # the way back is among what was reached
        nodes = reduce(DataFrame.unionByName, [level.select("node") for level in levels]).distinct()
        for end in ("s", "t"):
            edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
        edges = stored(edges, "reached")
    deltas = [levels[0].limit(0).withColumn("delta", F.lit(0.0))]
    below = levels[-1].select("source", F.col("node").alias("t"), (1 / F.col("sigma")).alias("w"))  # nothing lies behind the last level
    for level in reversed(levels[1:-1]):
        heard = below.join(edges, "t").groupBy("source", F.col("s").alias("node")).agg(F.sum("w").alias("w"))
        delta = level.join(heard, ["source", "node"], "left").withColumn("delta", F.col("sigma") * F.coalesce("w", F.lit(0.0))).drop("w")
        deltas.append(stored(delta, "delta"))
        below = deltas[-1].select("source", F.col("node").alias("t"), ((1 + F.col("delta")) / F.col("sigma")).alias("w"))
    return stored(reduce(DataFrame.unionByName, deltas).groupBy(F.col("node").alias("vid")).agg(F.sum("delta").alias("b")), "dependencies")


def _by_components(e: DataFrame, n: int, block_pairs: int) -> list[tuple[int, int]]:
    """Ranges of sources, all n nodes being one, whose pairs are at most ``block_pairs`` (or one source's): a source
    reaches no more than its component, so the ranges are cut where the summed sizes pass a multiple."""
    own = e.sparkSession.range(n).select(F.col("id").alias("node"))
    lab = smallest_labels(own, e.select(F.col("s").alias("a"), F.col("t").alias("b")))
    sized = stored(lab.join(lab.groupBy("lab").agg(F.count(F.lit(1)).alias("w")), "lab").select("node", "w", F.floor(F.col("node") / (1 << 16)).alias("_b")), "sizes")
    parts = sized.groupBy("_b").agg(F.sum("w").alias("_w"))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row for 65,536 nodes
    offsets = parts.select("_b", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_off"))
    upto = F.col("_off") + F.sum("w").over(Window.partitionBy("_b").orderBy("node"))
    block = F.floor((upto - 1) / block_pairs)
    cut = sized.join(offsets, "_b").select("node", block.alias("block")).groupBy("block").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    return sorted((r.lo, r.hi + 1) for r in cut.collect())


def betweenness(nodes: DataFrame, edges: DataFrame, normalized: bool = True, sources: int | None = None,
                id_col: str = "flight_id", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``id_col, betweenness``: unweighted, directed, normalised by 1 / ((n - 1)(n - 2)) like the reference.

    ``sources=None`` is exact; k estimates from k pivots. Repeated edges count once, loops and edges with
    an end outside ``nodes`` not at all.
    """
    spark = nodes.sparkSession
    ids = nodes.select(id_col).filter(F.col(id_col).isNotNull()).distinct()
    # hash buckets keep the numbering balanced; vid is dense 0..n-1 in (bucket, id) order
    ids = stored(row_index(ids, [], [id_col], F.abs(F.xxhash64(id_col)) % ID_BUCKETS, "vid"), "ids")
    n = ids.count()
    kept = stored(edges.select("src", "dst").filter("src <> dst"), "edges")
    tasks = edge_tasks(kept, kept.count())
    e = kept.repartition(tasks, "src").distinct().join(ids.select(F.col(id_col).alias("src"), F.col("vid").alias("s")), "src")
    e = stored(e.select("s", "dst").repartition(tasks, "dst").join(ids.select(F.col(id_col).alias("dst"), F.col("vid").alias("t")), "dst").select("s", "t"), "graph")
    picked = n if sources is None else min(sources, n)
    # sources of neighbouring ids share a word of bits; pivots are numbered in the order drawn
    pivots = spark.range(n).select(F.col("id").alias("node")) if picked == n else \
        spark.range(n).select(F.col("id").alias("node")).orderBy(F.xxhash64("node"), "node").limit(picked)
    pivots = stored(row_index(pivots, [], ["node"], F.floor(F.col("node") / (1 << 16)), "source"), "pivots")
    if sources is None and n * n > block_pairs:
        todo, most = _by_components(e, n, block_pairs), None
    else:
        size = max(1, PIVOTS_AT_ONCE * block_pairs // max(n, 1))
        todo, most = [(first, min(first + size, picked)) for first in range(0, picked, size)], block_pairs
    total = None
    while todo:
        first, last = todo.pop(0)
        start = pivots.filter((F.col("source") >= first) & (F.col("source") < last)).withColumn("source", F.col("source") - first)
        levels = _levels(start, e, most if last - first > 1 else None)
        if levels is None:
            half = (first + last) // 2
            todo[:0] = [(first, half), (half, last)]
            continue
        part = _dependencies(levels, e)
        total = part if total is None else stored(total.unionByName(part).groupBy("vid").agg(F.sum("b").alias("b")), "dependencies")
    scale = (1.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0) * (n / picked if picked else 1.0)
    if total is None:
        return ids.select(id_col, F.lit(0.0).alias("betweenness"))
    return ids.join(total, "vid", "left").select(id_col, (F.coalesce(F.col("b"), F.lit(0.0)) * scale).alias("betweenness"))
