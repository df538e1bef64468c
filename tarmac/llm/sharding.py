"""Sharding by sampled splitters: near-equal bytes per shard (law ``bytes``).

Records are ordered by a hash of their text, so equal texts lie next to each other.
1. A size-weighted sample of keys (about ``SAMPLE`` draws, whatever the input) gives quantile
   boundaries for ``RANGES`` key ranges.
2. Exact bytes and rows per range; a range over twice its share of bytes or over ``PIECE_ROWS`` rows is
   subdivided, first evenly by key, so equal texts stay together, and where one key alone is too much for a
   piece, by a hash of the id. So the pieces follow the rows, however many there are.
3. Each piece knows the bytes before it; a running sum inside the piece places every record on the
   line of all bytes, which is cut into equal shards. Shard sizes differ by about one record.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarmac.llm.common import broadcast_if_small, documents, spare, staged, text_or_empty

SHARDS = 40
RANGES = 1024  # splitter ranges; pieces, not ranges, bound a task
PIECE_ROWS = 200_000
SAMPLE = 50_000


def shards(docs: DataFrame, n_shards: int = SHARDS, ranges: int = RANGES, piece_rows: int = PIECE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Null text has no bytes (size 16). Rows that repeat id and text are interchangeable and get slots of
    their own; null ids sort first. Equal texts lie side by side, but a shard border may cut a group of them. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    text = text_or_empty(docs, text_col)
    rows = staged(docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                              F.xxhash64(text).alias("key")), "shard-rows")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()

    # 1. weighted draws: a record is drawn floor(size * rate + u) times, u by hash, so reruns draw alike
    u = F.pmod(F.xxhash64("key", "doc_id", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    draws = rows.select("key", F.floor(F.col("size") * F.lit(SAMPLE / max(1, total)) + u).alias("times")).filter("times > 0")
    drawn = sorted((r.key, r.times) for r in draws.groupBy("key").agg(F.sum("times").alias("times")).collect())  # about SAMPLE draws
    cum = np.cumsum([t for _, t in drawn]) if drawn else np.zeros(1)
    cuts = sorted({drawn[bisect.bisect_left(cum, cum[-1] * i / ranges)][0] for i in range(1, ranges)}) if drawn else []
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.int64), side="left").astype(np.int32))

    ranged = staged(rows.withColumn("range", range_of("key")), "shard-ranged")

    # 2. overfull ranges: at most ``ranges`` rows are broadcast
    share = max(1, total // ranges)

    def parts() -> Column:
        by_bytes = F.when(F.sum("size") > 2 * share, F.ceil(F.sum("size") / F.lit(share))).otherwise(F.lit(1))
        return F.greatest(by_bytes, F.ceil(F.count(F.lit(1)) / F.lit(piece_rows))).cast("long")

    cut = ranged.groupBy("range").agg(parts().alias("parts"), F.min("key").cast("double").alias("low"), F.max("key").cast("double").alias("high"))
    along = F.least(F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low") + 1) * F.col("parts")), F.col("parts") - 1)
    by_key = staged(ranged.join(F.broadcast(cut), "range").withColumn("slice", F.greatest(along, F.lit(0)).cast("long")).drop("parts", "low", "high"), "shard-slices")
    again = by_key.groupBy("range", "slice").agg(parts().alias("parts")).filter("parts > 1")  # one key's rows, or nearly
    pieces = by_key.join(broadcast_if_small(again, 100_000), ["range", "slice"], "left").withColumn(
        "piece", F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.coalesce("parts", F.lit(1))))

    # 3. bytes and rows before each piece (one row per share of bytes or PIECE_ROWS rows), then inside it
    before = W.orderBy("range", "slice", "piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.groupBy("range", "slice", "piece").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("c")) \
        .select("range", "slice", "piece", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("rows_before"))
    inside = W.partitionBy("range", "slice", "piece").orderBy("key", "doc_id", "size")
    placed = pieces.join(offsets, ["range", "slice", "piece"]).select(
        "doc_id", "size", "text_crc32",
        (F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size") / 2).alias("middle"),
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("position"))
    placed = staged(placed.withColumn("shard", F.least(F.floor(F.col("middle") * n_shards / F.lit(float(max(1, total)))), F.lit(n_shards - 1)).cast("int")), "shard-placed")
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("position") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents as Parquet, one folder per shard; files of a shard are written by several tasks."""
    key, crc, at, shard, slot = spare(docs, "_id", "_crc", "_p", "_shard", "_slot")
    place = shards(docs, n_shards, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias(key), F.col("text_crc32").alias(crc), "shard", "slot") \
        .groupBy(key, crc).agg(F.min(F.struct("shard", "slot")).alias(at))
    text = text_or_empty(docs, text_col)
    docs.join(place, docs[id_col].eqNullSafe(F.col(key)) & (F.crc32(text) == F.col(crc))).withColumn(shard, F.col(f"{at}.shard")) \
        .withColumn(slot, F.col(f"{at}.slot")).drop(key, crc, at).repartition(shard, F.floor(F.col(slot) / 50_000)) \
        .write.partitionBy(shard).parquet(path)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir))
