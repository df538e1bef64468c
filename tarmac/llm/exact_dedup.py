"""Exact duplicates by skew-safe combining (DataFrame operations only).

Texts are equal when identical after the characters of ``[\\x20\\x09-\\x0D]`` are deleted. Three
stages, each grouping by digest *and* normalised content, so a digest collision never merges texts:
1. map-side: the partial aggregate keeps one row per content and task;
2. salted: those rows merge per (digest, content, salt), the salt being the map task modulo
   ``salts``, so a group holding a third of all rows is spread over ``salts`` tasks;
3. global: at most ``salts`` winners per content meet.
Memory per task does not depend on group sizes: a group is never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import SPACE_RUN, documents, spare, text_or_empty

SALTS = 32


def _normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_RUN, "")


def _id_keys(col: Column, names: list[str]) -> list[Column]:
    """An id as plain equality keys, null included."""
    return [F.coalesce(col.cast("string"), F.lit("")).alias(names[0]), col.isNull().alias(names[1])]


def _with_digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(docs, text_col)
    return docs.select(docs[id_col].alias("doc_id"), F.length(text).alias("_points"), _normalised(text).alias("_content")) \
        .withColumns({"_digest": F.sha2("_content", 256), "_check": F.xxhash64("_content")})


def winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: ``_digest, _check, keep_id, _keep_points, group_size``.

    The row with most code points stays, then the smallest id; a null id only when the group has no other.
    """
    order = F.struct((-F.col("_points")).alias("p"), F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"))
    rows = _with_digest(docs, id_col, text_col).select("_digest", "_check", "_content", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"), order.alias("_o"))
    salted = rows.groupBy("_digest", "_check", "_content", "_salt").agg(F.min("_o").alias("_o"), F.count(F.lit(1)).alias("_n"))
    merged = salted.groupBy("_digest", "_check", "_content").agg(F.min("_o").alias("_o"), F.sum("_n").alias("group_size"))
    return merged.select("_digest", "_check", F.col("_o.id").alias("keep_id"), (-F.col("_o.p")).alias("_keep_points"), "group_size")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty; empty and blank texts form one group. Rows that repeat id and text
    are one document given several times: exactly one of them is kept. Null ids are grouped like any
    other text and stay only where the group has no id at all. Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    best = winners(docs, id_col, text_col, salts)
    # repeats of one (id, length, text) collapse before the join and come back as rows 1..n
    rows = _with_digest(docs, id_col, text_col).groupBy("_digest", "_check", "doc_id", "_points").agg(F.count(F.lit(1)).alias("_n"))
    joined = rows.join(best, ["_digest", "_check"]).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_points") == F.col("_keep_points")) & (F.col("_k") == 1)
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("_digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The documents that stay, with all their columns as given."""
    keys = spare(docs, "_digest", "_check", "_points", "_id", "_null")
    best = winners(docs, id_col, text_col, salts).select(
        F.col("_digest").alias(keys[0]), F.col("_check").alias(keys[1]), F.col("_keep_points").alias(keys[2]), *_id_keys(F.col("keep_id"), keys[3:]))
    text = text_or_empty(docs, text_col)
    keyed = docs.select("*", F.sha2(_normalised(text), 256).alias(keys[0]), F.xxhash64(_normalised(text)).alias(keys[1]), F.length(text).alias(keys[2]), *_id_keys(docs[id_col], keys[3:]))
    # repeated (id, text) rows share every key and so a task: one of them stays, without another shuffle
    return keyed.join(best, keys, "left_semi").dropDuplicates(keys).drop(*keys)


def op2(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS pts, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM n WINDOW w AS (PARTITION BY body ORDER BY pts DESC, doc_id)
"""
