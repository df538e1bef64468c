"""Benchmark decontamination by a prefix-filtered set join (DataFrame operations only).

An item is cut into windows of ``window`` consecutive words (a shorter item is one window); a window
is a set of word shingles of ``SHINGLE`` words (fewer where the window is shorter). A document holds a
window only if it holds *all* its shingles, so containment needs a prefix of one shingle in rarity
order: the rarest one, by occurrences counted over all documents.

1. Occurrences: shingles of every document that some window has (hash join, one scan).
2. Rarity: occurrences per shingle; each window is looked up by its rarest shingle only.
3. Candidates: that shingle's position fixes where the window would start; length and position
   bounds drop starts outside the document.
4. Verification: the document's words at that place are compared with the window's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import ascii_lower, broadcast_if_small, documents, spare, staged, text_or_empty

#: What separates words, after A-Z have become a-z (fixed value).
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 5
#: A benchmark side of at most this many narrow rows (16 bytes) is broadcast, a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BETWEEN_WORDS), "")


def _grams(words: Column, k: int) -> Column:
    n = F.size(words) - F.lit(k - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, window_words`` for every window of every item; null and wordless items have none."""
    w = items.select(items[id_col].alias("item_id"), _words(text_or_empty(items, text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    return w.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(window)).alias("window_words"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_key``
    (the last a hash of the text, telling rows with one id apart).

    Null and empty texts have no words and no hits. Rows repeating an id are judged each by their own
    text; null ids are allowed. Items with equal windows all count. An empty benchmark hits nothing.
    """
    item_windows = benchmark_windows(items, window).withColumn("window_id", F.sha2(F.concat_ws(" ", "window_words"), 256))
    windows = staged(item_windows.groupBy("window_id").agg(F.first("window_words").alias("window_words"))
                     .withColumns({"len": F.size("window_words"), "k": F.least(F.size("window_words"), F.lit(SHINGLE))}), "windows")
    members = staged(item_windows.select("window_id", "item_id").distinct(), "window-items")
    widths = sorted(r.k for r in windows.select("k").distinct().collect())  # at most SHINGLE values

    # every shingle of every window, with its place in the window
    parts = [windows.filter(F.col("k") == k).select("window_id", "len", F.posexplode(_grams(F.col("window_words"), k)).alias("offset", "gram")) for k in widths]
    shingles = parts[0] if parts else windows.select("window_id", "len", F.lit(0).alias("offset"), F.lit(0).cast("bigint").alias("gram")).limit(0)
    for p in parts[1:]:
        shingles = shingles.unionByName(p)
    wanted = shingles.select("gram").distinct()

    # 1. occurrences of wanted shingles: the word array never leaves its row, only hashes are exploded
    text = text_or_empty(docs, text_col)
    base = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("text_key"), _words(text).alias("w")).withColumn("n_words", F.size("w"))
    grams = F.flatten(F.array(*[F.transform(_grams(F.col("w"), k), lambda g, i: F.struct(i.alias("pos"), g.alias("gram"))) for k in widths])) if len(widths) > 1 \
        else F.transform(_grams(F.col("w"), widths[0] if widths else SHINGLE), lambda g, i: F.struct(i.alias("pos"), g.alias("gram")))
    found = base.select("doc_id", "text_key", "n_words", F.explode(grams).alias("o")).select("doc_id", "text_key", "n_words", "o.pos", "o.gram")
    occurrences = staged(found.join(broadcast_if_small(wanted, BROADCAST_ROWS), "gram"), "occurrences")

    # 2. rarity over all documents; a window with a shingle that never occurs cannot occur itself
    counted = shingles.join(occurrences.groupBy("gram").agg(F.count(F.lit(1)).alias("seen")), "gram", "left")
    rarest = counted.groupBy("window_id", "len").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "gram", "offset")).alias("r"))
    prefix = rarest.filter(F.col("r.seen") > 0).select("window_id", "len", F.col("r.gram").alias("gram"), F.col("r.offset").alias("offset"))

    # 3. candidate starts inside the document
    start = F.col("pos") - F.col("offset")
    near = occurrences.join(broadcast_if_small(prefix, BROADCAST_ROWS), "gram") \
        .filter((start >= 0) & (start + F.col("len") <= F.col("n_words"))).select("doc_id", "text_key", start.alias("start"), "window_id")
    told = near.join(broadcast_if_small(windows.select("window_id", "window_words"), BROADCAST_ROWS // 10), "window_id")
    cands = told.groupBy(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key")) \
        .agg(F.collect_set(F.struct("start", "window_id", "window_words")).alias("cands"))  # bounded by the document's own length

    # 4. compare words; documents without candidates pass through with no hits
    texts = docs.select(docs[id_col].alias("doc_id"), text.alias("t"), F.xxhash64(text).alias("text_key"))
    seen = texts.join(cands, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key")), "left")
    seen = seen.select("doc_id", "text_key", "cands", _words(F.col("t")).alias("w"))
    hits = F.filter(F.col("cands"), lambda c: F.slice(F.col("w"), c["start"] + 1, F.size(c["window_words"])) == c["window_words"])
    judged = seen.select("doc_id", "text_key", F.size("w").alias("n_words"), F.coalesce(hits, F.array().cast(cands.schema["cands"].dataType)).alias("hits"))
    cover = F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + F.size(c["window_words"]) - 1))))
    judged = staged(judged.select("doc_id", "text_key", F.col("n_words").cast("long").alias("n_words"), F.size(cover).cast("long").alias("n_hit"),
                                  F.transform("hits", lambda c: c["window_id"]).alias("ids")), "judged")
    per_item = judged.filter("n_hit > 0").select("doc_id", "text_key", F.explode(F.array_distinct("ids")).alias("window_id")) \
        .join(members, "window_id").select("doc_id", "text_key", F.col("item_id").cast("string").alias("item")).distinct()
    items_of = per_item.groupBy(F.col("doc_id").alias("i_id"), F.col("text_key").alias("i_key")).agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = judged.join(items_of, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("text_key") == F.col("i_key")), "left")
    return out.select("doc_id", "n_words", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "text_key")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    bad_id, bad_key = spare(docs, "_bad_id", "_bad_key")
    bad = contamination(docs, items, window, id_col, text_col).filter("contaminated").select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(bad_key)).distinct()
    same = docs[id_col].eqNullSafe(F.col(bad_id)) & (F.xxhash64(text_or_empty(docs, text_col)) == F.col(bad_key))
    return docs.join(bad, same, "left_anti")


def op5(spark, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_key")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS body FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS body FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, n, item_id FROM pos JOIN win USING (n, body)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
