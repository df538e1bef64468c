"""Quality classifier: a sparse rule ensemble over text statistics.

1. ``statistics``: one row of counts and shares per whole text.
2. A random forest on the labelled rows gives decision paths; every path from the root to a node is a
   conjunctive rule.
3. Lasso logistic regression over the rules keeps a few with a weight.
4. ``compile_rules`` turns them into one Spark column expression; scoring needs no model object.
Fitting uses at most about ``max_rows`` labelled rows (documented bound, drawn by a hash of the id);
statistics and scores cover every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import documents, lean, staged, text_or_empty

MAX_ROWS = 20_000
STATS = ["n_chars", "n_words", "word_len", "upper_share", "symbol_share", "digit_share", "bang_rate", "pipe_rate",
         "marked_words", "distinct_words", "top_word", "distinct_lines", "sentence_rate", "adjacent_repeats", "capital_words"]
_SYMBOLS = b"#$%&*@!|~^=+<>{}[]\\_"
_UPPER, _LETTER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"0123456789"
_MARK = bytes.maketrans(_SYMBOLS + b"\t\n\v\f\r", b"\x01" * len(_SYMBOLS) + b"     ")
_CAPITALS = re.compile(rb"(?<![A-Za-z])[A-Z]{2,}(?![a-z])")


def _stats(text: str) -> list[float]:
    """Shares and rates, so that they mean the same at any length (distinct words: per block of 100)."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    per_word = 1.0 / max(1, n)
    share = lambda chars: len(raw) - len(raw.translate(None, chars))
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marked = raw.translate(_MARK) + b" "
    return [float(len(text)), float(n), sum(map(len, words)) * per_word, share(_UPPER) / max(1, share(_LETTER)), share(_SYMBOLS) / size,
            share(_DIGIT) / size, raw.count(b"!") * per_word, raw.count(b"|") * per_word, marked.count(b"\x01 ") * per_word,
            sum(len(set(words[i:i + 100])) for i in range(0, n, 100)) * per_word, max(counts.values(), default=0) * per_word, len(set(lines)) / max(1, len(lines)), raw.count(b".") * per_word,
            sum(map(bytes.__eq__, words, words[1:])) * per_word, len(_CAPITALS.findall(raw)) * per_word]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: the id) and one double per name in STATS; null text counts as empty."""
    keep = [id_col] if keep is None else keep
    rows = docs.select(*[docs[c] for c in keep])
    if text_col in keep and docs.schema[text_col].dataType.simpleString() == "string":
        at = keep.index(text_col)  # kept texts travel once
    else:
        at, rows = len(keep), docs.select(*[docs[c] for c in keep], text_or_empty(docs, text_col).alias("__text"))
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + [f"__{s} double" for s in STATS])
    names = [*keep, *[f"__{s}" for s in STATS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([_stats(t or "") for t in batch.column(at).to_pylist()], float).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(table[:, i]) for i in range(len(STATS))]], names=names)

    return rows.mapInArrow(lean(run), schema)


def _paths(node, so_far: tuple, out: set) -> None:
    """Every path from the root to a node, as a set of (statistic, 'le' or 'gt', threshold)."""
    if so_far:
        out.add(frozenset(so_far))
    if node.subtreeDepth() == 0:
        return
    i, cut = node.split().featureIndex(), round(float(node.split().threshold()), 6)
    _paths(node.leftChild(), (*so_far, (i, "le", cut)), out)
    _paths(node.rightChild(), (*so_far, (i, "gt", cut)), out)


def _condition(rule) -> Column:
    cond = F.lit(True)
    for i, side, cut in sorted(rule):
        c = F.col(f"__{STATS[i]}")
        cond = cond & ((c <= cut) if side == "le" else (c > cut))
    return cond.cast("double")


def compile_rules(intercept: float, weighted: list) -> Column:
    """The fitted ensemble as one column: the logistic function of the weighted rules."""
    z = F.lit(float(intercept))
    for rule, weight in weighted:
        z = z + F.lit(float(weight)) * _condition(rule)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit(rows: DataFrame, label: str = "label", trees: int = 24, depth: int = 3, strength: float = 0.001, seed: int = 7) -> tuple[float, list]:
    """``rows``: statistics with a 0/1 label. Returns (intercept, [(rule, weight), ...]).

    Without both labels the ensemble is the share of ones (one half without rows) as a constant.
    """
    seen = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if len(seen) < 2:
        ones, n = sum(v for k, v in seen.items() if k == 1), sum(seen.values())
        p = (ones + 0.5) / (n + 1.0)
        return float(np.log(p / (1 - p))), []
    rows = rows.withColumn("__y", F.col(label).cast("double"))
    data = VectorAssembler(inputCols=[f"__{s}" for s in STATS], outputCol="__x").transform(rows)
    forest = RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=5).fit(data)
    found: set = set()
    for tree in forest._java_obj.trees():
        _paths(tree.rootNode(), (), found)
    rules = sorted(found, key=lambda r: (len(r), sorted(r)))
    if not rules:
        ones, n = seen.get(1, 0), sum(seen.values())
        return float(np.log((ones + 0.5) / (n - ones + 0.5))), []
    binary = rows.select("__y", *[_condition(r).alias(f"r{i}") for i, r in enumerate(rules)])
    features = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="__x").transform(binary)
    lasso = LogisticRegression(featuresCol="__x", labelCol="__y", elasticNetParam=1.0, regParam=strength, standardization=False, maxIter=60).fit(features)
    return float(lasso.intercept), [(r, w) for r, w in zip(rules, lasso.coefficients.toArray().tolist()) if w]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[float, list]:
    """Fit on labelled rows outside the held-out fold (crc32 of the id's text modulo 5 is 0)."""
    usable = labels.select(labels[id_col].alias("__id"), labels[label].cast("int").alias("label")) \
        .filter(F.col("__id").isNotNull() & F.col("label").isin(0, 1) & (F.crc32(F.col("__id").cast("string")) % 5 != 0))
    n = usable.count()
    if n > max_rows:  # a uniform share by hash: about max_rows rows whatever the table's size
        usable = usable.filter(F.pmod(F.xxhash64("__id"), F.lit(1_000_003)) < int(1_000_003 * max_rows / n))
    picked = docs.join(F.broadcast(usable), docs[id_col] == F.col("__id")).select(F.col("label"), text_or_empty(docs, text_col).alias("text"))
    rows = statistics(picked, text_col="text", keep=["label"])
    return fit(staged(rows, "quality-train").repartition(4).persist())


def score(docs: DataFrame, model: tuple[float, list], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row; null and empty texts are scored by their zero statistics."""
    return statistics(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), compile_rules(*model).alias("score"))


def keep_good(docs: DataFrame, model: tuple[float, list], threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows that the classifier accepts, with all their columns."""
    plain = [f"c{i}" for i in range(len(docs.columns))]  # no given name meets a statistic's
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == text_col.lower())
    scored = statistics(docs.toDF(*plain), text_col=plain[at], keep=plain)
    return scored.filter(compile_rules(*model) >= threshold).select(*[F.col(p).alias(c) for p, c in zip(plain, docs.columns)])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
