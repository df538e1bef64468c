"""SimHash near duplicates by a segment-popcount embedding.

A text's fingerprint has bit i where more than half of its shingles' 64-bit hashes have it. Documents
link when their fingerprints differ in at most ``DIFFER`` bits; a fingerprint is a node, however many
documents share it, so copies never meet in pairs.

* Embedding: a fingerprint becomes the point of its ``SEGMENTS`` bit counts (two bits a segment). A
  differing bit moves one coordinate by at most one, so the Manhattan distance of two points is at most
  the number of differing bits: a safe lower bound.
* Grid range join: the coordinates are dealt to g groups. Points within Manhattan distance ``DIFFER``
  agree in all but ``DIFFER`` groups at least, so both lie in the same grid cell of some g - ``DIFFER``
  groups. One posting per choice of groups puts a point into those cells; points that share a cell are
  compared, first by the Manhattan distance of all coordinates, then exactly.
* g by cost: more groups mean more postings and smaller cells. The chance that two points share a cell
  comes from each coordinate's counts over all fingerprints.

A cell emits links that span its components, not its pairs: the members not reached yet are compared
with one reached member at a time. Cells of more than ``CELL`` points are cut into blocks, and pairs of
blocks go to different tasks. Links of all cells meet in ``components``.

Results for special input: null, empty and blank texts have fingerprint zero, which links like any
other; rows that repeat an id each give a row; a null id is returned with the component of its text,
whose id is null only if no document of the component has one. Other columns are ignored, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import broadcast_if_small, documents, lean, small_batches, staged, text_or_empty
from tarmac.llm.components import components

SHINGLE = 4
SEED = 42
DIFFER = 4
SEGMENTS = 32
CELL = 8192
HOT_CELLS = 100_000  # broadcast up to so many, shuffled beyond
MAX_GROUPS = 16
POSTING_COST, COMPARE_COST = 1.0, 0.02  # microseconds
_STEP = 1 << 16
_LOW = np.uint64(0x5555555555555555)
_PAIRS = np.uint64(0x3333333333333333)


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """The SimHash of a whole text's k-word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and the blanks x20, x09-x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(k, len(words))
    stop = ends[width - 1:]
    start = np.concatenate(([0], ends[: len(stop) - 1] + 1))
    hashed = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for at in range(0, len(stop), _STEP):
        h = np.array([hashed(joined[a:b], SEED) for a, b in zip(start[at:at + _STEP].tolist(), stop[at:at + _STEP].tolist())], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * total > len(stop)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """``doc_id, print``: the fingerprint's 64 bits as a long."""
    rows = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, k) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "print"])

    return rows.mapInArrow(lean(run), f"doc_id {id_type}, print long")


def embed(prints: np.ndarray) -> np.ndarray:
    """Bit counts of the two-bit segments, packed two bits a count into one word."""
    return prints - ((prints >> np.uint64(1)) & _LOW)


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed points: per segment |a - b|, with a, b in 0..2."""
    total = np.zeros(np.broadcast(x, y).shape, np.uint8)
    for shift in (np.uint64(0), np.uint64(2)):  # even and odd segments, four bits each
        a, b = (x >> shift) & _PAIRS, (y >> shift) & _PAIRS
        d = (a | np.uint64(0x4444444444444444)) - b  # 4 + a - b in each four bits: 2 to 6
        low = d & np.uint64(0x1111111111111111)  # distance 1: 3 or 5
        two = (d >> np.uint64(1)) & ~d & np.uint64(0x1111111111111111)  # distance 2: 2 or 6
        total += np.bitwise_count(low) + np.uint8(2) * np.bitwise_count(two)
    return total


def _groups(g: int) -> list[list[int]]:
    return [list(range(i, SEGMENTS, g)) for i in range(g)]


def _choices(g: int, differ: int) -> np.ndarray:
    """For each choice of g - differ groups the mask of their segments' bits."""
    masks = [sum(3 << 2 * s for s in seg) for seg in _groups(g)]
    return np.array([sum(c) for c in itertools.combinations(masks, g - differ)], np.uint64)


def groups_by_cost(nodes: DataFrame, differ: int) -> int:
    """The number of groups with the least postings plus expected comparisons.

    At least two groups name a cell: one alone is too coarse, and a step from one to two would triple
    the postings at some size of the corpus (later steps double them at most, roughly).
    """
    p = F.col("print")
    counts = [F.bit_count(F.shiftrightunsigned(p, 2 * s).bitwiseAND(F.lit(3))) for s in range(SEGMENTS)]
    row = nodes.agg(F.count(F.lit(1)), *(F.count(F.when(c == v, 1)) for c in counts for v in range(3))).first()
    n, tally = row[0], np.array(row[1:], float).reshape(SEGMENTS, 3)
    same = ((tally / max(1, n)) ** 2).sum(axis=1)  # chance of equal counts, per coordinate
    cost = {}
    for g in range(differ + 2, MAX_GROUPS + 1):
        chances = [float(np.prod(same[seg])) for seg in _groups(g)]
        meet = sum(np.prod(c) for c in itertools.combinations(chances, g - differ)) if comb(g, differ) <= 2000 else 0.0
        cost[g] = n * comb(g, differ) * POSTING_COST + n * n / 2 * meet * COMPARE_COST
    return min(cost, key=cost.get)


def _postings(nodes: DataFrame, g: int, differ: int) -> DataFrame:
    """``cell, print``: one row per fingerprint and choice of groups."""
    masks = _choices(g, differ)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = (np.arange(1, len(masks) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(prints), 1024):
                part = prints[at:at + 1024]
                h = (embed(part)[:, None] & masks) ^ salts
                for mult in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):  # a bijection: cells of one choice never merge
                    h = (h ^ (h >> np.uint64(33))) * np.uint64(mult)
                h ^= h >> np.uint64(33)
                yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(part.view(np.int64), len(masks)))], names=["cell", "print"])

    return nodes.select("print").mapInArrow(lean(run), "cell long, print long")


def _near(x: np.ndarray, y: np.ndarray, differ: int) -> np.ndarray:
    """Which of the pairs (x, y) differ in few bits: bound first, exactly where it allows."""
    ok = manhattan(embed(x), embed(y)) <= differ
    ok[ok] = np.bitwise_count(np.broadcast_to(x, ok.shape)[ok] ^ np.broadcast_to(y, ok.shape)[ok]) <= differ
    return ok


def _spanning(prints: np.ndarray, differ: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of one cell: each reached member is compared with those not reached."""
    out, rest = [], prints
    while len(rest):
        waiting, rest = [rest[0]], rest[1:]
        while waiting and len(rest):
            x = waiting.pop()
            ok = _near(x, rest, differ)
            if ok.any():
                found = rest[ok]
                out.append((np.full(len(found), x), found))
                waiting.extend(found)
                rest = rest[~ok]
    return out


def _links_in(cells: np.ndarray, prints: np.ndarray, differ: int) -> np.ndarray:
    """Links of whole cells, given sorted by cell; small cells are compared all at once."""
    n = len(cells)
    new = np.concatenate(([True], cells[1:] != cells[:-1]))
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    run = np.cumsum(new) - 1
    small = size <= 32
    found = []
    for d in range(1, int(size[small].max(initial=1))):
        i = np.flatnonzero((run[:-d] == run[d:]) & small[run[:-d]])
        ok = _near(prints[i], prints[i + d], differ)
        found.append((prints[i[ok]], prints[i[ok] + d]))
    for s, m in zip(start[~small], size[~small]):
        found.extend(_spanning(prints[s:s + m], differ))
    if not found:
        return np.zeros((0, 2), np.int64)
    pairs = np.stack([np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])], axis=1)
    return np.unique(np.sort(pairs.view(np.int64), axis=1), axis=0)


def _cell_links(postings: DataFrame, differ: int, cell: int) -> DataFrame:
    """``u, v``: spanning links of all cells. Cells of more than ``cell`` points are cut into blocks."""
    hot = postings.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell)
    hot = staged(hot.select("cell", F.ceil(F.col("n") / cell).cast("int").alias("blocks")), "hot")
    shared = postings.join(broadcast_if_small(hot, HOT_CELLS), "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    dealt = shared.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    # a pair of blocks meets in one task, with the links inside either
    dealt = dealt.filter((F.col("blocks") == 1) | (F.col("own") != F.col("other"))) \
        .select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "print")
    ordered = dealt.repartition("task").sortWithinPartitions("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def links(c, p):
            out = _links_in(c, p.view(np.uint64), differ)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["u", "v"])

        for batch in batches:
            held = [np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held)]
            if len(held[0]):
                whole = int(np.searchsorted(held[0], held[0][-1]))  # the last cell may go on; it has 2 * `cell` points at most
                if whole:
                    yield links(held[0][:whole], held[1][:whole])
                    held = [h[whole:] for h in held]
        if len(held[0]):
            yield links(*held)

    return ordered.mapInArrow(lean(run), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", differ: int = DIFFER, cell: int = CELL, groups: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id
    reachable by links of at most ``differ`` bits, the document's own included."""
    with small_batches(docs.sparkSession):
        prints = staged(fingerprints(docs, id_col, text_col), "prints")
    nodes = staged(prints.groupBy("print").agg(F.min("doc_id").alias("least_id")), "nodes")
    links = staged(_cell_links(_postings(nodes, groups or groups_by_cost(nodes, differ), differ), differ, cell), "links")
    comp = components(links).select(F.col("node").alias("print"), "component")
    named = nodes.join(comp, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    label = named.join(least, "component").select("print", "component_id")
    return prints.join(label, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
