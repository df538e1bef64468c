"""N-gram Jaccard join by size-aware heavy-light buckets, and the components of its links.

A document's set holds the distinct shingles of ``SHINGLE`` words. Sets link at
``100 * |A & B| >= SIMILARITY * |A | B|``; then the overlap is at least ``SIMILARITY`` percent of either
size, so the first ``a - need(a) + k`` elements of both, in any common order, share k of them.

* Order: elements with a high count last. Counts come from a count sketch of fixed size over *all*
  shingles; an estimate may change the order, never the result.
* Small sets (up to a boundary) enumerate the 2-subsets of their prefix (k = 2): one bucket per subset.
* Large sets scan inverted lists: one bucket per prefix element (k = 1). Small sets just below the
  boundary are entered in the lists too, so pairs across the boundary meet there.
* Boundary by cost: enumerated subsets against entries and expected list lengths, summed per size.

Equal sets are one node from the start, and within a bucket pairs are not emitted: first each node is
checked against one leader, the bucket member whose prefix is the most common (the middle of a family
of near copies); links merge nodes into components, and a bucket whose members are in one component is
done. In the others, tasks hold blocks of about ``BLOCK`` rows, compare members of different
components by a bit pattern of their prefixes that gives a safe upper bound of the overlap, and emit
only what the bound leaves. Candidates are verified on whole sets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import documents, lean, small_batches, spare, staged, text_or_empty
from tarmac.llm.components import components

SHINGLE = 5
SIMILARITY = 80
SKETCH = 1 << 20  # counters a row, two rows: 8 MB whatever the corpus
MAX_BOUNDARY = 64
BROADCAST_IDS = 1_000_000
BLOCK = 100_000
BITS = 1024
GROUP_ROWS = 20_000
_RNG = np.random.RandomState(20240229)
_BYTE = _RNG.randint(1, 2**62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C13 | 3  # odd, 3 modulo 8
_CHUNK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base & (2**64 - 1)
    return np.cumprod(out, dtype=np.uint64)


_POW, _INV = _powers(_P, _CHUNK), _powers(pow(_P, -1, 2**64), _CHUNK)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _word_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a text's bytes, A-Z as a-z."""
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if len(raw) <= _CHUNK:
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _POW[: len(raw)], out=total[1:])
        return _mix((total[end] - total[start]) * _INV[start] + (end - start).astype(np.uint64))
    out = np.empty(len(start), np.uint64)  # long text: the same sums, in runs of words
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _CHUNK, side="right")))
        piece = raw[start[i]: end[j - 1]]
        pw, inv = (_POW, _INV) if len(piece) <= _CHUNK else (_powers(_P, len(piece)), _powers(pow(_P, -1, 2**64), len(piece)))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * pw[: len(piece)], out=total[1:])
        s, e = start[i:j] - start[i], end[i:j] - start[i]
        out[i:j] = _mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingle_set(text: str, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle."""
    w = _word_hashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
    n = len(w)
    if n == 0:
        return w
    width = min(n, k)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = h * np.uint64(_P) + w[i: n - width + 1 + i]
    return np.unique(_mix(h))


def _need(size, percent: int):
    """Least overlap with any partner: ceil(percent / 100 * size)."""
    return -(-size * percent // 100)


def _slots(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64(SKETCH - 1)
    return (tokens & m).astype(np.int64), ((tokens >> np.uint64(24)) & m).astype(np.int64)


def count_sketch(rows: DataFrame) -> np.ndarray:
    """2 x SKETCH counts over every shingle of every row (``text``); tasks send compressed parts that add up."""
    blocks = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, SKETCH), np.uint32)
        held, n = [], 0

        def add_held():
            for r, slots in enumerate(_slots(np.concatenate(held))):
                table[r] += np.bincount(slots, minlength=SKETCH).astype(np.uint32)
            held.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(shingle_set(t))
                n += len(held[-1])
                if n >= SKETCH:
                    add_held()
                    n = 0
        if held:
            add_held()
        parts = table.reshape(blocks, -1)
        data = [zlib.compress(p.tobytes(), 1) if p.any() else None for p in parts]
        keep = [i for i, x in enumerate(data) if x]
        salt = [TaskContext.get().partitionId() % 64] * len(keep)
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array(salt, pa.int32()), pa.array([data[i] for i in keep], pa.binary())], names=["block", "salt", "part"])

    def add(key, batches):
        total = np.zeros(2 * SKETCH // blocks, np.uint32)
        for batch in batches:  # one batch of parts in memory at a time
            for x in batch.column("part").to_pylist():
                total += np.frombuffer(zlib.decompress(x), np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["block", "salt", "part"])

    # Spark reads the streaming form of a grouped function from its type hints
    add.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    schema = "block int, salt int, part binary"
    salted = rows.select("text").mapInArrow(lean(count), schema).groupBy("block", "salt").applyInArrow(add, schema)
    summed = salted.groupBy("block").applyInArrow(add, schema)
    table = np.zeros((blocks, 2 * SKETCH // blocks), np.uint32)
    for r in summed.collect():  # 16 rows, 8 MB before compression
        table[r.block] = np.frombuffer(zlib.decompress(r.part), np.uint32)
    return table.reshape(2, SKETCH)


def _sets(rows: DataFrame, sketch: np.ndarray, percent: int) -> DataFrame:
    """Per row: ``row``, doc_id, signature, size, ordered prefix, prefix fingerprint, bit pattern, list cost.

    ``row`` is unique and smaller for sets whose prefix elements are more common (16 bits of mean rank,
    then task and position), so the least row of a bucket is a good leader.
    """
    sc = rows.sparkSession.sparkContext
    noise = float(sketch[0].sum()) / SKETCH
    rank = np.minimum(255, np.floor(2 * np.log2(np.maximum(1, sketch)))).astype(np.uint8)  # half octaves
    shared = sc.broadcast((rank, noise))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "text_key", "sig", "size", "prefix", "finger", "bits", "scan"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, noise = shared.value
        serial = TaskContext.get().partitionId() << 24
        last = serial + (1 << 24)
        if last > 1 << 44:
            raise ValueError("row ids hold 2^20 tasks: read the documents in fewer partitions")
        for batch in batches:
            if serial + batch.num_rows > last:
                raise ValueError("row ids hold 2^24 rows a task: read the documents in more partitions")
            cols: list[list] = [[], [], [], [], [], [], []]
            for t in batch.column(1).to_pylist():
                s = shingle_set(t)
                a, b = _slots(s)
                est = np.minimum(rank[0][a], rank[1][b])
                keep = len(s) - _need(len(s), percent) + 2 if len(s) else 0
                order = np.lexsort((s, est))[:keep]
                prefix = s[order]
                lists = float(np.maximum(0.0, 2.0 ** (est[order].astype(float) / 2) - noise).sum())
                common = min(65535, int(1000 * est[order].mean())) if len(order) else 0
                cols[0].append((65535 - common) << 44 | serial)
                cols[1].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                cols[2].append(len(s))
                cols[3].append(prefix.tobytes())
                cols[4].append(np.sort((prefix >> np.uint64(48)).astype("<u2")).tobytes())
                pattern = np.zeros(BITS, bool)
                pattern[(prefix >> np.uint64(40)) % np.uint64(BITS)] = True
                cols[5].append(np.packbits(pattern).tobytes())
                cols[6].append(lists)
                serial += 1
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), batch.column(0), batch.column(2), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64()),
                                              pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.binary()), pa.array(cols[6], pa.float64())], names=names)

    return rows.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(lean(run), f"row long, doc_id {id_type}, text_key long, sig binary, size long, prefix binary, finger binary, bits binary, scan double")


def cost_boundary(nodes: DataFrame, percent: int = SIMILARITY) -> int:
    """The size up to which enumerating 2-subsets is cheaper in all than entering and scanning lists."""
    p = F.col("size") - F.ceil(F.col("size") * percent / 100) + 2
    rows = nodes.filter(F.col("size") <= MAX_BOUNDARY).groupBy("size").agg(F.sum(p * (p - 1) / 2).alias("light"), F.sum(p + F.col("scan")).alias("heavy")).collect()
    best, boundary, gain = 0.0, 0, 0.0
    for r in sorted(rows, key=lambda r: r["size"]):  # at most MAX_BOUNDARY rows
        gain += float(r.heavy) - float(r.light)
        if gain > best:
            best, boundary = gain, int(r["size"])
    return boundary


def _postings(nodes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """``key, node``: 2-subsets of small sets, elements of large and bordering ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, len(ids), 256):
                keys, owner = [], []
                for n, a, raw in zip(ids[at:at + 256], sizes[at:at + 256], batch.column(2).slice(at, 256).to_pylist()):
                    tokens = np.frombuffer(raw, np.uint64)
                    found = []
                    if a <= boundary:
                        i, j = np.triu_indices(len(tokens), 1)
                        lo, hi = np.minimum(tokens[i], tokens[j]), np.maximum(tokens[i], tokens[j])
                        found.append(_mix(lo * np.uint64(_P) + hi + np.uint64(1)))
                    if a * 100 > boundary * percent:  # a partner above the boundary is possible
                        found.append(tokens[:-1])
                    k = np.concatenate(found)
                    keys.append(k.view(np.int64))
                    owner.append(np.full(len(k), n))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owner))], names=["key", "node"])

    return nodes.select("node", "size", "prefix").mapInArrow(lean(run), "key long, node long")


def _possible(percent: int):
    """Keeps a pair unless the prefixes show that the overlap must be too small (never wrongly)."""

    @F.pandas_udf("boolean")
    def possible(fx: pd.Series, fy: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.ones(len(fx), bool)
        for i, (x, y, n, m) in enumerate(zip(fx, fy, a.to_numpy(), b.to_numpy())):
            x, y = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
            u, cx = np.unique(x, return_counts=True)
            v, cy = np.unique(y, return_counts=True)
            _, p, q = np.intersect1d(u, v, assume_unique=True, return_indices=True)
            common = int(np.minimum(cx[p], cy[q]).sum())  # at least the common prefix elements
            need = -(-percent * (n + m) // (100 + percent))
            out[i] = common + max(n - len(x), m - len(y)) >= need
        return pd.Series(out)

    return possible


def _linked(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """``u, v`` of the pairs (x, y) that link, verified on the whole sets."""
    facts = nodes.select("node", "size", "finger")
    side = lambda n: facts.select(F.col("node").alias(n), F.col("size").alias(f"{n}_size"), F.col("finger").alias(f"{n}_finger"))
    sized = pairs.join(side("x"), "x").join(side("y"), "y")
    sized = sized.filter(F.least("x_size", "y_size") * 100 >= F.greatest("x_size", "y_size") * percent)
    likely = staged(sized.filter(_possible(percent)("x_finger", "y_finger", "x_size", "y_size")).select("x", "y"), "pairs")

    # whole sets of the nodes concerned only, rebuilt from their texts
    asked = likely.select(F.col("x").alias("node"), F.lit(1).alias("as_x")).unionByName(likely.select(F.col("y").alias("node"), F.lit(0).alias("as_x"))) \
        .groupBy("node").agg(F.max("as_x").alias("as_x"), F.min("as_x").alias("only_x"))
    asked = staged(asked.join(nodes.select("node", F.col("doc_id").alias("d_id"), F.col("sig").alias("d_sig")), "node"), "asked")
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
            same = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() == sig for x, sig in zip(sets, batch.column(1).to_pylist())], pa.bool_())
            out = pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "as_x", "only_x", "elements"])
            yield out.filter(same)

    texts = rows.join(asked, rows["doc_id"].eqNullSafe(F.col("d_id"))).select("text", "d_sig", "node", "as_x", "only_x")
    full = staged(texts.mapInArrow(lean(run), "node long, as_x int, only_x int, elements binary"), "elements")

    @F.pandas_udf("boolean")
    def similar(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = np.zeros(len(xs), bool)
        for i, (x, y) in enumerate(zip(xs, ys)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out[i] = 100 * common >= percent * (len(x) + len(y) - common)
        return pd.Series(out)

    whole = likely.join(full.filter("as_x = 1").select(F.col("node").alias("x"), F.col("elements").alias("x_el")), "x") \
        .join(full.filter("only_x = 0").select(F.col("node").alias("y"), F.col("elements").alias("y_el")), "y")
    return staged(whole.filter(similar("x_el", "y_el")).select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), "links")


def _across(opened: DataFrame, percent: int) -> DataFrame:
    """``x, y`` (x < y): pairs of a bucket in different components that the bound leaves.

    Buckets with one leader are dealt together, so a pair that shares many of them is emitted once.
    A leader with up to BLOCK rows is one block; a larger one is cut into blocks of nodes whose pairs
    go to different tasks, so a task's memory does not grow with the bucket.
    """
    families = opened.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    groups = max(1, -(-opened.count() // GROUP_ROWS))
    dealt = opened.join(families, "lead").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "lead", "node", "size", "c", "bits", "prefix_size")
    dealt = dealt.withColumn("gid", F.pmod(F.xxhash64("lead", "lo", "hi"), F.lit(groups))).drop("lead")

    def pairs(table):
        col = {n: table.column(n).to_numpy() for n in ("key", "lo", "hi", "own", "node", "size", "c", "prefix_size")}
        order = np.lexsort((col["hi"], col["lo"], col["key"]))
        col = {n: v[order] for n, v in col.items()}
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)[order]
        hidden = col["prefix_size"] - np.bitwise_count(bits).sum(axis=1)  # prefix elements that share a bit
        rest = col["size"] - col["prefix_size"]
        n = len(order)
        new = np.concatenate(([True], (np.diff(col["key"]) != 0) | (np.diff(col["lo"]) != 0) | (np.diff(col["hi"]) != 0)))
        start = np.flatnonzero(new)
        stop = np.append(start[1:], n)
        run = np.cumsum(new) - 1
        found = []

        def test(i, j):
            a, b = col["size"][i], col["size"][j]
            ok = (col["c"][i] != col["c"][j]) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent)
            ok &= (col["lo"][i] == col["hi"][i]) | (col["own"][i] != col["own"][j])
            i, j, a, b = i[ok], j[ok], a[ok], b[ok]
            common = np.bitwise_count(bits[i] & bits[j]).sum(axis=1) + np.minimum(hidden[i], hidden[j])
            good = common + np.maximum(rest[i], rest[j]) >= -(-percent * (a + b) // (100 + percent))
            i, j = i[good], j[good]
            if len(i):
                found.append(np.stack((np.minimum(col["node"][i], col["node"][j]), np.maximum(col["node"][i], col["node"][j])), 1))

        small = (stop - start)[run] <= 64
        for d in range(1, min(64, n)):  # neighbours at distance d of all small buckets at once
            i = np.flatnonzero((run[:-d] == run[d:]) & small[:-d])
            if not len(i):
                break
            test(i, i + d)
        for s, e in zip(start, stop):
            if e - s > 64:
                for i in range(s, e - 1):
                    test(np.full(e - i - 1, i), np.arange(i + 1, e))
        out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"x": pa.array(out[:, 0], pa.int64()), "y": pa.array(out[:, 1], pa.int64())})

    return dealt.groupBy("gid").applyInArrow(pairs, "x long, y long").distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILARITY) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    ``component_id`` is the smallest id reachable by links, the document's own included. Null, empty
    and blank texts have an empty set and link with nothing. Equal sets link with each other. Rows that
    repeat an id are judged by their own text; a component of null ids only has a null id. An empty
    table gives no rows; other columns are ignored.
    """
    with small_batches(docs.sparkSession):  # every Python stage runs, and is written, inside
        return _similar_groups(docs, id_col, text_col, percent).select("doc_id", "n_shingles", "component_id")


def _similar_groups(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    rows = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    sets = staged(_sets(rows, count_sketch(rows), percent), "sets")
    held = sets.filter(F.col("size") > 0)
    reps = held.groupBy("sig").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"))
    nodes = staged(sets.join(reps.select("node"), sets["row"] == F.col("node"), "left_semi").withColumnRenamed("row", "node"), "nodes")
    boundary = cost_boundary(nodes, percent)

    postings = staged(_postings(nodes, boundary, percent), "postings")
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead")).filter(F.col("n") > 1)
    multi = staged(postings.join(shared.hint("shuffle_hash"), "key"), "buckets")

    # first: each node against the leader that it shares most buckets with
    votes = multi.filter(F.col("node") != F.col("lead")).groupBy("node", "lead").agg(F.count(F.lit(1)).alias("c"))
    pairs = votes.groupBy("node").agg(F.max(F.struct("c", "lead")).alias("b")).select(F.col("node").alias("x"), F.col("b.lead").alias("y"))
    links = _linked(pairs, nodes, rows, percent)
    comp = components(links)

    # then the buckets that still hold several components
    label = comp.select(F.col("node").alias("n_"), "component")
    tagged = multi.join(label, F.col("node") == F.col("n_"), "left").select("key", "node", "lead", F.coalesce("component", "node").alias("c"))
    open_keys = tagged.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter(F.col("lo") != F.col("hi")).select("key")
    opened = tagged.join(open_keys.hint("shuffle_hash"), "key")
    opened = staged(opened.join(nodes.select("node", "size", "bits", (F.octet_length("prefix") / 8).cast("long").alias("prefix_size")), "node"), "open")
    links = links.unionByName(_linked(_across(opened, percent), nodes, rows, percent))
    comp = components(links)

    best = reps.join(comp.select(F.col("node").alias("n_"), "component"), F.col("node") == F.col("n_"), "left") \
        .select("sig", "least_id", F.coalesce("component", "node").alias("component"))
    least = best.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = best.join(least, "component").select(F.col("sig").alias("s_sig"), "component", "component_id")
    out = held.join(named, held["sig"] == F.col("s_sig")).select("doc_id", F.col("size").alias("n_shingles"), "component_id", "text_key", "component")
    empty = sets.filter(F.col("size") == 0).select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_key", F.lit(None).cast("long").alias("component"))
    return out.unionByName(empty)


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILARITY) -> DataFrame:
    """One document of each group with the group's smallest id (others of the group go), with all its columns.

    A row is an id with its text: of rows that repeat an id, each is judged by its own text, and those that
    repeat both are one. A null id stays only where its group has no other. Documents without words stay.
    """
    with small_batches(docs.sparkSession):
        groups = staged(_similar_groups(docs, id_col, text_col, percent), "groups")
    names = spare(docs, "_id", "_null", "_text")
    key = lambda c, t: [F.coalesce(c.cast("string"), F.lit("")).alias(names[0]), c.isNull().alias(names[1]), t.alias(names[2])]
    first = groups.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("text_key").alias("t"))).alias("b"))
    stay = first.select(*key(F.col("b.id"), F.col("b.t"))).unionByName(groups.filter("component is null").select(*key(F.col("doc_id"), F.col("text_key")))).distinct()
    kept = docs.select("*", *key(docs[id_col], F.xxhash64(text_or_empty(docs, text_col)))).join(stay, names, "left_semi")
    return kept.dropDuplicates(names).drop(*names)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir))
