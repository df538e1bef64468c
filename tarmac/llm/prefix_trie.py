"""Prefix trie of conversations by a splitter skeleton.

A conversation is the sequence of its turns' 128-bit digests (role and text), its *path*; a trie node is
a prefix of a path, and its members are the conversations whose paths start with it.

* Splitters: paths drawn from a sample of bounded size, weighted by length, cut the sorted conversations
  into ranges of near-equal work. The conversation id breaks ties, so a group of equal conversations is
  cut as well.
* Skeleton: the trie of the splitters' paths, at most ``SKELETON`` nodes, is broadcast. Any other node is
  a prefix of no splitter, so all its members lie in one range.
* Ranges are sorted by path and id and read once with a stack of open nodes: a task holds one path, not
  a subtree. Nodes off the skeleton are finished there; for skeleton nodes each range gives one partial
  row (and pieces of the list of ends), which a reduction combines.
* Parents: a node's smallest member is known after its children are closed, so a second pass reads each
  range's nodes backwards.

Paths are held in blocks of ``BLOCK`` turns, so no row grows with its conversation: blocks are passed
from the deepest up, and a block's subtree sums are handed to the node that it hangs from. The number
of passes is the longest conversation divided by ``BLOCK``, usually one. Turns are numbered in
range-partitioned order with offsets per partition, so a conversation that holds a large share of all
turns is spread over tasks as well.

Results for special input: null role or text count as empty; turns with equal ``turn`` (null first) are
ordered by role, then text; repeated rows are repeated turns. Rows without ``conv_id`` belong to no
conversation and are left out. Other columns are ignored, whatever their names. Without conversations
there are no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.llm.common import lean, small_batches, staged

SHARED_EVERY = 20  # conversations that take over turns of the same one
BLOCK = 1024  # turns a row
SKELETON = 100_000  # nodes broadcast
RANGE_TURNS = 250_000  # aimed at per range
MAX_RANGES = 4096
SAMPLE_BYTES = 32 << 20
ENDS_CHUNK = 50_000  # ids in a piece of a list of ends
ID = 16  # bytes of a digest

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PASS = ("kind int, shard int, seq long, depth long, conv_id long, parent_skel int, skel int, up binary, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string, next binary, words long, g_children long, g_leaves long, g_saved long, ends string")
_NODE, _PARTIAL, _ENDS, _GRAFT = range(4)


def _numbered(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, words``: turns numbered from 1 in each conversation.

    Partitions hold ranges of (conv_id, turn, role, text); only a conversation that began in an earlier
    partition needs an offset, one row a partition.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"),
                                                             F.monotonically_increasing_id().alias("row"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("row")]
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 2 * ID))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", digest.alias("digest"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            c = batch.column(0).to_numpy()
            if not len(c):
                continue
            start = np.concatenate(([0], np.flatnonzero(np.diff(c)) + 1))
            pos = np.arange(1, len(c) + 1) - np.repeat(start, np.diff(np.append(start, len(c))))
            if c[0] == last:
                pos[: start[1] if len(start) > 1 else len(c)] += at
            last, at = c[-1], pos[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pos, pa.int64()), pa.array(np.full(len(c), part), pa.int32())], names=["conv_id", "digest", "words", "local", "part"])

    own = staged(ordered.mapInArrow(lean(number), "conv_id long, digest binary, words long, local long, part int"), "turns")
    held = own.groupBy("conv_id", "part").agg(F.max("local").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.withColumn("offset", F.sum("n").over(before)).filter("offset > 0").select("conv_id", "part", "offset")
    # at most one conversation of a partition began before it: one row a partition
    return own.join(F.broadcast(offsets), ["conv_id", "part"], "left").select("conv_id", (F.col("local") + F.coalesce("offset", F.lit(0))).alias("pos"), "digest", "words")


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes over: 0 to 3."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, block, path, words, ends``: each conversation's rebuilt path in blocks.

    The first ``shared_turns`` come from conversation c - c % 20, the rest are its own after as many.
    """
    own = _numbered(turns)
    sizes = staged(own.groupBy("conv_id").agg(F.max("pos").alias("n")), "conversations")
    convs = sizes.withColumn("h", shared_turns(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED_EVERY)
    convs = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    heads = own.filter((F.col("conv_id") % SHARED_EVERY == 0) & (F.col("pos") <= 3)).withColumnRenamed("conv_id", "base")
    first = convs.filter("h > 0").join(heads, "base").filter("pos <= h").select("conv_id", "pos", "digest", "words")
    rest = own.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    blocks = first.unionByName(rest).withColumn("block", F.floor((F.col("pos") - 1) / block)) \
        .groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "words"))).alias("t"))  # at most `block` turns
    filled = blocks.join(convs.select("conv_id", "total"), "conv_id").select(
        "conv_id", "block", F.unhex(F.array_join(F.transform("t.digest", F.hex), "")).alias("path"), F.col("t.words").alias("words"), (F.col("block") * block + F.size("t") == F.col("total")).alias("ends"))
    empty = convs.filter("total = 0").select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("path"), F.expr("cast(array() as array<long>)").alias("words"), F.lit(True).alias("ends"))
    return filled.unionByName(empty)


def _linked_blocks(rows: DataFrame) -> DataFrame:
    """Adds ``entry``, a digest of all blocks before, and ``next``, one of all blocks so far where the conversation goes on."""
    part = F.unhex(F.substring(F.sha2("path", 256), 1, 2 * ID))
    w = Window.partitionBy("conv_id").orderBy("block")
    chain = lambda frame: F.unhex(F.substring(F.sha2(F.array_join(F.transform(F.collect_list(part).over(frame), F.hex), ""), 256), 1, 2 * ID))
    entry = F.when(F.col("block") > 0, chain(w.rowsBetween(Window.unboundedPreceding, -1)))
    after = F.when(~F.col("ends"), chain(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("*", entry.alias("entry"), after.alias("next"))


def _splitters(rows: DataFrame, skeleton: int, ranges: int | None) -> list[tuple[bytes, int]]:
    """Sorted (key, conv_id): quantiles by path length of a sample of at most about SAMPLE_BYTES."""
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("key"))).first()
    if not n:
        return []
    spark = rows.sparkSession
    ranges = ranges or min(MAX_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (n + (size or 0) // ID) // RANGE_TURNS))
    part = min(1.0, 32 * ranges / n, SAMPLE_BYTES / max(1, size or 0))
    drawn = rows.select("key", "conv_id")
    drawn = sorted((bytes(r.key), r.conv_id) for r in (drawn if part == 1.0 else drawn.sample(part, 42)).collect())
    weight = np.cumsum([len(k) // ID + 1 for k, _ in drawn]) if drawn else np.zeros(0)
    at = np.searchsorted(weight, weight[-1] * np.arange(1, ranges) / ranges) if drawn else []
    picked = [drawn[i] for i in sorted(set(map(int, at)))]
    total = sum(len(k) // ID + 1 for k, _ in picked)
    return picked[:: -(-total // skeleton)] if total > skeleton else picked


def _read_ranges(skel: dict[bytes, int], lift: int, hung: bool):
    """The sorted pass: finished nodes, partial rows of skeleton nodes and pieces of their ends.

    A prefix of n elements has depth ``lift`` + n. In blocks below the first (``hung``) the first element
    stands for the node that the block hangs from (a graft), and the empty prefix for nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq = TaskContext.get().partitionId(), 0
        path, stack, out = b"", [], []
        none = hashlib.sha256().hexdigest()

        def opened(n: int, words: int) -> dict:
            key = path[: n * ID]
            return {"at": n, "skel": skel.get(key, -1), "n": 0, "min": None, "children": 0, "leaves": 0, "saved": 0, "words": words, "sha": None, "ids": [], "next": None, "g": (0, 0, 0)}

        def flush(node: dict) -> None:
            if node["ids"]:
                out.append((_ENDS, None, None, None, node["ids"][0], None, node["skel"], None, None, None, None, None, None, None, None, None, None, None, ",".join(map(str, node["ids"]))))
                node["ids"] = []

        def close() -> None:
            nonlocal seq
            node = stack.pop()
            up = stack[-1] if stack else None
            if up is not None:
                up["n"] += node["n"]
                up["min"] = node["min"] if up["min"] is None or node["min"] < up["min"] else up["min"]
            if node["skel"] >= 0:
                flush(node)
                out.append((_PARTIAL, None, None, None, node["min"], None, node["skel"], None, node["n"], node["children"], node["leaves"], node["saved"], None, node["next"], node["words"], *node["g"], None))
                return
            children = node["children"] + node["g"][0]
            leaves = node["leaves"] + node["g"][1] if children else 1
            saved = node["saved"] + node["g"][2] + (node["n"] - 1) * node["words"]
            up["children"] += 1  # every node off the skeleton has a parent: the empty prefix is on it
            up["leaves"] += leaves
            up["saved"] += saved
            seq += 1
            graft = hung and node["at"] == 1
            out.append((_GRAFT if graft else _NODE, shard, seq, lift + node["at"], node["min"], up["skel"], None, path[:ID] if hung and node["at"] <= 2 else None, node["n"], children, leaves, saved,
                        node["sha"].hexdigest() if node["sha"] else none, node["next"], None, None, None, None, None))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[]] * len(_SCHEMA)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)

        for batch in batches:
            for key, words, conv, ends, after, *graft in zip(*(batch.column(i).to_pylist() for i in range(8))):
                shared, most = 0, min(len(key), len(path)) // ID
                while shared < most and key[shared * ID: (shared + 1) * ID] == path[shared * ID: (shared + 1) * ID]:
                    shared += 1
                while len(stack) > shared + 1:
                    close()
                path = key
                for n in range(len(stack), len(key) // ID + 1):
                    stack.append(opened(n, words[n - 1] if n else 0))
                top = stack[-1]
                top["n"] += 1
                top["min"] = conv if top["min"] is None or conv < top["min"] else top["min"]
                if not ends:
                    top["next"], top["g"] = after, tuple(graft)
                elif top["skel"] >= 0:
                    top["ids"].append(conv)
                    if len(top["ids"]) >= ENDS_CHUNK:
                        flush(top)
                elif top["sha"] is None:
                    top["sha"] = hashlib.sha256(str(conv).encode())
                else:
                    top["sha"].update(f",{conv}".encode())
                if len(out) >= 10_000:
                    yield batch_of()
        while stack:
            close()
        yield batch_of()

    return run


_SCHEMA = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[kind]) for name, kind in (c.split() for c in PASS.split(", "))])


def _ends_digests(pieces: DataFrame) -> dict[int, str]:
    """SHA-256 of each skeleton node's ends: its pieces are read in order of their first ids, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []
        for batch in batches:
            for skel, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if skel != now:
                    if sha is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = skel, hashlib.sha256(ends.encode())
                else:
                    sha.update(b"," + ends.encode())
        if sha is not None:
            out.append((now, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.string())], names=["skel", "sha"])

    ordered = pieces.select("skel", "ends", "conv_id").repartition("skel").sortWithinPartitions("skel", "conv_id").select("skel", "ends")
    return {r.skel: r.sha for r in ordered.mapInArrow(lean(run), "skel int, sha string").collect()}


def _with_parents(nodes: DataFrame, shards: int, skeleton: dict[int, int]) -> DataFrame:
    """``parent_conv_id`` of finished nodes: read backwards, a node's parent comes before it."""
    cols = ["depth", "conv_id", "parent_skel", "up", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}
        for batch in batches:
            found = []
            for depth, conv, skel in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found.append(skeleton.get(skel) if skel >= 0 else above.get(depth - 1))
                above[depth] = conv
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[*cols, "parent_conv_id"])

    ordered = nodes.repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col("seq").desc()).select(*cols)
    return ordered.mapInArrow(lean(run), "depth long, conv_id long, parent_skel int, up binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, next binary, parent_conv_id long")


def _pass(rows: DataFrame, lift: int, hung: bool, skeleton: int, ranges: int | None) -> tuple[DataFrame, DataFrame]:
    """(nodes, grafts) of one block: ``rows`` has key, words, conv_id, ends, next, g_children, g_leaves, g_saved."""
    spark = rows.sparkSession
    cuts = _splitters(rows, skeleton, ranges)
    names = sorted({k[: i * ID] for k, _ in cuts for i in range(len(k) // ID + 1)} | {b""}, key=lambda k: (len(k), k))
    skel = {k: i for i, k in enumerate(names)}
    shared = spark.sparkContext.broadcast((cuts, skel))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value[0]
        for batch in batches:
            at = [bisect_right(cuts, x) for x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], names=[*batch.schema.names, "shard"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _read_ranges(shared.value[1], lift, hung)(batches)

    given = ["key", "words", "conv_id", "ends", "next", "g_children", "g_leaves", "g_saved"]
    kinds = "key binary, words array<long>, conv_id long, ends boolean, next binary, g_children long, g_leaves long, g_saved long"
    dealt = rows.select(*given).mapInArrow(lean(deal), f"{kinds}, shard int").repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("key", "conv_id")
    done = staged(dealt.select(*given).mapInArrow(lean(read), PASS), "trie")

    sums = done.filter(F.col("kind") == _PARTIAL).groupBy("skel").agg(
        F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"), F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        F.max("words").alias("words"), F.max("next").alias("next"), F.max("g_children").alias("gc"), F.max("g_leaves").alias("gl"), F.max("g_saved").alias("gs"))
    facts = {r.skel: r.asDict() for r in sums.collect()}  # at most `skeleton` rows
    ends = _ends_digests(done.filter(F.col("kind") == _ENDS))
    for i in sorted(facts, reverse=True):  # longer prefixes first
        f, k = facts[i], names[i]
        f["children"] += f["gc"]
        f["leaves"] = f["leaves"] + f["gl"] if f["children"] else 1
        f["saved"] += f["gs"] + (f["n"] - 1) * f["words"]
        if k:
            up = facts[skel[k[:-ID]]]
            up["children"], up["leaves"], up["saved"] = up["children"] + 1, up["leaves"] + f["leaves"], up["saved"] + f["saved"]
    nodes, grafts = [], []
    none = hashlib.sha256().hexdigest()
    for i, f in facts.items():
        k = names[i]
        n = len(k) // ID
        if hung and n <= 1:
            if n:
                grafts.append((k, f["children"], f["leaves"], f["saved"]))
            continue
        up = facts[skel[k[:-ID]]]["least"] if k and not (hung and n == 2) else None
        nodes.append((lift + n, f["least"], up, f["n"], f["children"], f["leaves"], f["saved"], ends.get(i, none), f["next"], k[:ID] if hung and n == 2 else None))
    fields = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, next binary, up binary"
    order = [c.split()[0] for c in fields.split(", ")]
    local = _with_parents(done.filter(F.col("kind") == _NODE), len(cuts) + 1, {i: f["least"] for i, f in facts.items()}).select(*order)
    local = local.withColumn("parent_conv_id", F.when(F.col("up").isNull(), F.col("parent_conv_id")))
    finished = done.filter(F.col("kind") == _GRAFT).select("up", "n_children", "n_leaves", "saved_tokens")
    hung = finished.unionByName(spark.createDataFrame(grafts, "up binary, n_children long, n_leaves long, saved_tokens long"))
    return local.unionByName(spark.createDataFrame(nodes, fields)), hung.toDF("next", "g_children", "g_leaves", "g_saved")


def prefix_trie(turns: DataFrame, block: int = BLOCK, skeleton: int = SKELETON, ranges: int | None = None) -> DataFrame:
    """One row per trie node of the rebuilt conversations (``conv_id, turn, role, text``); see ``NODE``.

    ``conv_id`` is the smallest member, ``ends_sha256`` the digest of the sorted, comma-joined ids of the
    conversations that end there, ``saved_tokens`` the words that storing each node once would save.
    """
    spark = turns.sparkSession
    with small_batches(spark, 2000):
        rows = staged(rebuilt(turns, block), "paths")
        deepest = rows.agg(F.max("block")).first()[0]
        if deepest is None:
            return spark.createDataFrame([], NODE)
        if deepest:
            rows = staged(_linked_blocks(rows), "chained")
        else:
            rows = rows.withColumns({"entry": F.lit(None).cast("binary"), "next": F.lit(None).cast("binary")})
        found, grafts = [], None
        for k in range(int(deepest), -1, -1):
            here = rows.filter(F.col("block") == k)
            if k:
                here = here.withColumns({"path": F.concat("entry", "path"), "words": F.concat(F.array(F.lit(0).cast("long")), F.col("words"))})
            here = here.select(F.col("path").alias("key"), "words", "conv_id", "ends", "next")
            if grafts is None:
                here = here.withColumns({c: F.lit(0).cast("long") for c in ("g_children", "g_leaves", "g_saved")})
            else:
                here = here.join(grafts, "next", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("g_children", "g_leaves", "g_saved")})
            nodes, grafts = _pass(here, k * block - 1 if k else 0, k > 0, skeleton, ranges)
            grafts = staged(grafts, "grafts") if k else None
            found.append((k, staged(nodes, "nodes") if deepest else nodes))
    out = None
    for k, nodes in found:
        if k:  # the nodes on top of a block hang from a node of the block above
            above = next(n for i, n in found if i == k - 1).filter(F.col("next").isNotNull()).select(F.col("next").alias("up"), F.col("conv_id").alias("hung_from"))
            nodes = nodes.join(above, "up", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "hung_from"))
        nodes = nodes.select(*(c.split()[0] for c in NODE.split(", ")))
        out = nodes if out is None else out.unionByName(nodes)
    return out


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The low bits of a CRC-32 come from its bitwise definition (reflected, polynomial EDB88320).
SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, max(pos) AS n FROM t GROUP BY conv_id),
h AS (SELECT conv_id, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [unicode(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda crc, b: CASE WHEN (xor(crc, b) & 1) = 1 THEN xor(xor(crc, b) >> 1, 3988292384) ELSE xor(crc, b) >> 1 END) AS low FROM n),
c AS (SELECT n.conv_id, n.n, (3 - low % 4) AS h, n.conv_id - n.conv_id % 20 AS base FROM n JOIN h USING (conv_id)),
f AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS taken FROM c LEFT JOIN n b ON b.conv_id = c.base),
r AS (SELECT f.conv_id, t.pos, role, text FROM f JOIN t ON t.conv_id = f.base AND t.pos <= f.h
  UNION ALL SELECT f.conv_id, t.pos - f.h + f.taken, role, text FROM f JOIN t ON t.conv_id = f.conv_id AND t.pos > f.h),
p AS (SELECT conv_id, pos AS depth, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS path,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM f),
k AS (SELECT conv_id, depth, sha256(path) AS node, lag(sha256(path)) OVER (PARTITION BY conv_id ORDER BY depth) AS up, words, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
g AS (SELECT node, any_value(depth) AS depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM k GROUP BY node),
ch AS (SELECT up AS node, count(*) AS n_children FROM g GROUP BY up),
own AS (SELECT g.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * words AS saved FROM g LEFT JOIN ch USING (node)),
sub AS (SELECT a.node, sum((o.n_children = 0)::INT) AS n_leaves, sum(o.saved) AS saved_tokens FROM own o JOIN k a ON a.conv_id = o.conv_id AND a.depth <= o.depth GROUP BY a.node)
SELECT own.conv_id, own.depth, u.conv_id AS parent_conv_id, own.n_convs, own.n_children, sub.n_leaves::BIGINT AS n_leaves, sub.saved_tokens::BIGINT AS saved_tokens, sha256(own.ids) AS ends_sha256
FROM own JOIN sub USING (node) LEFT JOIN own u ON u.node = own.up
"""
