"""Token-id files: static range asymmetric numeral system (rANS) in independent interleaved blocks.

Documents are range-partitioned and sorted by id; each task cuts its ids into frames of about
``FRAME`` ids (whole documents). A frame holds one frequency table shared by its blocks, and per block
of ``BLOCK`` ids a checkpoint (the decoder's lane states and the place of its words), a crc32 of its
ids, and its words. Blocks decode independently; inside a block ``LANES`` coders take turns, so
encoding and decoding run vectorised over all lanes of all blocks of a frame. Frames are binary values
of a Parquet table in the shared folder, next to the documents' ids and lengths, so every store that
Spark can write works and a lost task rewrites its own part only.

Frame layout, little endian: magic ``RANS``, version, scale bits, lanes (u32 each), number of ids,
ids per block (u64), number of symbols, length of the packed table (u32); the zlib-packed table of
u32 frequencies; per block: number of words u32, crc32 u32, lane states u64; then all words u32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tarmac.llm.common import documents, lean, splitter, staged, text_or_empty

SCALE = 20  # frequencies add up to 2 ** SCALE
LANES = 64
BLOCK = 1 << 16
FRAME = 1 << 22
MEMO_ENTRIES = 1_200_000
_LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4sIIIQQII")


def _frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to add up to 2 ** SCALE; every present symbol keeps at least 1."""
    total, room = int(counts.sum()), 1 << SCALE
    f = np.where(counts > 0, np.maximum(1, counts * room // max(1, total)), 0).astype(np.int64)
    over = int(f.sum()) - room
    if over < 0:
        f[int(np.argmax(counts))] -= over
    while over > 0:  # rounding up of rare symbols is paid by the frequent ones
        i = int(np.argmax(f))
        cut = min(over, max(1, int(f[i]) // 2))
        f[i] -= cut
        over -= cut
    return f


def encode_frame(ids: np.ndarray, block: int = BLOCK, lanes: int = LANES) -> bytes:
    n = len(ids)
    block = min(block, -(-max(1, n) // lanes) * lanes)
    blocks, steps = -(-n // block), block // lanes
    padded = np.full(blocks * block, ids[0] if n else 0, np.int64)
    padded[:n] = ids
    counts = np.bincount(padded) if n else np.zeros(0, np.int64)
    freq = _frequencies(counts) if n else counts
    first = np.concatenate([[0], np.cumsum(freq)])[:-1].astype(np.uint64) if n else counts
    f64 = freq.astype(np.uint64)
    grid = padded.reshape(blocks, steps, lanes)
    x = np.full((blocks, lanes), _LOW, np.uint64)
    words, sent = np.zeros((steps, blocks, lanes), np.uint32), np.zeros((steps, blocks, lanes), bool)
    for t in range(steps - 1, -1, -1):  # coding runs backwards, so that decoding runs forwards
        f = f64[grid[:, t]]
        m = x >= (f << np.uint64(63 - SCALE))
        words[t], sent[t] = x & np.uint64(0xFFFFFFFF), m
        x = np.where(m, x >> np.uint64(32), x)
        q = x // f
        x = (q << np.uint64(SCALE)) + (x - q * f) + first[grid[:, t]]
    table = zlib.compress(freq.astype("<u4").tobytes(), 6)
    out = [_HEAD.pack(b"RANS", 1, SCALE, lanes, n, block, len(freq), len(table)), table]
    streams = []
    for b in range(blocks):
        w = words[:, b][sent[:, b]]
        streams.append(w.astype("<u4").tobytes())
        out.append(struct.pack("<II", len(w), zlib.crc32(ids[b * block:(b + 1) * block].astype("<u4").tobytes())) + x[b].astype("<u8").tobytes())
    return b"".join(out + streams)


def decode_frame(data: bytes, only: range | None = None) -> np.ndarray:
    """The ids of a frame, or of the blocks ``only``; raises ValueError where a checksum differs."""
    magic, version, scale, lanes, n, block, symbols, size = _HEAD.unpack_from(data)
    if magic != b"RANS" or version != 1:
        raise ValueError("not a token frame")
    if not n:
        return np.zeros(0, np.uint32)
    at = _HEAD.size
    freq = np.frombuffer(zlib.decompress(data[at:at + size]), "<u4")
    at += size
    count, steps = -(-n // block), block // lanes
    index = np.frombuffer(data, np.dtype([("words", "<u4"), ("crc", "<u4"), ("x", "<u8", (lanes,))]), count, at)
    at += index.nbytes
    place = np.concatenate([[0], np.cumsum(index["words"].astype(np.int64))])
    chosen = np.arange(count)[only.start:only.stop] if only is not None else np.arange(count)
    words = np.append(np.frombuffer(data, "<u4", int(place[-1]), at), np.uint32(0)).astype(np.uint64)
    owner = np.repeat(np.arange(symbols, dtype=np.int64), freq)
    f64, first = freq.astype(np.uint64), np.concatenate([[0], np.cumsum(freq, dtype=np.uint64)])[:-1].astype(np.uint64)
    x = index["x"][chosen].astype(np.uint64)
    nxt = place[chosen].copy()
    out = np.empty((len(chosen), steps, lanes), np.uint32)
    mask = np.uint64((1 << scale) - 1)
    for t in range(steps):
        slot = x & mask
        s = owner[slot.astype(np.int64)]
        out[:, t] = s
        x = f64[s] * (x >> np.uint64(scale)) + slot - first[s]
        m = x < _LOW
        rank = np.cumsum(m, axis=1)
        w = words[np.minimum(nxt[:, None] + rank - 1, len(words) - 1)]
        x = np.where(m, (x << np.uint64(32)) | w, x)
        nxt += rank[:, -1]
    parts = [o.reshape(-1)[: min(block, n - b * block)] for b, o in zip(chosen.tolist(), out)]
    for b, p in zip(chosen.tolist(), parts):
        if zlib.crc32(p.astype("<u4").tobytes()) != int(index["crc"][b]):
            raise ValueError(f"block {b}: checksum differs")
    return np.concatenate(parts)


#: Byte -> character of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes
#: for U+0100 onwards in ascending order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = iter(range(256, 512))
_BYTE_CHARS = "".join(chr(b if b in _PRINTABLE else next(_OTHERS)) for b in range(256))
_ID = attrgetter("id")


class _Memo(dict):
    """Pre-token -> ids as u32 bytes, from the library's model; emptied when full."""

    def __init__(self, model):
        self.tokenize = model.tokenize

    def __missing__(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            tokens = self.tokenize(word.replace(" ", _BYTE_CHARS[32]))
        else:
            tokens = self.tokenize(word.encode().decode("latin-1").translate(_BYTE_CHARS))
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[word] = out = struct.pack(f"<{len(tokens)}I", *map(_ID, tokens))
        return out


class _Encoder:
    """A byte-level BPE of the tokenizers library (no normalizer, no prefix space). Such a model never
    merges across pre-tokens, so each distinct one goes through the model once per memo; a text that
    spells out an added token goes through the library whole, which cuts it there. The memo belongs to a
    worker's copy of the broadcast and goes with it."""

    def __init__(self, tokenizer_json: str, pattern: str):
        self.json, self.pattern, self.ready = tokenizer_json, pattern, None

    def tools(self):
        if self.ready is None:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_str(self.json)
            added = [t.content for t in whole.get_added_tokens_decoder().values()]
            self.ready = whole, added, _Memo(whole.model), splitter(self.pattern)
        return self.ready

    def encode(self, text: str) -> bytes:
        whole, added, memo, split = self.tools()
        if any(a in text for a in added):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(memo.__getitem__, split(text)))


def write_token_files(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Encode, append ``end_id`` to each document and write frames in ascending id order; the table
    ``part, frame, payload, doc_ids, lengths``. Null ids come first; equal ids are ordered by text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(_Encoder(model, pattern))
    id_type = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(docs, text_col)
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = shared.value.encode
        part, frame, held, ids, docs_in = TaskContext.get().partitionId(), 0, 0, [], []

        def close():
            every = np.frombuffer(b"".join(ids), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([frame], pa.int32()), pa.array([encode_frame(every)], pa.binary()),
                                               pa.array([docs_in], pa.list_(kind)), pa.array([[len(x) // 4 for x in ids]], pa.list_(pa.int64()))],
                                              names=["part", "frame", "payload", "doc_ids", "lengths"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for doc_id, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    ids.append(encode(t) + end)
                    docs_in.append(doc_id)
                    held += len(ids[-1]) // 4
                    if held >= FRAME:
                        yield close()
                        frame, held, ids, docs_in = frame + 1, 0, [], []
        if ids:
            yield close()

    return staged(ordered.mapInArrow(lean(run), f"part int, frame int, payload binary, doc_ids array<{id_type}>, lengths array<long>"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Decode every frame: ``doc_id, start, n_tokens, ids_crc32``; a block whose checksum differs raises."""
    id_type = files.schema["doc_ids"].dataType.elementType.simpleString()
    total = files.select("part", "frame", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))
    parts = total.groupBy("part").agg(F.sum("n").alias("pn"))
    before = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("pn").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("p0"))
    inside = W.partitionBy("part").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)
    offsets = total.withColumn("f0", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, F.col("part") == F.col("p")) \
        .select(F.col("part").alias("o_part"), F.col("frame").alias("o_frame"), (F.col("p0") + F.col("f0")).alias("first"))
    placed = files.join(F.broadcast(offsets), (F.col("part") == F.col("o_part")) & (F.col("frame") == F.col("o_frame"))) if offsets.limit(100_001).count() <= 100_000 \
        else files.join(offsets, (F.col("part") == F.col("o_part")) & (F.col("frame") == F.col("o_frame")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, doc_ids, lengths, first in zip(*(c.to_pylist() if i else c for i, c in enumerate(batch.columns))):
                ids = decode_frame(payload.as_py())
                ends = np.cumsum(np.array(lengths, np.int64))
                starts = ends - np.array(lengths, np.int64)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                for k in range(0, len(doc_ids), 2048):
                    j = slice(k, k + 2048)
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[j], batch.schema.field(1).type.value_type), pa.array(starts[j] + first), pa.array(np.array(lengths[j], np.int64)), pa.array(crc[j], pa.int64())],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("payload", "doc_ids", "lengths", "first").mapInArrow(lean(run), f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text counts as empty (one end id); rows that repeat an id are written each; no rows, no frames."""
    import public_tokenizers

    return read_token_files(write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))
