"""Byte-level BPE over whole texts: two-tier encoding and decoding.

Tier 1: a minimal perfect hash (hash and displace) over the vocabulary resolves a pre-token that is
itself a token: one hash, one slot, one comparison. Tier 2: other pre-tokens are merged with a heap of
(rank, position) over linked bytes, O(n log n) for any length. A bounded memo in front of both keeps
the ids of recent pre-tokens; it goes when the worker turns to another job. The vocabulary (its size is the only thing that is broadcast) comes from
a rank file whose path is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from tarmac.llm.common import documents, lean, splitter, text_or_empty

MEMO_ENTRIES = 600_000
PART = 512  # rows per output batch: bounds a worker's memory


def load_ranks(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_PRIME = (1 << 31) - 1


def _steps(h: int) -> tuple[int, int]:
    """A key's first place and its step, from the high bits of its hash."""
    return (h >> 12) % _PRIME, 1 + (h >> 33) % (_PRIME - 1)


class PerfectHash:
    """Minimal perfect hash: n keys, n slots; a bucket's displacement moves its keys to free slots."""

    def __init__(self, ranks: dict[bytes, int], per_bucket: int = 4):
        n = max(1, len(ranks))
        self.n, self.m = n, n // per_bucket + 1
        buckets: dict[int, list[bytes]] = {}
        for key in ranks:
            buckets.setdefault(xxhash.xxh3_64_intdigest(key) % self.m, []).append(key)
        self.shift = [0] * self.m
        self.keys: list[bytes | None] = [None] * n
        self.ids = [-1] * n
        free = np.ones(n, bool)
        for b, keys in sorted(buckets.items(), key=lambda kv: -len(kv[1])):
            if len(keys) == 1:
                continue
            a, c = np.array([_steps(xxhash.xxh3_64_intdigest(k)) for k in keys], dtype=np.int64).T
            at, width, found = 0, 16, None
            while found is None:
                slots = (a + np.arange(at, at + width)[:, None] * c) % _PRIME % n
                for d in np.flatnonzero(free[slots].all(axis=1)).tolist():
                    if len(set(row := slots[d].tolist())) == len(keys):
                        found = at + d, row
                        break
                at, width = at + width, min(8192, 2 * width)
            self.shift[b] = found[0]
            for key, slot in zip(keys, found[1]):
                self.keys[slot], self.ids[slot], free[slot] = key, ranks[key], False
        left = iter(np.flatnonzero(free).tolist())
        for b, keys in buckets.items():
            if len(keys) == 1:  # a lone key takes any free slot, named directly
                slot = next(left)
                self.shift[b] = -slot - 1
                self.keys[slot], self.ids[slot] = keys[0], ranks[keys[0]]

    def get(self, key: bytes) -> int:
        """The key's id, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.m]
        if d < 0:
            slot = -d - 1
        else:
            a, c = _steps(h)
            slot = (a + d * c) % _PRIME % self.n
        return self.ids[slot] if self.keys[slot] == key else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Lowest rank first, leftmost on ties; ``end[i]`` links the part at i to the next one."""
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != e:
            continue  # one of the two parts has grown or gone since
        end[i], alive[j], before[e] = e, False, i
        if e < n and (r := ranks.get(piece[i:end[e]])) is not None:
            heapq.heappush(heap, (r, i, end[e]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
            heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class _Memo(dict):
    """Pre-token -> its ids as int32 bytes; emptied when full."""

    def __init__(self, table: PerfectHash, ranks: dict[bytes, int], limit: int = MEMO_ENTRIES):
        self.table, self.ranks, self.limit = table, ranks, limit

    def __missing__(self, word: str) -> bytes:
        key = word.encode("utf-8", "surrogatepass")
        one = self.table.get(key)
        out = np.array([one] if one >= 0 else merge_bytes(key, self.ranks), "<i4").tobytes()
        if len(self) >= self.limit:
            self.clear()
        self[word] = out
        return out


class _Encoder:
    """What an encoding task needs, broadcast once. The memo belongs to a worker's copy of the broadcast:
    tasks of the same job find it filled, and Spark drops it with the copy when the worker moves on."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.table, self.ready = ranks, pattern, PerfectHash(ranks), None

    def tools(self) -> tuple[_Memo, Callable[[str], list[str]]]:
        if self.ready is None:
            self.ready = _Memo(self.table, self.ranks), splitter(self.pattern)
        return self.ready

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text) to (doc_id, token_ids, ids_sha256)."""
        memo, split = self.tools()
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                ids = [np.frombuffer(b"".join(map(memo.__getitem__, split(t))), "<i4") for t in part.column(1).to_pylist()]
                sha = [hashlib.sha256(" ".join(map(str, x.tolist())).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), _list_array(ids, pa.int32()), pa.array(sha)], names=["doc_id", "token_ids", "ids_sha256"])


class _Decoder:
    """The bytes of every id, end to end, and where each begins."""

    def __init__(self, ranks: dict[bytes, int]):
        pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, r in ranks.items():
            pieces[r] = piece
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def text_of(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        to = np.cumsum(n)
        return self.flat[np.repeat(self.first[ids] - to + n, n) + np.arange(to[-1] if len(to) else 0)].tobytes()

    def run(self, batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        """Adds ``decoded`` to batches whose column ``at`` holds the ids."""
        for batch in batches:
            for k in range(0, batch.num_rows, PART):
                part = batch.slice(k, PART)
                col = part.column(at)
                offs, vals = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
                texts = [self.text_of(vals[offs[i]:offs[i + 1]]) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, "decoded"])


def _list_array(parts: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values, kind)).cast(pa.list_(kind))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, token_ids array<int>, ids_sha256`` (of the decimal ids joined by one space).

    Null and empty texts have no ids. Each row is encoded by itself: repeated rows repeat, ids may be
    null, other columns are ignored.
    """
    rows, id_type, shared = _texts(docs, ranks, pattern, id_col, text_col)
    return rows.mapInArrow(lean(lambda batches: shared.value.run(batches)), f"doc_id {id_type}, token_ids array<int>, ids_sha256 string")


def _texts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str, text_col: str):
    """(doc_id, text) rows, the id's type and the encoder for the tasks."""
    rows = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs, text_col).alias("text"))
    return rows, docs.schema[id_col].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(_Encoder(ranks, pattern))


def decode(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """Adds ``decoded binary`` to a frame with ``token_ids``: the bytes of each id, looked up by rank."""
    shared, at = tokens.sparkSession.sparkContext.broadcast(_Decoder(ranks)), tokens.columns.index("token_ids")
    schema = ", ".join(f"`{n}` {t}" for n, t in tokens.dtypes)
    return tokens.mapInArrow(lean(lambda batches: shared.value.run(batches, at)), f"{schema}, decoded binary")


def encode_and_decode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` per document: ``encode`` and ``decode`` in one
    pass of one worker, so that ids and texts never travel back; only digests leave it."""
    import public_tokenizers

    ranks = load_ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows, id_type, encoder = _texts(docs, ranks, pattern or public_tokenizers.PATTERN, id_col, text_col)
    decoder = docs.sparkSession.sparkContext.broadcast(_Decoder(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in decoder.value.run(encoder.value.run(batches), 1):
            sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), pc.list_value_length(b.column(1)).cast(pa.int64()), b.column(2), pa.array(sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(lean(run), f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(documents(spark, sf_dir))
