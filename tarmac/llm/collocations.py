"""Phrase collocations per language, counted in quotient filters.

* Words get dense ids (one per language and word with enough occurrences), so an n-gram packs into a
  number of at most 128 bits. No dictionary is broadcast: texts are coded with ids local to a segment of
  about ``SEGMENT`` words, and each segment gets the ids of its own words by a join.
* A Feistel network permutes packed n-grams; being invertible it loses nothing. The high bits of the
  permuted number are the quotient, all others the remainder. ``Filter`` keeps the sorted remainders of
  each quotient's run, the runs as a bit vector (a one per entry, a zero per quotient) and the counts in
  one byte, larger ones apart: a lossless counter of a few bytes an entry.
* A segment makes one filter per range of quotients; a range's filters are merged in sorted order in one
  task. Quotients are spread evenly by the permutation, so no word or phrase makes a range large.
* Level by level: an n-gram with enough occurrences consists of (n-1)-grams with enough. So the filter of
  a range is intersected with the filters of its segments, and each segment gets back which of its own
  (n-1)-grams may go on. Other positions are dropped from the coded text.

Scores, cuts and containment are joins over the counted phrases in exact arithmetic.

Results for special input: null text counts as empty, null language as ``und``; an empty language is a
language. Repeated rows count repeatedly, whatever their ids. Other columns are ignored, whatever their
names. Words are what stands between separators, so a word may be a control character. Languages
without candidates, and empty tables, give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.llm.common import documents, lean, small_batches, staged

MIN_COUNT = 30
TOP = 2000
LONGEST = 4
SEGMENT = 1_000_000  # words in a segment
SEGMENT_WORDS = 200_000  # distinct words in a segment
MERGE_AT = 4_000_000  # entries unpacked before they are merged
#: A-Z to a-z, the separators of pieces to a newline, tab to a blank (fixed values)
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
_KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def permute(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of pairs of ``half``-bit numbers (Feistel network of four rounds)."""
    for key in _KEYS:
        left, right = right, left ^ _round(right, key, half)
    return left, right


def restore(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``permute``."""
    for key in reversed(_KEYS):
        left, right = right ^ _round(left, key, half), left
    return left, right


def _round(x: np.ndarray, key: int, half: int) -> np.ndarray:
    h = (x + np.uint64(key)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (h ^ (h >> np.uint64(29))) >> np.uint64(64 - half)


def half_bits(n: int, id_bits: int) -> int:
    """Bits of either half of a packed n-gram: one id for pairs of words, two beyond."""
    return max(16, id_bits if n == 2 else 2 * id_bits)


def _packed(ids: np.ndarray, at: np.ndarray, n: int, id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    w = [ids[at + i].astype(np.uint64) for i in range(n)] + [np.zeros(len(at), np.uint64)] * (4 - n)
    b = np.uint64(id_bits)
    return permute(*((w[0], w[1]) if n == 2 else (w[0] << b | w[1], w[2] << b | w[3])), half_bits(n, id_bits))


def _unpacked(left: np.ndarray, right: np.ndarray, n: int, id_bits: int) -> list[np.ndarray]:
    left, right = restore(left, right, half_bits(n, id_bits))
    b, m = np.uint64(id_bits), np.uint64((1 << id_bits) - 1)
    w = [left, right] if n == 2 else [left >> b, left & m, right >> b, right & m]
    return [x.astype(np.int64) for x in w] + [np.zeros(len(left), np.int64)] * (4 - len(w))


def _joined(left: np.ndarray, right: np.ndarray, half: int) -> np.ndarray:
    """One sortable value per pair of halves: a number, or 16 bytes where 64 bits don't hold it."""
    if half <= 32:
        return left << np.uint64(half) | right
    return np.stack([left, right], axis=1).astype(">u8").view("S16").ravel()


class Filter:
    """Sorted (left, right) with counts, packed for one range of quotients."""

    @staticmethod
    def counted(left: np.ndarray, right: np.ndarray, counts: np.ndarray | None, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Equal entries added up, in sorted order."""
        key = _joined(left, right, half)
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        total = np.diff(np.append(start, len(key))) if counts is None else np.add.reduceat(counts[order], start) if len(start) else np.zeros(0, np.int64)
        first = order[start]
        return left[first], right[first], total.astype(np.int64)

    @staticmethod
    def pack(left: np.ndarray, right: np.ndarray, counts: np.ndarray, half: int, range_bits: int) -> bytes:
        """Entries of one range (equal high ``range_bits``), sorted: header, counts, runs, remainders."""
        n = len(left)
        own = min(half - range_bits, max(0, n.bit_length() - 1))  # quotient bits below the range's
        rest = half - range_bits - own
        inside = left & np.uint64((1 << (half - range_bits)) - 1) if half > range_bits else np.zeros(n, np.uint64)
        quotient = (inside >> np.uint64(rest)).astype(np.int64)
        runs = np.zeros(n + (1 << own), np.uint8)
        runs[quotient + np.arange(n)] = 1  # a one per entry, a zero at each quotient's end
        remainder = [x.astype("<u8").view(np.uint8).reshape(n, 8)[:, : -(-bits // 8)].tobytes() for x, bits in ((inside & np.uint64((1 << rest) - 1), rest), (right, half))]
        large = np.flatnonzero(counts >= 255)
        head = np.array([n, own, len(large)], "<i8").tobytes()
        return b"".join([head, np.minimum(counts, 255).astype(np.uint8).tobytes(), large.astype("<u4").tobytes(), counts[large].astype("<i8").tobytes(), np.packbits(runs).tobytes(), *remainder])

    @staticmethod
    def unpack(blob: bytes, half: int, range_bits: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, own, large = (int(x) for x in np.frombuffer(blob, "<i8", 3))
        at = 24

        def take(dtype: str, k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype, k, at)
            at += out.nbytes
            return out

        counts = take("u1", n).astype(np.int64)
        where = take("<u4", large)
        counts[where] = take("<i8", large)
        length = n + (1 << own)
        ones = np.flatnonzero(np.unpackbits(take("u1", -(-length // 8)), count=length))
        rest = half - range_bits - own
        parts = []
        for bits in (rest, half):
            wide = np.zeros((n, 8), np.uint8)
            k = -(-bits // 8)
            wide[:, :k] = take("u1", n * k).reshape(n, k)
            parts.append(wide.view("<u8").ravel().astype(np.uint64))
        quotient = (ones - np.arange(n)).astype(np.uint64)
        left = (quotient << np.uint64(rest) | parts[0]) if rest < 64 else parts[0]
        return (left | np.uint64(number << (half - range_bits)) if range_bits else left), parts[1], counts


def _member(key: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``key`` are in the sorted ``among``."""
    if not len(among):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(among, key), len(among) - 1)
    return among[at] == key


def segments(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = SEGMENT) -> DataFrame:
    """``seg, lang, tokens, words, counts``: words as numbers local to the segment, 0 between pieces."""
    rows = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        books: dict[str, tuple[defaultdict, list]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial, held
            for lang, (ids, parts) in books.items():
                tokens = np.concatenate(parts)
                counts = np.bincount(tokens, minlength=len(ids))[1:]
                yield pa.RecordBatch.from_arrays([pa.array([serial], pa.int64()), pa.array([lang], pa.string()), pa.array([tokens.astype("<i4").tobytes()], pa.binary()),
                                                  pa.array([list(ids)[1:]], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64()))], names=["seg", "lang", "tokens", "words", "counts"])
                serial += 1
            books.clear()
            held = 0

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in books:
                    ids: defaultdict = defaultdict()
                    ids.default_factory = ids.__len__
                    ids[b"\n"]  # 0
                    books[lang] = (ids, [])
                ids, parts = books[lang]
                words = text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
                parts.append(np.fromiter(chain(map(ids.__getitem__, filter(None, words)), (0,)), np.int32))
                held += len(parts[-1])
                if held >= size or sum(len(b[0]) for b in books.values()) >= SEGMENT_WORDS:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(lean(run), "seg long, lang string, tokens binary, words array<binary>, counts array<long>")


def dictionary(vocabulary: DataFrame, min_count: int) -> DataFrame:
    """``lang, word, f, id`` of the words with at least ``min_count`` occurrences; ids are dense from 1."""
    often = vocabulary.groupBy("lang", "word").agg(F.sum("c").alias("f")).filter(F.col("f") >= min_count)
    part = staged(often.select("lang", "word", "f", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("local")), "words")
    sizes = part.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # a row per shuffle partition
    ends = np.cumsum([r.n for r in sizes]).tolist() if sizes else []
    begin = part.sparkSession.createDataFrame([(r.part, e - r.n) for r, e in zip(sizes, ends)], "part int, begin long")
    return staged(part.join(F.broadcast(begin), "part").select("lang", "word", "f", (F.col("begin") + F.col("local") + 1).alias("id")), "dictionary")


def _coded(segs: DataFrame, vocabulary: DataFrame, words: DataFrame) -> DataFrame:
    """``seg, tokens``: dictionary ids, 0 for rarer words and between pieces."""
    known = vocabulary.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("seg").agg(F.collect_list("local").alias("local"), F.collect_list("id").alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, local, ids in zip(*(batch.column(i) for i in (1, 2, 3))):
                tokens = np.frombuffer(raw.as_buffer(), "<i4")
                table = np.zeros(int(tokens.max(initial=0)) + 1, np.uint32)
                table[local.values.to_numpy()] = ids.values.to_numpy()
                out.append(_squeezed(table[tokens]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["seg", "tokens"])

    return segs.select("seg", "tokens").join(known, "seg").mapInArrow(lean(run), "seg long, tokens binary")


def _squeezed(ids: np.ndarray) -> np.ndarray:
    """Runs of zeros as one."""
    return ids[np.concatenate(([True], (ids[1:] != 0) | (ids[:-1] != 0)))] if len(ids) else ids


def _level(coded: DataFrame, n: int, id_bits: int, range_bits: int) -> DataFrame:
    """``seg, range, blob``: filters of each segment's n-grams whose (n-1)-grams may go on; the text that is
    left has range -1. ``coded`` has seg, tokens, ranges and filters (of the (n-1)-grams)."""
    half, below = half_bits(n, id_bits), half_bits(n - 1, id_bits) if n > 2 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, raw, numbers, blobs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids = np.frombuffer(raw, "<u4")
                if n == 2:
                    good = ids > 0
                else:
                    here = np.ones(max(0, len(ids) - n + 2), bool)  # windows of n - 1 words
                    for i in range(n - 1):
                        here &= ids[i: len(ids) - n + 2 + i] > 0
                    at = np.flatnonzero(here)
                    entries = [Filter.unpack(b, below, range_bits, r)[:2] for r, b in sorted(zip(numbers, blobs))]
                    among = np.concatenate([_joined(*e, below) for e in entries]) if entries else np.zeros(0, np.uint64)
                    at = at[_member(_joined(*_packed(ids, at, n - 1, id_bits), below), among)]
                    good = np.zeros(len(here), bool)
                    good[at] = True
                    kept = np.zeros(len(ids) + 1, np.int64)
                    np.add.at(kept, at, 1)
                    np.add.at(kept, at + n - 1, -1)
                at = np.flatnonzero(good[:-1] & good[1:]) if len(good) > 1 else np.zeros(0, np.int64)
                left, right, counts = Filter.counted(*_packed(ids, at, n, id_bits), None, half)
                number = (left >> np.uint64(half - range_bits)).astype(np.int64)
                cut = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(number) else np.zeros(0, np.int64)
                ends = np.append(cut[1:], len(number))
                rest = ids if n == 2 else _squeezed(np.where(np.cumsum(kept)[:-1] > 0, ids, 0).astype("<u4"))
                out = [(-1, rest.tobytes())] if n < LONGEST else []
                out += [(int(number[s]), Filter.pack(left[s:e], right[s:e], counts[s:e], half, range_bits)) for s, e in zip(cut, ends)]
                yield pa.RecordBatch.from_arrays([pa.array([seg] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["seg", "range", "blob"])

    return coded.mapInArrow(lean(run), "seg long, range int, blob binary")


def _merged(filters: DataFrame, n: int, id_bits: int, range_bits: int, min_count: int) -> DataFrame:
    """``range, often``: each range's filters merged, entries with at least ``min_count``."""
    half = half_bits(n, id_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def merge() -> None:
            nonlocal held, size
            held = [Filter.counted(*(np.concatenate(x) for x in zip(*held)), half)]
            size = 0

        def done() -> pa.RecordBatch:
            merge()
            left, right, counts = held[0]
            often = counts >= min_count
            blob = Filter.pack(left[often], right[often], counts[often], half, range_bits)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([blob], pa.binary())], names=["range", "often"])

        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if number != now:
                    if now is not None:
                        yield done()
                    now, held, size = number, [], 0
                held.append(Filter.unpack(blob, half, range_bits, number))
                size += len(held[-1][0])
                if size >= MERGE_AT:
                    merge()
        if now is not None:
            yield done()

    return filters.select("range", "blob").repartition("range").sortWithinPartitions("range").mapInArrow(lean(run), "range int, often binary")


def _returned(filters: DataFrame, often: DataFrame, n: int, id_bits: int, range_bits: int) -> DataFrame:
    """``seg, ranges, filters``: of each segment's own n-grams those that occur often, per range."""
    half = half_bits(n, id_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, among = None, None
        for batch in batches:
            out = []
            for seg, number, blob, whole in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if number != last:
                    last, among = number, _joined(*Filter.unpack(whole, half, range_bits, number)[:2], half)
                left, right, counts = Filter.unpack(blob, half, range_bits, number)
                ok = _member(_joined(left, right, half), among)
                if ok.any():
                    out.append((seg, number, Filter.pack(left[ok], right[ok], np.zeros(int(ok.sum()), np.int64), half, range_bits)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["seg", "range", "blob"])

    both = filters.join(often, "range").select("seg", "range", "blob", "often").mapInArrow(lean(run), "seg long, range int, blob binary")
    return both.groupBy("seg").agg(F.collect_list("range").alias("ranges"), F.collect_list("blob").alias("filters"))  # a segment's own n-grams


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases ``w1..w4, f``; dictionary ``lang, word, f, id``; ``lang, n``) with at least ``min_count`` occurrences.

    ``w1..w4`` are dictionary ids, 0 beyond the phrase's end; single words are phrases here.
    """
    spark = docs.sparkSession
    with small_batches(spark, 500):
        segs = staged(segments(docs, lang_col, text_col, segment), "segments")
    vocabulary = segs.select("seg", "lang", F.posexplode(F.arrays_zip(F.col("words"), F.col("counts"))).alias("p", "w")) \
        .select("seg", "lang", (F.col("p") + 1).alias("local"), F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    totals = vocabulary.groupBy("lang").agg(F.sum("c").alias("n"))
    words = dictionary(vocabulary, min_count)
    top = words.agg(F.max("id")).first()[0]
    phrases = words.select(F.col("id").alias("w1"), *(F.lit(0).cast("long").alias(f"w{i}") for i in (2, 3, 4)), "f")
    if top is None:
        return phrases, words, totals
    id_bits = int(top).bit_length()
    if id_bits > 32:
        raise ValueError(f"{top} words: ids of more than 32 bits")
    range_bits = min(16, max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))

    with small_batches(spark, 4):
        coded = staged(_coded(segs, vocabulary, words), "coded").withColumns({"ranges": F.lit(None).cast("array<int>"), "filters": F.lit(None).cast("array<binary>")})
        for n in range(2, LONGEST + 1):
            found = staged(_level(coded, n, id_bits, range_bits), f"grams-{n}")
            filters = found.filter("range >= 0")
            often = staged(_merged(filters, n, id_bits, range_bits, min_count), f"often-{n}")
            phrases = phrases.unionByName(_rows(often, n, id_bits, range_bits))
            if n < LONGEST:
                coded = found.filter("range = -1").select("seg", F.col("blob").alias("tokens")).join(_returned(filters, often, n, id_bits, range_bits), "seg")
        return staged(phrases, "phrases"), words, totals


def _rows(often: DataFrame, n: int, id_bits: int, range_bits: int) -> DataFrame:
    half = half_bits(n, id_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                left, right, counts = Filter.unpack(blob, half, range_bits, number)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*_unpacked(left, right, n, id_bits), counts)], names=["w1", "w2", "w3", "w4", "f"])

    return often.mapInArrow(lean(run), "w1 long, w2 long, w3 long, w4 long, f long")


def _keys(ids: list) -> list:
    """Two longs that name a phrase of up to four ids below 2^32."""
    ids = [*ids, *[F.lit(0).cast("long")] * (4 - len(ids))]
    return [F.shiftleft(ids[0], 32).bitwiseOR(ids[1]), F.shiftleft(ids[2], 32).bitwiseOR(ids[3])]


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, top: int = TOP, segment: int = SEGMENT) -> DataFrame:
    """Each language's first ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase of two to four words with a >= ``min_count`` scores floor(2000000 a / (l + r)) at its
    lowest-scoring cut; one whose words lie inside a longer candidate with 80 percent of its
    occurrences or more is dropped. Order: score, a (both descending), phrase (UTF-8 bytes).
    """
    phrases, words, totals = phrase_counts(docs, lang_col, text_col, min_count, segment)
    w = [F.col(f"w{i}") for i in range(1, 5)]
    size = sum(F.when(x > 0, 1).otherwise(0) for x in w)
    hi, lo = _keys(w)
    keyed = phrases.select("*", hi.alias("hi"), lo.alias("lo"), size.alias("size"))
    counts = keyed.select("hi", "lo", "f")
    cand = keyed.filter("size >= 2").withColumnRenamed("f", "a")

    def part(a: int, b: int) -> list:
        return _keys(w[a:b])

    cuts = []
    for n in (2, 3, 4):
        for k in range(1, n):
            (lh, ll), (rh, rl) = part(0, k), part(k, n)
            cuts.append(F.when(F.col("size") == n, F.struct(F.lit(k).alias("k"), lh.alias("lh"), ll.alias("ll"), rh.alias("rh"), rl.alias("rl"))))
    cut = cand.select("hi", "lo", "a", F.explode(F.array_compact(F.array(*cuts))).alias("x")).select("hi", "lo", "a", "x.*")
    scored = cut.join(counts.toDF("lh", "ll", "l"), ["lh", "ll"]).join(counts.toDF("rh", "rl", "r"), ["rh", "rl"])
    value = F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)")
    best = scored.groupBy("hi", "lo").agg(F.min(F.struct(value.alias("score"), F.col("k"), F.col("l"), F.col("r"))).alias("b")).select("hi", "lo", "b.score", "b.l", "b.r")

    inside = []
    for n in (3, 4):
        for m in range(2, n):
            for s in range(n - m + 1):
                h, x = part(s, s + m)
                inside.append(F.when(F.col("size") == n, F.struct(h.alias("hi"), x.alias("lo"))))
    longer = cand.select("a", F.explode(F.array_compact(F.array(*inside))).alias("s")).groupBy("s.hi", "s.lo").agg(F.max("a").alias("longest"))
    kept = cand.join(longer, ["hi", "lo"], "left").filter(F.expr("longest is null or cast(longest as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80"))

    named = kept.join(best, ["hi", "lo"]).join(words.select(F.col("id").alias("w1"), "lang", F.col("word").alias("v1")), "w1")
    first = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    named = named.withColumn("place", F.rank().over(first)).filter(F.col("place") <= top)  # with all ties of the last
    for i in (2, 3, 4):
        named = named.join(words.select(F.col("id").alias(f"w{i}"), F.col("word").alias(f"v{i}")), f"w{i}", "left")
    phrase = F.concat_ws(" ", *(F.col(f"v{i}").cast("string") for i in range(1, 5)))
    named = named.withColumn("phrase", phrase).join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    return named.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, unnest(list_transform(range(1, len(w) + 2 - k), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase, k FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
c AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k >= 2 AND f >= 30),
cut AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest FROM cand, (SELECT unnest([1, 2, 3]) AS j) WHERE j < k),
s AS (SELECT cut.*, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score FROM cut JOIN c x ON x.lang = cut.lang AND x.phrase = first JOIN c y ON y.lang = cut.lang AND y.phrase = rest),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
sub AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longest FROM cand, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN sub USING (lang, phrase) WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
QUALIFY rank <= 2000
"""
