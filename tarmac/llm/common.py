"""Helpers shared by the training-data operators: text rules, staged tables, row keys."""

from __future__ import annotations

import ctypes
import re
import string
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.session import checkpoint_dir

#: White space of the text contracts (fixed value): blank, tab, newline, vertical tab, form feed, return.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Characters outside A-Z that have a lower-case form: only such texts need the letter-by-letter rule.
_OTHER_UPPER = r"[\p{Lu}\p{Lt}\x{2160}-\x{216F}\x{24B6}-\x{24CF}&&[^A-Z]]"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the fast path and right unless another capital is present."""
    return F.when(text.rlike(_OTHER_UPPER), F.translate(text, string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.lower(text))


def text_or_empty(docs: DataFrame, text_col: str = "text") -> Column:
    return F.coalesce(docs[text_col].cast("string"), F.lit(""))


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores added as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder of ``spark.checkpoint.dir`` and reread it: later
    readers, and tasks rerun after a lost executor, see the same rows without recomputing."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast only after counting: at most ``max_rows`` rows; larger sides are shuffled."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for the jobs run inside: wide rows (whole texts, whole
    sets) then cost a Python worker little memory. The session's setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lean_session(spark: SparkSession, rows: int = 500) -> None:
    """The same for the rest of the session, for jobs whose frames are written by someone else."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving free memory back to the system at the end of each task: a worker
    that Spark reuses would otherwise hold the largest task's memory through all later stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return task


def _class_ranges(cls: str) -> str:
    """The characters up to U+FFFF that ``regex`` puts into a class, as ranges of a bracket expression."""
    plane = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    return "".join(f"{re.escape(run[0])}-{re.escape(run[-1])}" for run in regex.findall(f"{cls}+", plane))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``regex.compile(pattern).findall``, about three times as fast for texts without characters above
    U+FFFF: there ``\\p{..}``, ``\\s`` and ``\\S`` are spelled out as ranges for the standard library's engine.
    Patterns with flags, other classes or groups that findall would return are left to ``regex``."""
    plain = regex.compile(pattern)
    if plain.groups or regex.search(r"\(\?[a-zA-Z]|\\[^pPsS\W]|\\P|\\p(?!\{\w+\})|\[[^\]]*\\S", pattern):
        return plain.findall
    out, inside = [], False
    for part in regex.findall(r"\\p\{\w+\}|\\.|.", pattern, regex.S):
        if part in "[]":
            inside = part == "["
        elif part == r"\S":
            part = f"[^{_class_ranges(chr(92) + 's')}]"
        elif part == r"\s" or part.startswith(r"\p"):
            part = _class_ranges(part) if inside else f"[{_class_ranges(part)}]"
        out.append(part)
    quick, above = re.compile("".join(out)).findall, re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: quick(text) if text.isascii() or not above(text) else plain.findall(text)
