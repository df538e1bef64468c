"""Driver contract: entry() runs, every oracle key is a query, stream twins are batch-equal (via oracle)."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
from pathlib import Path

import __spark_entry__ as entry_mod


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert {"hour", "day_of_week", "congestion_score"} <= set(df.columns)


def test_oracle_keys_are_queries():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100 and len(o) >= 85


def _run(code: str, **env) -> str:
    """A process of its own, started in an empty folder without PYTHONPATH."""
    folder = tempfile.mkdtemp(prefix="tarmac-elsewhere-", dir="/tmp")
    root = str(Path(__file__).resolve().parents[1])
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | env
    done = subprocess.run([sys.executable, "-c", f"import sys\nroot = {root!r}\n{code}"], cwd=folder, env=clean, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout


LOAD = """
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", root + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
"""


def test_queries_without_an_optional_library():
    """A library that only the training-data operators need may be absent."""
    out = _run("for name in ('xxhash', 'regex', 'tokenizers', 'tiktoken'):\n    sys.modules[name] = None\n" + LOAD + "print(len(entry.queries()), len(entry.oracle_sql()))")
    n, m = map(int, out.split()[-2:])
    assert n >= 180 and m >= 165


def test_executors_get_the_package():
    """Started elsewhere, Python workers can import the functions that they run."""
    out = _run(LOAD + """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
frame = entry.queries()["allocate_runway_slots"](spark, "/root/testdata/sf0.001")

def importable(batches):
    import tarmac.operators.scheduling as S
    for b in batches:
        yield b.filter(b.column(0).is_valid()) if "tarmac.zip" in S.__file__ else b.slice(0, 0)

print("rows", frame.count(), spark.range(7).mapInArrow(importable, "id long").count())
""")
    assert out.split()[-1] == "7" and int(out.split()[-2]) > 0
