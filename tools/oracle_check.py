"""Run registered queries in Spark and their DuckDB twins; report row/schema/value agreement.

usage: python tools/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP",
                 "date": "DATE", "boolean": "BOOLEAN", "smallint": "SMALLINT", "tinyint": "TINYINT", "float": "FLOAT",
                 "array<string>": "VARCHAR[]", "timestamp": "TIMESTAMP WITH TIME ZONE"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if v is None:
        return ("~",)
    if isinstance(v, float) and math.isnan(v):
        return ("~",)
    if isinstance(v, (float, Decimal)):
        v = float(v)
        return ("n", float(f"{v:.9g}"))
    if isinstance(v, bool):
        return ("b", int(v))
    if isinstance(v, int):
        return ("n", float(v))
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_norm(x) for x in v))
    if isinstance(v, dict):
        return ("d", tuple(sorted((k, _norm(x)) for k, x in v.items())))
    return ("s", str(v))


def rows_of(cols: list[str], records: list) -> list:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(rec[i]) for i in order) for rec in records]
    return sorted(out, key=repr)


def close(a, b) -> bool:
    if a == b:
        return True
    if a[0] == "n" and b[0] == "n":
        x, y = a[1], b[1]
        return abs(x - y) <= 1e-6 * max(1.0, abs(x), abs(y))
    if a[0] == "l" and b[0] == "l" and len(a[1]) == len(b[1]):
        return all(close(p, q) for p, q in zip(a[1], b[1]))
    return False


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--types", action="store_true", help="also report column type differences")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()

    from tarmac.plans.registry import load_all
    from tarmac.session import local_session

    reg = load_all()
    names = args.names or sorted(reg)
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        p = Path(args.sf) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    bad = 0
    for name in names:
        e = reg[name]
        t0 = time.time()
        try:
            sdf = e.build(spark, args.sf)
            srows = [tuple(r) for r in sdf.collect()]
            scols = list(sdf.columns)
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(ex).__name__}: {str(ex)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if e.sql is None:
            print(f"rows {name}: {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(e.sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as ex:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(ex)[:400]}")
            bad += 1
            continue
        sc, dc = sorted(scols), sorted(dcols)
        if sc != dc:
            print(f"FAIL {name}: columns differ spark-only={set(sc)-set(dc)} duck-only={set(dc)-set(sc)}")
            bad += 1
            continue
        if len(srows) != len(drows):
            print(f"FAIL {name}: rows spark={len(srows)} duck={len(drows)}")
            bad += 1
            continue
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        mism = [(x, y) for x, y in zip(a, b) if not all(close(p, q) for p, q in zip(x, y))]
        if mism:
            print(f"FAIL {name}: {len(mism)} rows differ; cols={sc}\n  spark={mism[0][0]}\n  duck ={mism[0][1]}")
            bad += 1
            continue
        if args.types:
            st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString().upper()) for f in sdf.schema.fields}
            dt = {d[0]: str(d[1]).upper() for d in cur.description}
            diff = {c: (st[c], dt[c]) for c in st if not dt[c].startswith(st[c])}
            if diff:
                print(f"types {name}: {diff}")
        print(f"ok   {name}: {len(srows)} rows ({ts:.1f}s)")
    print(f"{len(names) - bad}/{len(names)} passed")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
