"""Every registered query with a DuckDB twin agrees with it at sf0.001 (rows, columns, values)."""

from __future__ import annotations

import duckdb
import pytest

from tarmac.plans.registry import load_all
from tools_oracle import SPARK_TO_DUCK, TABLES, close, rows_of

from conftest import SF_SMALL

ENTRIES = load_all()
SQL_NAMES = sorted(n for n, e in ENTRIES.items() if e.sql)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SQL_NAMES)
def test_matches_sql(spark, duck, name):
    e = ENTRIES[name]
    sdf = e.build(spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(e.sql)
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString().upper()) for f in sdf.schema.fields}
    dt = {d[0]: str(d[1]).upper() for d in cur.description}
    assert {c: (st[c], dt[c]) for c in st if not dt[c].startswith(st[c])} == {}
    assert len(srows) == len(drows)
    a, b = rows_of(list(sdf.columns), srows), rows_of(dcols, drows)
    bad = [(x, y) for x, y in zip(a, b) if not all(close(p, q) for p, q in zip(x, y))]
    assert not bad, bad[:2]
