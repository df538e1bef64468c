"""The prefix trie against brute force, with every kind of node split over ranges and blocks."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

SCHEMA = "conv_id long, turn long, role string, text string, depth int, shard int, key string, n_convs string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = own.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * words
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), children[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in m if len(paths[c]) == len(k)).encode()).hexdigest()) for k, m in members.items())


def result(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(seed=3, n=150):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        same = c % 3 == 0  # a third of all conversations are equal
        for t in range(4 if same else rng.randint(0, 9)):
            text = f"turn {t} of all" if same else " ".join(rng.choice("ab") for _ in range(rng.randint(0, 2)))
            rows.append((c, t, "user" if t % 2 else None, text, 1, 2, "k", None))
    rows += [(7, None, "user", "first of all", 1, 2, "k", None), (7, 0, "a", "tie", None, None, None, None), (7, 0, "a", "tie", 1, 2, "k", None), (7, 0, None, None, 1, 2, "k", None)]
    rows += [(None, 0, "user", "belongs to none", 1, 2, "k", None), (-45, 1, "user", "negative", 1, 2, "k", None), (-40, 1, "user", "base of it", 1, 2, "k", None)]
    rows += [(5000, t, "user", "Long \t text " * 3000 if t == 9 else f"long {t}", 1, 2, "k", None) for t in range(40)]
    rows += [(5000 + i, t, "user", f"long {t}", 1, 2, "k", None) for i in (20, 21, 40) for t in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block,skeleton,ranges", [(1024, 100_000, None), (1024, 100_000, 40), (3, 100_000, 30), (4, 12, 50), (1, 5, 3)])
def test_trie_equals_brute_force(spark, block, skeleton, ranges):
    from tarmac.llm.prefix_trie import prefix_trie

    rows = conversations()
    if block < 4:  # fewer passes
        rows = [r for r in rows if r[0] is None or r[0] < 5000 or r[1] < 8]
    got = result(prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), block, skeleton, ranges))
    assert got == brute(rows)


def test_trie_of_nothing(spark):
    from tarmac.llm.prefix_trie import prefix_trie

    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, 1, "", "")], SCHEMA)).count() == 0


def test_trie_sql_twin(spark):
    from tools_oracle import rows_of

    from tarmac.llm import prefix_trie as P

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    df, cur = P.op11(spark, sf), con.execute(P.SQL)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())
