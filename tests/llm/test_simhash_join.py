"""The SimHash join against brute force over all pairs of fingerprints."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

SCHEMA = "doc_id long, text string, lang string, print long, cell long, component long, score double"


def simhash(text, k=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, differ=4):
    """prints: (id, fingerprint) rows -> their smallest reachable id, None last."""
    values = sorted({f for _, f in prints})
    a = np.array(values, np.uint64)
    up = {f: f for f in values}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for f in values:
        for g in a[np.bitwise_count(a ^ np.uint64(f)) <= differ]:
            up[root(int(g))] = root(f)
    least = {}
    for i, f in prints:
        r = root(f)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted(((i, f"{f:016x}", least[root(f)]) for i, f in prints), key=str)


def result(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def texts(n=400, seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÉß") for _ in range(rng.randint(1, 4)))
    rows, family = [], [word() for _ in range(300)]
    for i in range(n):
        if i % 3 == 0:  # a third of all rows are near copies of one text
            t = family[:]
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = word()
            text = (" " if i % 2 else "\t\n ").join(t)
        else:
            text = " ".join(word() for _ in range(rng.randint(0, 30)))
        rows.append((i, text.upper() if i % 5 == 0 else text, "en", 1, 2, 3, 0.5))
    rows += [(n, None, None, None, None, None, None), (n + 1, " \t\n", "en", 1, 1, 1, 1.0), (n + 2, "", "en", 1, 1, 1, 1.0), (None, "only once", "en", 1, 1, 1, 1.0),
             (None, " ".join(family), "en", 1, 1, 1, 1.0), (n + 3, "Long text ! " * 60_000, "en", 1, 1, 1, 1.0), (3, "another text of id 3", "en", 1, 1, 1, 1.0), (4, "same", "en", 1, 1, 1, 1.0), (4, "same", "en", 1, 1, 1, 1.0)]
    return rows


@pytest.mark.parametrize("cell,groups", [(8192, None), (4, 6), (16, 5)])
def test_near_duplicates_equal_brute_force(spark, cell, groups):
    from tarmac.llm.simhash_join import near_duplicates

    rows = texts()
    got = result(near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), cell=cell, groups=groups))
    assert got == classes([(r[0], simhash(r[1])) for r in rows])
    assert len({c for _, _, c in got}) < len(rows) / 1.3


@pytest.mark.parametrize("groups,cell", [(5, 50), (6, 64), (7, 8192), (9, 8192)])
def test_every_link_is_found(spark, groups, cell):
    """Planted fingerprints at distances 3 to 5 of each other, dense families and many that share most coordinates."""
    from tarmac.llm import simhash_join as S

    rng = random.Random(groups)
    prints = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        prints.add(f)
        for _ in range(12):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 5)):
                g ^= 1 << b
            prints.add(g)
            f = g if rng.random() < 0.5 else f
    prints |= {rng.getrandbits(10) for _ in range(300)}
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in prints], "print long").repartition(3)
    links = {(u, v) for u, v in S._cell_links(S._postings(nodes, groups, 4), 4, cell).collect()}
    assert all(bin((u ^ v) & (2**64 - 1)).count("1") <= 4 for u, v in links)
    up = {f: f for f in prints}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for u, v in links:
        up[root(u & (2**64 - 1))] = root(v & (2**64 - 1))
    want = classes([(f, f) for f in prints])
    parts = {}
    for f, _, c in want:
        parts.setdefault(c, set()).add(root(f))
    assert all(len(p) == 1 for p in parts.values()) and len({p for s in parts.values() for p in s}) == len(parts)


def test_bound_is_safe():
    from tarmac.llm import simhash_join as S

    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 20_000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 20_000).astype(np.uint64))
    for b in (y, rng.permutation(y)):
        points = [np.stack([np.bitwise_count((v >> np.uint64(2 * s)) & np.uint64(3)) for s in range(S.SEGMENTS)]).astype(int) for v in (x, b)]
        d = np.abs(points[0] - points[1]).sum(axis=0)
        assert (S.manhattan(S.embed(x), S.embed(b)) == d).all() and (d <= np.bitwise_count(x ^ b)).all()


def test_no_documents(spark):
    from tarmac.llm.simhash_join import near_duplicates

    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_table(spark):
    from tarmac.llm.simhash_join import op12

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert result(op12(spark, sf)) == classes([(r.doc_id, simhash(r.text)) for r in docs])
