"""Collocations against brute force, and the filters' round trip."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, w1 long, id long, word string, seg long, score double"


def brute(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) >= 2 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def texts(seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        words = [rng.choice("the of and new york city É ß x y Z".split() + [f"rare{rng.randrange(500)}"]) for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " ", " - "]) for w in words)
        if i % 3 == 0:  # a third of all rows hold one passage
            text += " Machine learning is fun\tfor all of the city"
        rows.append((i, text, rng.choice(["en", "en", "de", "", None]), 1, 1, "a", 2, 0.5))
    rows += [(1, None, "en", None, None, None, None, None), (2, "", "xx", 1, 1, "a", 1, 1.0), (3, " \t.,;\r\n", None, 1, 1, "a", 1, 1.0), (None, "a b " * 20_000, "long", 1, 1, "a", 1, 1.0),
             (4, "one\x00 \x01 two " * 40, "ctl", 1, 1, "a", 1, 1.0)] + [(5, "same row again and again", "dup", 1, 1, "a", 1, 1.0)] * 40
    return rows


@pytest.mark.parametrize("segment,least,top", [(1_000_000, 30, 2000), (200, 30, 5), (50, 3, 2000)])
def test_collocations_equal_brute_force(spark, segment, least, top):
    from tarmac.llm.collocations import collocations

    rows = texts()
    got = result(collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), min_count=least, top=top, segment=segment))
    assert got == brute(rows, least, top) and len({r[0] for r in got}) >= 4


def test_nothing_to_count(spark):
    from tarmac.llm.collocations import collocations

    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, "too few words", "en", 1, 1, "", 1, 1.0)], SCHEMA)).count() == 0


@pytest.mark.parametrize("half,bits", [(16, 4), (16, 16), (26, 8), (40, 5), (64, 4)])
def test_filter_round_trip(half, bits):
    from tarmac.llm.collocations import Filter, _joined, permute, restore

    rng = np.random.default_rng(half)
    top = (1 << half) - 1
    a, b = (rng.integers(0, top, 5000, dtype=np.uint64, endpoint=True) for _ in range(2))
    a, b = np.concatenate([a, a[:900], [0, top]]).astype(np.uint64), np.concatenate([b, b[:900], [0, top]]).astype(np.uint64)
    x, y = permute(a, b, half)
    assert all((p == q).all() for p, q in zip(restore(x, y, half), (a, b))) and int(max(x.max(), y.max())) <= top
    left, right, counts = Filter.counted(x, y, None, half)
    want = Counter(zip(x.tolist(), y.tolist()))
    assert dict(zip(zip(left.tolist(), right.tolist()), counts.tolist())) == want
    key = _joined(left, right, half)
    assert (key[1:] > key[:-1]).all()
    counts[::7] = 10**12 + np.arange(len(counts[::7]))
    number = (left >> np.uint64(half - bits)).astype(int)
    for r in np.unique(number):
        s = number == r
        back = Filter.unpack(Filter.pack(left[s], right[s], counts[s], half, bits), half, bits, int(r))
        assert all((p == q).all() for p, q in zip(back, (left[s], right[s], counts[s])))
    assert all(len(v) == 0 for v in Filter.unpack(Filter.pack(left[:0], right[:0], counts[:0], half, bits), half, bits, 0))


def test_sql_twin(spark):
    from tools_oracle import rows_of

    from tarmac.llm import collocations as C

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    df, cur = C.op13(spark, sf), con.execute(C.SQL)
    cols = [c[0] for c in cur.description]
    got, want = df.collect(), cur.fetchall()
    assert sorted(cols) == sorted(df.columns) and len(want) > 100
    assert rows_of(df.columns, [tuple(r) for r in got]) == rows_of(cols, want)
