"""Stages on tables with clashing column names, repeated ids and very long words."""

from __future__ import annotations

import time

import pytest

BASE = " ".join(f"word{i}" for i in range(60))
OTHER = " ".join(f"else{i}" for i in range(40))
NAMES = ["_digest", "_check", "_points", "_id", "_null", "_text", "_bad_id", "_bad_key", "__n_chars", "given", "_crc", "_p", "_shard", "_slot", "text_key", "component", "__d", "__i", "__n"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, BASE), (2, BASE), (3, OTHER), (None, None), (5, ""), (3, OTHER)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, *["x"] * len(NAMES)) for r in rows], schema)


def test_stages_keep_clashing_columns(spark, clashing, tmp_path):
    from tarmac.llm import decontaminate, exact_dedup, jaccard_join, quality, sharding

    items = spark.createDataFrame([("i", " ".join(OTHER.split()[3:15]))], "item_id string, text string")
    stages = {
        "exact": (exact_dedup.drop_exact_duplicates(clashing), [1, 3, 5]),  # empty and null texts are equal
        "near": (jaccard_join.keep_one_per_group(clashing), [1, 3, 5, None]),
        "clean": (decontaminate.drop_contaminated(clashing, items), [1, 2, 5, None]),
        "good": (quality.keep_good(clashing, (1.0, [])), [1, 2, 3, 3, 5, None]),
    }
    for name, (out, ids) in stages.items():
        assert out.columns == clashing.columns, name
        rows = out.collect()
        assert sorted((r.doc_id for r in rows), key=str) == sorted(ids, key=str), name
        assert all(r[n] == "x" for r in rows for n in NAMES), name
    sharding.write_shards(clashing, str(tmp_path / "shards"), 3)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 6


def test_near_copies_of_a_repeated_id(spark):
    from tarmac.llm.jaccard_join import keep_one_per_group

    df = spark.createDataFrame([(3, BASE), (7, BASE + " tail"), (7, OTHER), (7, OTHER), (9, OTHER + " end"), (None, BASE)], "doc_id long, text string")
    assert sorted(map(tuple, keep_one_per_group(df).collect())) == [(3, BASE), (7, OTHER)]
    alone = spark.createDataFrame([(7, BASE), (7, BASE + " tail")], "doc_id long, text string")
    assert keep_one_per_group(alone).count() == 1


@pytest.mark.parametrize("text", ["a" * 1_000_000 + "1", "1234;" * 200_000, "1234 " * 100_000, " " * 1_000_000 + "1234"])
def test_long_words_in_linear_time(text):
    from tarmac.llm import pii

    start = time.process_time()
    pii._facts(text[: len(text) // 4], pii.base_spans(text[: len(text) // 4]))
    quarter = time.process_time() - start
    pii._facts(text, pii.base_spans(text))
    assert time.process_time() - start - quarter < 10 * quarter + 1


