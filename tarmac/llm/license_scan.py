"""License scan: sparse TF-IDF cosine of notices to templates, then inheritance along directories.

1. Units: around each licence word of a text the words that a template's window may cover, across line
   ends (whole texts are read), so that wrapped, embedded and short notices are met at their own length.
2. TF-IDF: inverse document frequencies are counted over the texts' units and the templates together and
   joined to the units by term. Every window that covers a licence word and is as long as a template (or
   the whole text, if shorter) is compared with that template.
3. A file's own licence is its best window at or above ``THRESHOLD``. A window that lacks a version of the template,
   is of another kind (Lesser, Affero, NonCommercial, ShareAlike) or is denied by "not" never counts, however similar.
   The conditions that both BSD licences share, then a bare reservation of rights, count only where no window says more.
4. A licence file (LICENSE, COPYING, NOTICE) speaks for its directory. Directories, not files, are
   joined to their ancestors; the nearest one with a licence is inherited by files without their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import documents, staged, text_or_empty

THRESHOLD = 0.6
#: Names and usual notices of public licences.
TEMPLATES = {
    "Apache-1.1": ["the apache software license version 1.1", "spdx license identifier apache 1.1"],
    "Apache-2.0": ["licensed under the apache license version 2.0", "spdx license identifier apache 2.0",
                   "you may not use this file except in compliance with the license you may obtain a copy of the license"],
    "MIT": ["released under the mit license", "licensed under the mit license", "spdx license identifier mit",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "ISC": ["licensed under the isc license", "spdx license identifier isc",
            "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "BSD-2-Clause": ["licensed under the bsd 2 clause license", "spdx license identifier bsd 2 clause",
                     "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSD-3-Clause": ["licensed under the bsd 3 clause license", "spdx license identifier bsd 3 clause",
                     "nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "GPL-2.0": ["this work is licensed under the gnu general public license version 2", "spdx license identifier gpl 2.0",
                "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2"],
    "GPL-3.0": ["this work is licensed under the gnu general public license version 3", "spdx license identifier gpl 3.0",
                "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3"],
    "AGPL-3.0": ["licensed under the gnu affero general public license version 3", "spdx license identifier agpl 3.0", "licensed under agpl 3.0"],
    "LGPL-2.1": ["licensed under the gnu lesser general public license version 2.1", "spdx license identifier lgpl 2.1"],
    "LGPL-3.0": ["licensed under the gnu lesser general public license version 3", "spdx license identifier lgpl 3.0"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v. 2.0", "spdx license identifier mpl 2.0"],
    "EPL-2.0": ["made available under the terms of the eclipse public license 2.0", "spdx license identifier epl 2.0"],
    "CC-BY-3.0": ["this work is licensed under a creative commons attribution 3.0 international license", "licensed under cc by 3.0"],
    "CC-BY-4.0": ["this work is licensed under a creative commons attribution 4.0 international license", "licensed under cc by 4.0"],
    "CC-BY-SA-3.0": ["licensed under a creative commons attribution sharealike 3.0 international license", "licensed under cc by sa 3.0"],
    "CC-BY-SA-4.0": ["licensed under a creative commons attribution sharealike 4.0 international license", "licensed under cc by sa 4.0"],
    "CC-BY-NC-4.0": ["licensed under a creative commons attribution noncommercial 4.0 international license", "licensed under cc by nc 4.0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "dedicated to the public domain"],
    "Proprietary": ["all rights reserved no part may be reproduced or distributed without written permission", "proprietary and confidential", "all rights reserved"],
}
#: Words that tell licences of one family apart.
KINDS = {
    "GPL": {"lesser": "lesser", "library": "lesser", "lgpl": "lesser", "affero": "affero", "agpl": "affero"},
    "CC": {"noncommercial": "nc", "commercial": "nc", "nc": "nc", "sharealike": "sa", "alike": "sa", "sa": "sa",
           "noderivatives": "nd", "noderivs": "nd", "nd": "nd"},
}
#: Stands in most notices of named licences too, so it is heard last.
RESERVATION = "all rights reserved"
#: Stands in the texts of both BSD licences, so it is heard where nothing better names one.
BSD_CONDITIONS = TEMPLATES["BSD-2-Clause"][2]
LATE = {BSD_CONDITIONS: 1, RESERVATION: 2}
_SIGNAL = r"(?i)licen[sc]e|copyright|spdx|permission|redistribut|public\W+domain|rights\W+reserved|\bCC[\W_]+BY|proprietary|endorse"
#: Every template has such a word.
_ANCHOR = r"licen[sc]e|copyright|spdx|permission|redistribut|^domain$|^reserved$|^cc$|proprietary|^endorse$"
_TERM = r"([a-z]+|[0-9]+(?:\.[0-9]+)*)"
_FORMS = [(licence, LATE.get(body, 0), re.findall(_TERM, body)) for licence, bodies in TEMPLATES.items() for body in bodies]
LONGEST = max(len(terms) for *_, terms in _FORMS)
_LICENCE_FILE = r"(?i)^(licen[sc]e|copying|notice)(\.[a-z]+)?$"


def _version(term: str) -> str | None:
    """The number that a term is, without a trailing ``.0``; null for words."""
    return re.sub(r"(\.0)+$", "", term) if term[0].isdigit() else None


def _contradicts(licence: str, form: list[str], before: list[str], window: list[str]) -> bool:
    """Whether a similar window cannot mean this licence: it lacks a number of the form, it is of another kind of
    the same family, or it or the two words before it say "not" where the form does not."""
    numbers = {_version(t) for t in window}
    if any(v and v not in numbers for v in map(_version, form)):
        return True
    if "not" not in form and ("not" in window or "not" in before):
        return True
    kinds = KINDS["CC"] if licence.startswith("CC-") else KINDS["GPL"] if "GPL" in licence else {}
    return {kinds[t] for t in form if t in kinds} != {kinds[t] for t in before + window if t in kinds}


def _terms(text: Column) -> Column:
    """Words and version numbers; marks glued to a word's end do not count."""
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), 1)


def units(files: DataFrame) -> DataFrame:
    """``row, n, prev, at, base, terms`` of each licence word: its place, that of the licence word before it (or 0),
    and the words from place ``base`` on that windows around it may cover, with two words before them. A window belongs
    to its first licence word."""
    words = files.filter(F.col("text").rlike(_SIGNAL)).select("row", _terms("text").alias("w"))
    places = words.select("row", "w", F.expr(f"filter(transform(w, (x, i) -> if(x rlike '{_ANCHOR}', i + 1, 0)), x -> x > 0)").alias("p"))
    around = f"""transform(p, (x, i) -> struct(size(w) as n, if(i = 0, 0, p[i - 1]) as prev, x as at, greatest(1, x - {LONGEST + 1}) as base,
        slice(w, greatest(1, x - {LONGEST + 1}), x + {LONGEST} - greatest(1, x - {LONGEST + 1})) as terms))"""
    return places.select("row", F.inline(F.expr(around)))


def _windows(found: list[tuple[int, str, float]], n: int, prev: int, at: int, base: int, forms: list[tuple], weights: dict[str, np.ndarray], threshold: float) -> Iterator[tuple]:
    """(start, end, licence, lateness, cosine) of the windows at or above the threshold that do not contradict their form,
    the best form of each."""
    terms = [t for _, t, _ in found]
    idf = np.array([x for *_, x in found])
    none = np.zeros(len(forms))
    dots = np.vstack([none, np.cumsum([weights.get(t, none) * x for t, x in zip(terms, idf)], axis=0)])
    code = np.unique(terms, return_inverse=True)[1]
    # a term that stands k times in a window adds (k idf)^2: all pairs of its places
    pairs = np.zeros((len(terms) + 1,) * 2)
    pairs[1:, 1:] = np.cumsum(np.cumsum((code[:, None] == code) * idf**2, axis=0), axis=1)
    best: dict[tuple[int, int], tuple] = {}
    for f, (licence, late, form, norm) in enumerate(forms):
        size = len(form)
        lo, hi = max(prev + 1, at - size + 1, 1), min(at, max(n - size + 1, 1))
        if lo > hi:
            continue
        i = np.arange(lo, hi + 1) - base
        j = np.minimum(i + size, len(terms))
        cos = (dots[j, f] - dots[i, f]) / (norm * np.sqrt(pairs[j, j] - pairs[i, j] - pairs[j, i] + pairs[i, i]))
        for k in np.flatnonzero(cos.round(9) >= threshold):
            if _contradicts(licence, form, terms[max(0, i[k] - 2):i[k]], terms[i[k]:j[k]]):
                continue
            place, hit = (int(i[k]) + base, int(j[k]) + base), (late, -round(float(cos[k]), 9), licence)
            best[place] = min(best.get(place, hit), hit)
    return ((start, end, licence, late, -c) for (start, end), (late, c, licence) in best.items())


def own_licences(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``row, own_license, own_score, n_notices`` of the files with a notice at or above the threshold."""
    spark = files.sparkSession
    every = staged(units(files), "license-units")
    texts = every.select("row", F.explode("terms").alias("term")).distinct()
    n = every.select("row").distinct().count() + len(_FORMS)
    given = spark.createDataFrame([(t,) for *_, terms in _FORMS for t in sorted(set(terms))], "term string")
    idf = texts.select("term").unionAll(given).groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", (F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))
    idf = staged(idf, "license-idf")
    known = dict(idf.join(F.broadcast(given.distinct()), "term").collect())  # the templates' terms only
    forms, weights = [], {t: np.zeros(len(_FORMS)) for t in known}
    for f, (licence, late, terms) in enumerate(_FORMS):
        for t in terms:
            weights[t][f] += known[t]
        forms.append((licence, late, terms, float(np.sqrt(sum(weights[t][f] ** 2 for t in set(terms))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [(r["row"], *h) for r in batch.to_pylist()
                    for h in _windows([(x["pos"], x["term"], x["idf"]) for x in r["found"]], r["n"], r["prev"], r["at"], r["base"], forms, weights, threshold)]
            cols = list(zip(*hits)) or [()] * 6
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["row", "start", "end", "license", "late", "cos"])

    weighed = every.select("row", "n", "prev", "at", "base", F.posexplode("terms").alias("pos", "term")).join(idf, "term") \
        .groupBy("row", "n", "prev", "at", "base").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "idf"))).alias("found"))  # at most 2 LONGEST words
    hits = weighed.mapInArrow(run, "row string, start int, end int, license string, late int, cos double")
    best = hits.groupBy("row").agg(
        F.min(F.struct("late", (-F.col("cos")).alias("c"), (F.col("start") - F.col("end")).alias("shorter"), "license")).alias("b"),
        F.array_sort(F.collect_list(F.struct("start", (-F.col("cos")).alias("c"), "end"))).alias("hits"))  # within one text
    # overlapping windows are one notice: the better one of two stands for it
    count = F.expr("""aggregate(hits, struct(0L as n, 0 as end, 0D as c), (a, x) -> CASE WHEN x.start >= a.end THEN struct(a.n + 1 as n, x.end as end, x.c as c)
        WHEN x.c < a.c THEN struct(a.n as n, x.end as end, x.c as c) ELSE a END, a -> a.n)""")
    return best.select("row", F.col("b.license").alias("own_license"), (-F.col("b.c")).alias("own_score"), count.alias("n_notices"))


def _parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def nearest_ancestor(dirs: DataFrame, licences: DataFrame) -> DataFrame:
    """``dir, from_dir, license``: for each directory the nearest one at or above it that has a licence.

    ``dirs`` are distinct, so a directory with a third of all files is one row; a directory gives as
    many rows as its path has parts.
    """
    parts = F.split("dir", "/")
    up = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("from_dir", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    return up.join(licences, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "license")).alias("m")).select("dir", F.col("m.from_dir").alias("from_dir"), F.col("m.license").alias("license"))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per file: the ``keep`` columns, ``path, own_license, own_score, n_notices, license, license_from``.

    ``license_from`` is ``own``, the directory that it is inherited from, or null without a licence.
    Null texts have no notices, null paths no directory. Of several licence files in a directory the
    best score, then the first name, speaks for it. Repeated rows repeat; an empty table gives no rows.
    """
    keep = keep or []
    base = files.select(*[files[c].alias(f"k_{c}") for c in keep], files[path_col].alias("path"), text_or_empty(files, text_col).alias("text"))
    # equal (path, text) rows share one verdict
    base = base.withColumn("row", F.sha2(F.concat_ws("\u0000", F.coalesce("path", F.lit("\u0001")), "text"), 256))
    own = staged(own_licences(base.select("row", "text").filter(F.col("text").rlike(_SIGNAL)).dropDuplicates(["row"]), threshold), "license-own")
    known = staged(base.drop("text").withColumn("dir", _parent(F.col("path"))).join(own, "row", "left"), "license-files")
    speaking = known.filter(F.col("own_license").isNotNull() & F.regexp_extract("path", "([^/]*)$", 1).rlike(_LICENCE_FILE))
    spoken = speaking.groupBy(F.col("dir").alias("from_dir")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), "path", F.col("own_license").alias("l"))).alias("m")) \
        .select("from_dir", F.col("m.l").alias("license"))
    dirs = known.filter("dir is not null").select("dir").distinct()
    near = nearest_ancestor(dirs, spoken)
    out = known.join(near, "dir", "left")
    return out.select(*[F.col(f"k_{c}").alias(c) for c in keep], "path", "own_license", "own_score", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"),
                      F.coalesce("own_license", "license").alias("license"),
                      F.when(F.col("own_license").isNotNull(), F.lit("own")).when(F.col("license").isNotNull(), F.col("from_dir")).alias("license_from"))


def paths(docs: DataFrame) -> DataFrame:
    """``doc_id, path, text``: documents have no paths, so each gets a folder 0 to 3 parts below its source, deeper ones
    more often; the parts are the id in thousands, five hundreds and hundreds. A hash of the id draws the depth, and which half of
    the documents with a licence word are their folder's licence file. So licence files stand at every level of every source."""
    h = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    half = F.col("h") % 2 == 0
    deep = F.floor(F.col("h") / 2)  # 0 to 31
    depth = F.when(deep < 2, 0).when(deep < 8, 1).when(deep < 16, 2).otherwise(3)
    folder = F.array_join(F.slice(F.array(*[F.floor(F.col("doc_id") / k).cast("string") for k in (1000, 500, 100)]), F.lit(1), depth), "/")
    name = F.when(half & F.col("text").rlike(_SIGNAL), F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.when(folder != "", folder), name)
    return docs.withColumn("h", h).select("doc_id", path.alias("path"), "text")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of a tree of folders, some of them licence files."""
    return scan(paths(documents(spark, sf_dir)), keep=["doc_id"])
