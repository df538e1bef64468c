"""Personal data: fixed base patterns as seeds, then bootstrapped contextual extraction.

1. Base spans (email, ip, card, phone) by fixed rules over whole texts.
2. Contexts of a span on its line: the two words to the left, the one to the left, a label of up to three
   words from the line's start, the word to the right. A pattern is a context with a kind, with the shape of
   its identifiers or (two words, label) without. Other identifier-like strings in the same contexts are
   candidates: those with four digits or an at sign, and digit groups across blanks and brackets, which need
   a pattern with their shape. A number that fails its kind's own check (Luhn, 255) speaks against a pattern.
3. Spark scores the pattern-instance graph to convergence: a pattern's confidence is the smoothed share of
   its context's distinct seeds that are of its kind; unseen instances say nothing against it, and those that a better
   pattern vouches for raise it. An instance's score is that of its best pattern.
   Words of more than ``LONGEST_WORD`` code points are no contexts, so the work is linear in a text's length.
4. Candidates with confident, well supported patterns become spans of the pattern's kind.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import documents, staged, text_or_empty

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 3  # distinct seeds that a pattern needs
CONFIDENT = 0.8
PRIOR = 0.5  # smoothing: so many instances for and against a pattern before any is seen
SETTLED = 1e-6
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_OTHER = re.compile(r"[A-Za-z0-9@._%+-]+")
_GROUPS = re.compile(r"(?<![0-9])\(?\+?[0-9]++\)?(?:[ ./-]{1,2}\(?[0-9]++\)?)+")
_DIGITS = re.compile(r"[0-9]")
_WORDS = re.compile(r"[^ \t-\r]+")
_QUADS = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_ABROAD = re.compile(r"\+[0-9]{1,3}[ -]?")
LABEL_WORDS = 3
LONGEST_WORD = 200  # code points; a longer word is no context
MOST_DIGITS = 19  # of a card or phone


def _luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(d * 2 - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def _emails(t: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their at sign: linear in the text's length."""
    out, floor, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > floor and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            floor = m.end()
        at = t.find("@", max(at + 1, floor))
    return out


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) in code points, ordered by start, then kind."""
    found = [(s, 0, e) for s, e in _emails(t)] if "@" in t else []
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(t) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(t):
        d = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and _luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(t) if 10 <= sum(map(str.isdigit, m[0])) <= 15] if "+" in t else []
    return sorted(found)


def _shape(thing: str) -> str:
    """Letters as a, digits as 0, runs of up to three digits as one; without a leading country code."""
    thing = _ABROAD.sub("", thing, count=1) if thing.startswith("+") else thing
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: "0" * len(m[0]) if len(m[0]) > 3 else "0", thing))


def _refuted(thing: str) -> str | None:
    """The kind whose form a candidate has and whose check it fails."""
    if _QUADS.fullmatch(thing):
        return "ip"
    digits = thing.replace(" ", "").replace("-", "")
    return "card" if _CARD.fullmatch(thing) and 14 <= len(digits) <= MOST_DIGITS else None


def _contexts(t: str, words: list[tuple[int, int]], line: int, start: int, end: int) -> list[str]:
    """The contexts of a place on the line that begins at ``line``, lower case. ``words`` are the spans of all
    words of the text; parts of a word beside the place count as words."""
    i = bisect_left(words, (start, start)) - 1
    before: list[tuple[int, int]] = []
    while i >= 0 and words[i][0] >= line and len(before) <= LABEL_WORDS:
        before.append((words[i][0], min(words[i][1], start)))
        i -= 1
    left = [t[a:b] if b - a <= LONGEST_WORD else None for a, b in reversed(before)]
    out = ["2:" + " ".join(left[-2:])] if len(left) > 1 and None not in left[-2:] else []
    out += ["1:" + left[-1]] if left and left[-1] is not None else []
    out += ["^:" + " ".join(left)] if 0 < len(left) <= LABEL_WORDS and None not in left else []
    i = bisect_right(words, (end, end)) - 1
    a, b = (end, words[i][1]) if i >= 0 and words[i][1] > end else words[i + 1] if i + 1 < len(words) else (0, 0)
    if 0 < b - a <= LONGEST_WORD and not t[end:a].strip(" \t"):
        out.append("r:" + t[a:b])
    return [c.lower() for c in out]


def _candidates(t: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, grouped) of identifier-like strings that meet no base span."""
    plain = [(m.start(), m.start() + len(m[0].rstrip("._%+-"))) for m in _OTHER.finditer(t) if "@" in m[0] or len(_DIGITS.findall(m[0])) >= 4]
    groups = [m.span() for m in _GROUPS.finditer(t) if 4 <= sum(c.isdigit() for c in m[0]) <= MOST_DIGITS]
    known, taken, i, out = set(plain), sorted((s, e) for s, _, e in spans), 0, []
    for s, e, grouped in sorted([(*x, False) for x in plain] + [(*x, True) for x in groups if x not in known]):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if i == len(taken) or taken[i][0] >= e:
            out.append((s, e, grouped))
    return out


_HAS = re.compile(r"[0-9@]")
_FACT = "array<struct<kind:string,refuted:string,grouped:boolean,shape:string,contexts:array<string>,thing:string,start:int,end:int>>"
_FIELDS = f"row long, doc_id {{}}, n_email long, n_ip long, n_card long, n_phone long, base string, facts {_FACT}"
_NAMES = ("row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "facts")


def _facts(t: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    seen = sorted([(s, e, KINDS[k], False) for s, k, e in spans] + [(s, e, None, grouped) for s, e, grouped in _candidates(t, spans)], key=lambda x: x[:2])
    words = [m.span() for m in _WORDS.finditer(t)] if seen else []
    out, line, at = [], 0, 0
    for s, e, kind, grouped in seen:
        line, at = max(line, t.rfind("\n", at, s) + 1), s
        contexts = _contexts(t, words, line, s, e)
        if contexts:
            out.append({"kind": kind, "refuted": None if kind else _refuted(t[s:e]), "grouped": grouped, "shape": _shape(t[s:e]), "contexts": contexts, "thing": t[s:e], "start": s, "end": e})
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: base counts and spans, and every seed (kind given) and candidate (kind null) with its contexts."""
    id_type = docs.schema[id_col].dataType.simpleString()
    fact = pa.list_(pa.struct([("kind", pa.string()), ("refuted", pa.string()), ("grouped", pa.bool_()), ("shape", pa.string()), ("contexts", pa.list_(pa.string())),
                               ("thing", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            cols: list[list] = [[] for _ in _NAMES]
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = base_spans(t) if _HAS.search(t) else []
                n = [sum(k == i for _, k, _ in spans) for i in range(4)]
                values = [row, doc_id, *n, ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans), _facts(t, spans) if _HAS.search(t) else []]
                for c, v in zip(cols, values):
                    c.append(v)
                row += 1
            types = [pa.int64(), batch.schema.field(0).type, *[pa.int64()] * 4, pa.string(), fact]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], names=list(_NAMES))

    return docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs, text_col).alias("text")).mapInArrow(run, _FIELDS.format(id_type))


def in_patterns(facts: DataFrame) -> DataFrame:
    """One row per fact and pattern it may stand in: ``left`` is the pattern (context, and shape or nothing), ``context`` the
    context alone. Single words need the shape; grouped candidates too."""
    each = facts.select("*", F.explode("contexts").alias("context")).drop("contexts")
    bare = F.col("context").rlike(r"^[2^]:") & ~F.col("grouped")
    return each.select("*", F.explode(F.when(bare, F.array(F.col("shape"), F.lit(""))).otherwise(F.array("shape"))).alias("s")) \
        .withColumn("left", F.concat_ws("\u0000", "context", "s")).drop("s", "shape", "grouped")


def score_graph(facts: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """``facts``: kind (null for candidates), refuted (a kind or null), context, left (the pattern), thing. Returns patterns
    (left, p_kind, confidence) and the scores of candidates (thing, p_kind, score). Only patterns with enough distinct seeds
    enter the graph. Against a pattern speak the seeds of other kinds in its context, of any shape, and its refuted candidates.

    Confidences only rise, by candidates that another pattern holds surer than this one does, and never above the
    surest pattern. A pattern is no witness for itself, so its number of candidates changes nothing."""
    seeds = facts.filter("kind is not null").select("context", "left", F.col("kind").alias("p_kind"), "thing").distinct()
    own = seeds.groupBy("context", "left", "p_kind").agg(F.count(F.lit(1)).alias("pro")).filter(F.col("pro") >= support)
    by_kind = seeds.select("context", "p_kind", "thing").distinct().groupBy("context", "p_kind").agg(F.count(F.lit(1)).alias("n"))
    others = by_kind.join(by_kind.groupBy("context").agg(F.sum("n").alias("all")), "context").select("context", "p_kind", (F.col("all") - F.col("n")).alias("other"))
    failed = facts.filter("kind is null and refuted is not null").select("left", F.col("refuted").alias("p_kind"), "thing").distinct().groupBy("left", "p_kind").agg(F.count(F.lit(1)).alias("failed"))
    base = staged(own.join(others, ["context", "p_kind"]).join(failed, ["left", "p_kind"], "left")
                  .select("left", "p_kind", "pro", (F.col("other") + F.coalesce("failed", F.lit(0))).alias("con")), "pii-patterns")
    edges = staged(facts.filter("kind is null").select("left", "thing", "refuted").distinct().join(base.select("left", "p_kind"), "left")
                   .filter(~F.col("refuted").eqNullSafe(F.col("p_kind"))).select("left", "thing", "p_kind"), "pii-edges")

    def ratio(pro: Column, con: Column) -> Column:
        return (pro + PRIOR) / (pro + con + 2 * PRIOR)

    conf = base.select("left", "p_kind", "pro", "con", ratio(F.col("pro"), F.col("con")).alias("confidence"))
    while True:
        links = edges.join(conf.select("left", "p_kind", "confidence"), ["left", "p_kind"])
        score = links.groupBy("thing", "p_kind").agg(F.max("confidence").alias("score"))
        heard = links.join(score, ["thing", "p_kind"]).filter(F.col("score") > F.col("confidence")).groupBy("left", "p_kind") \
            .agg(F.sum("score").alias("more"), F.sum(1 - F.col("score")).alias("less"))
        risen = conf.join(heard, ["left", "p_kind"], "left").select("left", "p_kind", "pro", "con", F.col("confidence").alias("before"), F.greatest(
            "confidence", ratio(F.col("pro") + F.coalesce("more", F.lit(0.0)), F.col("con") + F.coalesce("less", F.lit(0.0)))).alias("confidence")).checkpoint()
        rise = risen.agg(F.max(F.col("confidence") - F.col("before"))).first()[0]
        conf = risen.drop("before")
        if (rise or 0.0) < SETTLED:
            return conf.select("left", "p_kind", "confidence"), score


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confident: float = CONFIDENT) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    ``spans`` holds the base spans and those discovered, as kind:start:end. Null text counts as empty;
    rows with repeated or null ids are judged each by their own text; an empty table gives no rows.
    """
    from tarmac.session import checkpoint_dir

    checkpoint_dir(docs.sparkSession)
    rows = staged(scan(docs, id_col, text_col), "pii-scan")
    facts = in_patterns(rows.select("row", F.inline("facts")))
    conf, score = score_graph(facts)
    # the score of a thing holds where one of its sure patterns stands
    found = facts.filter("kind is null").join(conf.filter(F.col("confidence") >= confident), "left") \
        .filter(~F.col("refuted").eqNullSafe(F.col("p_kind"))).join(score.filter(F.col("score") >= confident), ["thing", "p_kind"])
    one = found.groupBy("row", "start", "end").agg(F.max(F.struct("confidence", "p_kind")).alias("b"))
    hits = one.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), F.col("b.p_kind").alias("kind")))).alias("hits"))  # within one text
    # of overlapping finds the leftmost, then the longest stays
    apart = F.expr("""aggregate(hits, struct(cast(array() as array<struct<start:int,kind:string,end:int>>) as kept, 0 as upto), (a, x) -> CASE WHEN x.start >= a.upto
        THEN struct(concat(a.kept, array(struct(x.start as start, x.kind as kind, -x.back as end))) as kept, -x.back as upto) ELSE a END, a -> a.kept)""")
    extra = hits.select("row", apart.alias("extra"))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(
        F.split(x, ":")[1].cast("int").alias("start"), F.split(x, ":")[0].alias("kind"), F.split(x, ":")[2].cast("int").alias("end")))
    every = F.when(F.col("extra").isNull(), base).otherwise(F.concat(base, F.col("extra")))
    ranked = F.array_sort(F.transform(every, lambda x: F.struct(x["start"].alias("start"), F.element_at(order, x["kind"]).alias("o"), x["kind"].alias("kind"), x["end"].alias("end"))))
    spans = F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return rows.join(extra, "row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))
