"""Hidden Markov language model over words.

Symbols: the ``FREQUENT`` most frequent words each, every other word by one of ``CLASSES`` shape
classes; inside a class a word has its add-one share, (c + 1) / (N_class + V_class + 1), from exact
counts over all training documents. So the model's arrays have a fixed size while the counts, met by
a join for words outside the broadcast head, grow with the corpus.

Baum-Welch: each round every task runs a scaled forward-backward pass over its training documents
(cut into segments of ``SEGMENT`` words, vectorised over segments) and sends expected counts, which
Spark adds up; all training documents take part in every round (in the first one part after another, its first half from
three random starts), and rounds go on until the likelihood settles. A segment is run with ``BURN_IN`` more words of
its document on either side, which are not counted, so every move between words counts once, in its context. Scoring: the scaled forward recursion
over the whole word sequence gives the exact likelihood.
"""

from __future__ import annotations

import copy
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import documents, staged, text_or_empty

STATES = 6
STARTS = 3
PARTS = 8  # steps of the first round
SETTLED = 0.02  # gain in log10 per word below which training ends
FREQUENT = 4096
HEAD = 100_000  # words whose counts every task holds
CLASSES = 256
SEGMENT = 224
BURN_IN = 16
END = b""


def _class_of(word: bytes) -> int:
    """Shape: first two bytes, last byte when it is a mark, and coarse length."""
    last = word[-1:] if word[-1:] in b".,;:!?%$*#&|" else b"a"
    return zlib.crc32(word[:2] + last + bytes([min(len(word) // 4, 3)])) % CLASSES


def _tokens(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def _held_out(col):
    return F.coalesce(F.crc32(col.cast("string")) % 7 == 2, F.lit(False))


def _octave():
    return F.floor(F.log2("c") * 16).cast("int")


def word_counts(rows: DataFrame, flush: int = 300_000) -> DataFrame:
    """``word, cls, c`` over all rows: counted per task, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out():
            words = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([_class_of(w) for w in words], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "cls", "c"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(_tokens(t))
                if len(counts) >= flush:
                    yield out()
                    counts.clear()
        yield out()

    return rows.select("text").mapInArrow(run, "word binary, cls int, c long").groupBy("word", "cls").agg(F.sum("c").alias("c"))


class _Index(dict):
    """Word -> its place in the head, or HEAD + class. Filled from the head; other words are remembered
    up to a bound, so that most tokens cost one look-up."""

    def __init__(self, head: list[bytes], limit: int = 500_000):
        super().__init__((w, i) for i, w in enumerate(head))
        self.first, self.limit = len(head), len(head) + limit

    def __missing__(self, word: bytes) -> int:
        i = self.first + _class_of(word)
        if len(self) < self.limit:
            self[word] = i
        return i


class Model:
    """Arrays of a fixed size: symbols of the head words, class totals, and the HMM's parameters."""

    def __init__(self, head: list[tuple[bytes, int]], classes: dict[int, tuple[int, int]], n: int, v: int, states: int = STATES, seed: int = 11, frequent: int = FREQUENT):
        self.n, self.v = n, v
        self.own = min(frequent, len(head))
        self.symbols = self.own + CLASSES
        self.head = [w for w, _ in head]
        self.cut = 1 << 20  # words outside the head lie below this sixteenth-octave
        counts = np.array([c for _, c in head], float)
        self.class_total = np.zeros(CLASSES, np.int64)
        self.class_words = np.zeros(CLASSES, np.int64)
        for k, (total, words) in classes.items():
            self.class_total[k], self.class_words[k] = total, words
        self.inside = np.log10((self.class_total + self.class_words + 1).astype(float))
        # by index (see _Index): symbol, log10 of the base probability, log10 of the share in the class
        cls = np.array([_class_of(w) for w in self.head], np.int64)
        own = np.arange(len(head)) < self.own
        self.symbol_of = np.concatenate([np.where(own, np.arange(len(head)), self.own + cls), self.own + np.arange(CLASSES)]).astype("<u2")
        self.base_of = np.concatenate([np.log10((counts + 1) / (n + v + 1)), np.zeros(CLASSES)])
        self.share_of = np.concatenate([np.where(own, 0.0, np.log10(counts + 1) - self.inside[cls]), np.zeros(CLASSES)])
        unigram = np.concatenate([counts[: self.own], self.class_total]) + 1.0
        self.unigram = unigram / unigram.sum()
        self.seed = seed
        self.start = np.full(states, 1.0 / states)
        self.occupied = self.start.copy()
        self.move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(self.move, 0.9 if states > 1 else 1.0)
        self.scatter(seed)

    def scatter(self, seed: int) -> None:
        """Random words of their own for every state."""
        emit = self.unigram * np.exp(np.random.RandomState(seed).normal(0, 1.0, (len(self.start), self.symbols)))
        self.emit = emit / emit.sum(axis=1, keepdims=True)

    def another(self, i: int) -> Model:
        """The same words and counts from the ``i``-th random start (0: this one's); ``update`` replaces arrays, so nothing is shared that changes."""
        other = copy.copy(self)
        if i:
            other.scatter(self.seed + i)
        return other

    def take(self, other: Model) -> None:
        """The parameters of a model of the same words."""
        self.start, self.occupied, self.move, self.emit = other.start, other.occupied, other.move, other.emit

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        """New parameters from expected counts; a little of the unigram keeps every symbol possible."""
        self.occupied = (emit.sum(axis=1) + 1.0) / (emit.sum() + len(emit))
        self.start = (start + 1.0) / (start.sum() + len(start))
        self.move = (move + 1.0) / (move + 1.0).sum(axis=1, keepdims=True)
        emit = emit + 50.0 * self.unigram
        self.emit = emit / emit.sum(axis=1, keepdims=True)

    def expect(self, seq: np.ndarray, length: np.ndarray, first: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts of padded segments (rows of ``seq``, longest first), of the words from ``core[:, 0]`` to
        ``core[:, 1]`` of each and of the moves into them."""
        return self.sweep(seq, length, first, core)[:3]

    def sweep(self, seq: np.ndarray, length: np.ndarray, first: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """``expect`` and the log10 likelihood of the counted words, each given the words before it in its segment."""
        b, k, steps = len(seq), len(self.start), int(length.max())
        table = self.emit.T
        active = [int((length > t).sum()) for t in range(steps)]
        alpha = np.zeros((steps, b, k))
        scale = np.ones((steps, b))
        for t in range(steps):
            n = active[t]
            a = np.where(first[:n, None], self.start, self.occupied) if t == 0 else alpha[t - 1, :n] @ self.move
            a = a * table[seq[:n, t]]
            scale[t, :n] = a.sum(axis=1)
            alpha[t, :n] = a / scale[t, :n, None]
        beta = np.ones((b, k))
        gamma = np.zeros((steps, b, k))
        move = np.zeros((k, k))
        for t in range(steps - 1, -1, -1):
            n = active[t]
            gamma[t, :n] = alpha[t, :n] * beta[:n]
            if t:
                back = table[seq[:n, t]] * beta[:n] / scale[t, :n, None]
                counted = (core[:n, 0] <= t) & (t < core[:n, 1])
                move += self.move * (alpha[t - 1, :n].T @ (back * counted[:, None]))
                beta[:n] = back @ self.move.T
        emit = np.zeros_like(self.emit)
        place = np.arange(steps)[:, None]
        mask = (core[:, 0] <= place) & (place < core[:, 1])
        flat, syms = gamma[mask], seq[:, :steps].T[mask]
        for s in range(k):
            emit[s] = np.bincount(syms, weights=flat[:, s], minlength=self.symbols)
        return gamma[0][first].sum(axis=0), move, emit, float(np.log10(scale[mask]).sum())

    def log10_forward(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of whole symbol sequences, vectorised over documents, longest first."""
        order = np.argsort([-len(s) for s in seqs], kind="stable")
        lens = np.array([len(seqs[i]) for i in order])
        flat = np.concatenate([seqs[i] for i in order]).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(lens)[:-1]])
        table, total = self.emit.T, np.zeros(len(seqs))
        a = None
        for t in range(int(lens[0])):
            n = int(np.searchsorted(-lens, -t, side="left"))  # documents longer than t
            a = (np.broadcast_to(self.start, (n, len(self.start))) if t == 0 else a[:n] @ self.move) * table[flat[at[:n] + t]]
            z = a.sum(axis=1)
            total[:n] += np.log10(z)
            a = a / z[:, None]
        out = np.empty(len(seqs))
        out[order] = total
        return out


def indexed(rows: DataFrame, model: Model) -> DataFrame:
    """Per row: ``row, doc_id, held_out, n_tokens, known, base, share``, the symbols, and the words outside
    the head with their counts. Written once; training rounds and scoring read it instead of the texts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "share", "symbols", "words", "kinds", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        row = TaskContext.get().partitionId() << 33
        index = _Index(m.head)
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for t in batch.column(2).to_pylist():
                tokens = _tokens(t)
                at = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
                out = np.flatnonzero(at >= index.first).tolist()
                rare = Counter([tokens[i] for i in out])
                for c, x in zip(cols, (len(tokens), len(tokens) - len(out), float(m.base_of[at].sum()), float(m.share_of[at].sum()), m.symbol_of[at].tobytes(), list(rare), [index[w] - index.first for w in rare], list(rare.values()))):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + batch.num_rows)), *batch.columns[:2], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)
            row += batch.num_rows

    schema = f"row long, doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, share double, symbols binary, words array<binary>, kinds array<int>, times array<int>"
    return staged(rows.select("doc_id", "held_out", "text").mapInArrow(run, schema), "hmm-indexed")


def _expected(train: DataFrame, model: Model) -> np.ndarray | None:
    """Expected counts of the given training rows (``symbols``), added up by Spark. One row per state: starts, moves,
    symbols, and last the log10 likelihood (in the first row)."""
    shared = train.sparkSession.sparkContext.broadcast(model)
    k, s = len(model.start), model.symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        start, move, emit, fit = np.zeros(k), np.zeros((k, k)), np.zeros((k, s)), np.zeros(k)
        for batch in batches:
            pieces, firsts, cores = [], [], []

            def flush():
                nonlocal start, move, emit
                order = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
                length = np.array([len(pieces[i]) for i in order])
                seq = np.zeros((len(order), int(length[0])), np.int64)
                for r, i in enumerate(order):
                    seq[r, : len(pieces[i])] = pieces[i]
                e = m.sweep(seq, length, np.array([firsts[i] for i in order]), np.array([cores[i] for i in order]))
                start, move, emit = start + e[0], move + e[1], emit + e[2]
                fit[0] += e[3]
                pieces.clear()
                firsts.clear()
                cores.clear()

            for raw in batch.column(0).to_pylist():
                syms = np.frombuffer(raw, "<u2")
                for i in range(0, len(syms), SEGMENT):
                    low = max(0, i - BURN_IN)
                    pieces.append(syms[low:i + SEGMENT + BURN_IN])
                    firsts.append(i == 0)
                    cores.append((i - low, min(i + SEGMENT, len(syms)) - low))
                    if len(pieces) >= 1024:
                        flush()
            if pieces:
                flush()
        salt = TaskContext.get().partitionId() % 64
        vectors = [np.concatenate([start[i:i + 1], move[i], emit[i], fit[i:i + 1]]).tobytes() for i in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([salt] * k, pa.int32()), pa.array(vectors, pa.binary())], names=["state", "salt", "counts"])

    def add(key, batches):
        total = np.zeros(2 + k + s)
        for batch in batches:
            for x in batch.column("counts").to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["state", "salt", "counts"])

    # Spark reads the streaming form of a grouped function from its type hints
    add.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    schema = "state int, salt int, counts binary"
    sums = train.select("symbols").mapInArrow(run, schema).groupBy("state", "salt").applyInArrow(add, schema).groupBy("state").applyInArrow(add, schema)
    found = {r.state: np.frombuffer(r.counts) for r in sums.collect()}  # one vector per state
    return np.stack([found[i] for i in range(k)]) if found else None


def _renew(model: Model, sums: np.ndarray) -> None:
    k = len(model.start)
    model.update(sums[:, 0], sums[:, 1:1 + k], sums[:, 1 + k:-1])


def _one_round(train: DataFrame, model: Model) -> None:
    """New parameters from the expected counts of all the rows at once."""
    sums = _expected(train, model)
    if sums is not None:
        _renew(model, sums)


def fit(train: DataFrame, model: Model, rounds: int | None = None, starts: int = STARTS, parts: int = PARTS, settled: float = SETTLED) -> list[float]:
    """Baum-Welch over all training rows. The first round takes the rows in ``parts`` by a hash and renews the parameters
    after each part from that part's counts alone, which tells the states apart sooner. Half-way the best of ``starts``
    random starts, by the likelihood of the last part, goes on alone. Every later round adds up the counts of all rows.
    Rounds end when one raises the log10 likelihood per word by less than ``settled`` (or after ``rounds``). Returns
    that likelihood for each round after the first; rows without words teach nothing."""

    def step(m: Model, rows: DataFrame) -> float | None:
        """New parameters of ``m``; the likelihood per word under the old ones."""
        sums = _expected(rows, m)
        words = 0.0 if sums is None else float(sums[:, 1 + len(m.start):-1].sum())
        if not words:
            return None
        _renew(m, sums)
        return float(sums[0, -1]) / words

    if rounds == 0:
        return []
    dealt = [train.filter(F.pmod(F.xxhash64("row"), F.lit(parts)) == p) for p in range(parts)]
    tries = [model.another(i) for i in range(starts)]
    reached = []
    for m in tries:
        seen = [x for x in (step(m, rows) for rows in dealt[:parts // 2]) if x is not None]
        reached.append(seen[-1] if seen else float("-inf"))
    best = tries[reached.index(max(reached))]
    for rows in dealt[parts // 2:]:
        step(best, rows)
    history: list[float] = []
    while rounds is None or len(history) + 1 < rounds:
        now = step(best, train)
        if now is None:
            break
        history.append(now)
        if len(history) > 1 and history[-1] - history[-2] < settled:
            break
    model.take(best)
    return history


def train_model(rows: DataFrame, states: int = STATES, rounds: int | None = None, head_words: int = HEAD, frequent: int = FREQUENT) -> tuple[Model, DataFrame, DataFrame]:
    """``rows``: doc_id, held_out, text. The model, the exact counts (word, cls, c) of all rows that are
    not held out, and the indexed rows."""
    counts = staged(word_counts(rows.filter("not held_out")), "hmm-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # the head: every word whose count is in the top sixteenth-octaves that hold head_words words at most
    room, cut = head_words, 1 << 20
    for r in sorted(counts.groupBy(_octave().alias("o")).agg(F.count(F.lit(1)).alias("w")).collect(), key=lambda r: -r.o):  # about 1,000 rows at most
        room -= r.w
        if room < 0:
            break
        cut = r.o
    head = sorted(((bytes(r.word), r.c) for r in counts.filter(_octave() >= cut).collect()), key=lambda x: (-x[1], x[0]))
    classes: dict[int, list[int]] = {r.cls: [r.c, r.v] for r in counts.groupBy("cls").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()}
    for w, c in head[:frequent]:  # frequent words have symbols of their own
        classes[_class_of(w)][0] -= c
        classes[_class_of(w)][1] -= 1
    model = Model(head, {k: (a, b) for k, (a, b) in classes.items()}, int(n), int(v), states, frequent=frequent)
    model.cut = cut
    table = indexed(rows, model)
    fit(table.filter("not held_out"), model, rounds)
    return model, counts, table


def score(table: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every indexed row."""
    shared = table.sparkSession.sparkContext.broadcast(model)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ll = shared.value.log10_forward([np.frombuffer(x, "<u2") for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ll)], names=["f_row", "model"])

    paths = table.select("row", "symbols").mapInArrow(forward, "f_row long, model double")

    # the head was resolved in the tasks; only other words are shuffled, to counts that are not in the head
    rare = table.select("row", F.explode(F.arrays_zip("words", "kinds", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.kinds").alias("kind"), F.col("w.times").alias("k"))
    met = rare.join(counts.filter(_octave() < model.cut).select("word", "c"), "word", "left")
    inside = F.element_at(F.array(*[F.lit(float(x)) for x in model.inside]), F.col("kind") + 1)
    log_count = F.log10(F.coalesce("c", F.lit(0)) + 1)  # an unseen word takes the one spare share of its class
    unit = float(np.log10(model.n + model.v + 1))
    sums = met.groupBy(F.col("row").alias("s_row")).agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * (log_count - unit)).alias("more_base"),
                                                        F.sum(F.col("k") * (log_count - inside)).alias("more_share"))
    joined = table.drop("symbols", "words", "kinds", "times").join(paths, F.col("row") == F.col("f_row")).join(sums, F.col("row") == F.col("s_row"), "left")
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("model") + F.col("share") + F.coalesce("more_share", F.lit(0.0))).alias("score"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text counts as empty (one end token); repeated rows and null ids (which train) are scored each
    by their text; without training rows every word takes its class's spare share."""
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), text_or_empty(docs).alias("text"))
    model, counts, table = train_model(rows)
    return score(table, model, counts)
