"""A hidden Markov language model.

Tokens are words and an end for each document. A token's class is itself for the `OWN` most frequent tokens and the last
letters' hash for others; the model's latent states emit classes, and a class emits its tokens by their training counts, with a
Good-Turing share for unknown tokens. Words thus cost an exact distributed count, and the states' parameters have a fixed size.

Training is Baum-Welch: every round each partition computes its expected counts by scaled forward and backward recursions over
all training documents, each of them whole, and the counts are summed by class. Long documents are worked on in runs of `RUN`
tokens, side by side, between states carried from run to run exactly. Scoring is the scaled forward recursion over
whole documents, which gives the exact likelihood. Token counts that aren't among the `COMMON` most frequent are joined
by shuffle, for those tokens alone.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, told apart by 64-bit hashes under a key that the whole corpus gives; it also decides between tokens of equal counts. Null text counts as empty: its end is its one
token. Repeated rows count and are scored each. A null doc_id belongs to the training part. Without training documents all tokens are
unknown. An empty table gives no row. Input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import corpus_key, low_words, mix, run_hashes, saved, text_slices

STATES, ROUNDS, OWN, SUFFIXES, COMMON, SEED = 8, 5, 4096, 1024, 262_144, 9
#: Tokens of a run, and runs worked on side by side; neither changes a result.
RUN, SIDE_BY_SIDE = 512, 1024
#: A prior's weight on each state's emissions and transitions, in tokens; the chance to stay in a state at first.
PRIOR, STAY = 200.0, 0.95
END = -1
#: Distinct tokens after which a task hands on its counts; tokens of documents scored side by side.
CHUNK_TOKENS, SCORED_TOKENS = 4_000_000, 4_000_000


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds, F.lit(0))


def token_ids(column: pa.Array, secret: tuple[int, int] = (0, 0)) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, ids of all their tokens, ends included, tokens of each). An id's low bits are the class of the last letters."""
    for rows, u, begin in text_slices(column):
        low, starts, size, n = low_words(u, begin)
        h = run_hashes(low, starts, size, secret)
        last = starts + size - 1
        tail = np.zeros(len(last), np.uint64)
        for back in range(3):
            tail = (tail << np.uint64(8)) | np.where(size > back, low[last - np.minimum(size - 1, back)], 0).astype(np.uint64)
        ids = (h & ~np.uint64(SUFFIXES - 1)) | (mix(tail) & np.uint64(SUFFIXES - 1))
        out = np.full(len(ids) + len(n), END, np.int64)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids.view(np.int64)
        yield rows, out, n + 1


def token_counts(docs: DataFrame, secret: tuple[int, int]) -> DataFrame:
    """Saved (id, c): counts of all tokens of the training documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            nonlocal held, size
            ids, n = np.unique(np.concatenate(held), return_counts=True)
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], ["id", "c"])

        for batch in batches:
            for _, ids, _ in token_ids(batch.column("text"), secret):
                held.append(ids)
                size += len(held[-1])
                if size >= CHUNK_TOKENS:
                    yield counted()
        if held:
            yield counted()

    return saved(docs.filter("not held").select("text").mapInArrow(rows, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")), "token-counts")


@dataclass
class Vocabulary:
    """Sizes of the training part, its most frequent tokens, and for each class of last letters its tokens (T), the share of
    unknown ones (g)."""

    tokens: int
    distinct: int
    ids: np.ndarray  # ascending
    c: np.ndarray
    own: np.ndarray  # class of each of `ids`: 0.. for those with one of their own, else -1
    total: np.ndarray
    unknown: np.ndarray

    @property
    def classes(self) -> int:
        return OWN + SUFFIXES

    def look_up(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(counts, 0 for ids that aren't common; classes)."""
        cls = OWN + (ids & (SUFFIXES - 1))
        if not len(self.ids):
            return np.zeros(len(ids), np.int64), np.where(ids == END, 0, cls)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        met = self.ids[at] == ids
        own = np.where(met, self.own[at], -1)
        return np.where(met, self.c[at], 0), np.where(own >= 0, own, np.where(ids == END, 0, cls))

    def priors(self, own_c: np.ndarray) -> np.ndarray:
        p = np.concatenate([own_c, self.total]) + 0.5
        return p / p.sum()


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary, and the counts of the tokens with classes of their own, by class. The driver gets COMMON rows at most:
    a histogram of the counts' logarithms tells from which count on tokens are common."""
    size = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    sizes = counts.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect()
    least, room = 1 << 30, COMMON
    for r in sizes:
        room -= r["count"]
        if room < 0:
            break
        least = r["size"]
    top = counts.filter(size >= least).toPandas().sort_values(["c", "id"], ascending=[False, True])
    ids, c = top["id"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    own = np.full(len(ids), -1)
    first = np.flatnonzero(ids != END)[: OWN - 1]
    own[first] = np.arange(1, len(first) + 1)
    own[ids == END] = 0
    own_c = np.zeros(OWN)
    own_c[own[own >= 0]] = c[own >= 0]
    n = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    suffix = F.col("id").bitwiseAND(F.lit(SUFFIXES - 1)).cast("int").alias("k")
    by = counts.filter(F.col("id") != END).groupBy(suffix).agg(F.sum("c").alias("t"), F.sum((F.col("c") == 1).cast("long")).alias("once")).toPandas()
    total, once = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    total[by["k"]], once[by["k"]] = by["t"], by["once"]
    rare_own = own > 0
    np.subtract.at(total, ids[rare_own] & (SUFFIXES - 1), c[rare_own])
    np.subtract.at(once, ids[rare_own] & (SUFFIXES - 1), (c[rare_own] == 1).astype(float))
    unknown = np.where(total > 0, (once + 0.5) / (total + 1), 1.0)
    order = np.argsort(ids)
    return Vocabulary(int(n["n"] or 0), int(n["v"]), ids[order], c[order], own[order], total, unknown), own_c


def encoded(docs: DataFrame, voc: Vocabulary, secret: tuple[int, int]) -> DataFrame:
    """Saved (row, doc_id, held, n_tokens, known, base, inner, classes, rare, times): what common tokens give to n_known, to
    the base score and to the classes' part of the score; the class of every token; the other tokens' ids and how often each occurs."""
    floor = voc.tokens + 0.5 * (voc.distinct + 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, ids, n in token_ids(batch.column("text"), secret):
                c, cls = voc.look_up(ids)
                first = np.cumsum(n) - n
                seen = c > 0
                base = np.where(seen, np.log10((c + 0.5) / floor), 0)
                suffix = ids & (SUFFIXES - 1)
                inner = np.where(seen & (cls >= OWN), np.log10(np.maximum(1 - voc.unknown[suffix], 1e-300) * np.maximum(c, 1) / np.maximum(voc.total[suffix], 1)), 0)
                rare, times = [], []
                for lo, k in zip(first.tolist(), n.tolist(), strict=True):
                    r, m = np.unique(ids[lo : lo + k][~seen[lo : lo + k]], return_counts=True)
                    rare.append(r)
                    times.append(m)
                ends = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
                codes = cls.astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row")[s], batch.column("doc_id")[s], batch.column("held")[s], pa.array(n), pa.array(np.add.reduceat(seen, first).astype(np.int64)), pa.array(np.add.reduceat(base, first)),
                        pa.array(np.add.reduceat(inner, first)), pa.array([codes[lo : lo + k].tobytes() for lo, k in zip(first.tolist(), n.tolist(), strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(ends, pa.array(np.concatenate(rare), pa.int64())), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(times).astype(np.int64))),
                    ],
                    ["row", "doc_id", "held", "n_tokens", "known", "base", "inner", "classes", "rare", "times"],
                )

    schema = "row long, doc_id long, held boolean, n_tokens long, known long, base double, inner double, classes binary, rare array<long>, times array<long>"
    return saved(docs.mapInArrow(rows, schema), "encoded", compression="zstd")


@dataclass
class Model:
    start: np.ndarray  # S
    step: np.ndarray  # S x S
    emit: np.ndarray  # classes x S

    @classmethod
    def first(cls, prior: np.ndarray, states: int = STATES) -> Model:
        """Sticky states whose emissions differ from the overall ones at random."""
        noise = np.random.default_rng(SEED).gamma(1.0, 1.0, (len(prior), states)) + 0.05
        emit = prior[:, None] * noise
        step = np.full((states, states), (1 - STAY) / max(1, states - 1))
        np.fill_diagonal(step, STAY if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), step, emit / emit.sum(0))

    @classmethod
    def of_counts(cls, start: np.ndarray, step: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
        s = len(start)
        emit = emit + PRIOR * prior[:, None]
        step = step + PRIOR / s * np.full((s, s), 1 / s)
        start = start + 1 / s
        return cls(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


class Runs:
    """Whole sequences cut into runs of at most `size` tokens, the longest runs first, so that those still going on after t tokens are a
    head of the list. `number[d, j]` is that of sequence d's run j, -1 beyond its last."""

    def __init__(self, docs: list[np.ndarray], size: int = RUN):
        n = np.array([len(d) for d in docs])
        runs = -(-n // size)
        doc = np.repeat(np.arange(len(n)), runs)
        j = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        length = np.minimum(size, n[doc] - j * size)
        by = np.argsort(-length, kind="stable")
        self.flat, self.begin, self.size = np.concatenate(docs), ((np.cumsum(n) - n)[doc] + j * size)[by], length[by]
        self.number = np.full((len(n), runs.max()), -1)
        self.number[doc[by], j[by]] = np.arange(len(by))

    def __len__(self) -> int:
        return len(self.begin)

    def going(self, lo: int, hi: int) -> list[int]:
        """How many of runs lo..hi have more than t tokens, for each t."""
        size = self.size[lo:hi]
        return np.searchsorted(-size, -np.arange(1, size[0] + 1), "right").tolist()

    def neighbours(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """(runs j - 1, runs j) of the sequences that have a run j."""
        has = self.number[:, j] >= 0
        return self.number[has, j - 1], self.number[has, j]


def transfers(x: Runs, own: np.ndarray, step: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of runs `own`, matrices from the state of the first token to that of the last one, all tokens seen; scaled to a sum of 1."""
    s = len(step)
    out = np.empty((len(own), s, s), step.dtype)
    for lo in range(0, len(own), 512):
        some = own[lo : lo + 512]
        begin, size = x.begin[some], x.size[some]
        m = b[x.flat[begin]][:, None, :] * np.eye(s, dtype=step.dtype)
        for t in range(1, int(size[0])):
            k = int(np.searchsorted(-size, -t, "left"))
            m[:k] = (m[:k].reshape(-1, s) @ step).reshape(k, s, s) * b[x.flat[begin[:k] + t]][:, None, :]
            if t % 4 == 0:
                m[:k] /= m[:k].sum((1, 2), keepdims=True)
        out[lo : lo + 512] = m / m.sum((1, 2), keepdims=True)
    return out


def ends(x: Runs, start: np.ndarray, step: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chances of the states before each run's first token is seen, backward chances at its last one), over whole sequences: products
    of the runs' transfer matrices carry both from run to run."""
    before, after = np.tile(start, (len(x), 1)), np.ones((len(x), len(start)), start.dtype)
    if x.number.shape[1] > 1:
        own = np.sort(x.number[x.number[:, 1] >= 0].ravel())
        own = own[own >= 0]
        row = np.full(len(x), -1)
        row[own] = np.arange(len(own))
        through = transfers(x, own, step, b)
        for j in range(1, x.number.shape[1]):
            last, this = x.neighbours(j)
            v = np.einsum("ps,pst->pt", before[last], through[row[last]])
            before[this] = (v / v.sum(1, keepdims=True)) @ step
        for j in range(x.number.shape[1] - 1, 0, -1):
            last, this = x.neighbours(j)
            v = np.einsum("pst,pt->ps", through[row[this]], after[this])
            after[last] = (v / v.sum(1, keepdims=True)) @ step.T
    return before, after


def expected(model: Model, docs: list[np.ndarray], emit: np.ndarray, size: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward over whole class sequences: adds to `emit` (classes x S), returns expected starts and steps. Runs of sequences
    are worked on side by side, between the exact states at their ends."""
    start, step, b = (a.astype(np.float32) for a in (model.start, model.step, model.emit))
    x, s = Runs(docs, size), len(start)
    before, after = ends(x, start, step, b)
    first, last, behind = np.empty_like(before), np.empty_like(before), np.empty_like(before)
    steps = np.zeros((s, s))
    for lo in range(0, len(x), SIDE_BY_SIDE):
        hi = min(lo + SIDE_BY_SIDE, len(x))
        begin, going, now = x.begin[lo:hi], x.going(lo, hi), before[lo:hi]
        alpha, seen = [], []
        for t, k in enumerate(going):
            seen.append(b[x.flat[begin[:k] + t]])
            now = (now[:k] @ step if t else now) * seen[t]
            scale = now.sum(1, keepdims=True)
            now = now / scale
            seen[t] /= scale
            alpha.append(now)
        beta = np.empty((0, s), np.float32)
        for t in range(len(going) - 1, -1, -1):
            k, longer = going[t], len(beta)
            last[lo + longer : lo + k] = alpha[t][longer:]
            over = after[lo + longer : lo + k]
            beta = np.concatenate([beta, over / (alpha[t][longer:] * over).sum(1, keepdims=True)])
            ahead = seen[t] * beta
            seen[t] = alpha[t] * beta  # the chances of the states
            if t:
                steps += (alpha[t - 1][:k].T @ ahead).astype(float) * model.step
                beta = ahead @ step.T
        behind[lo:hi], first[lo:hi] = ahead, seen[0]
        ids, chances = np.concatenate([x.flat[begin[:k] + t] for t, k in enumerate(going)]), np.concatenate(seen)
        for k in range(s):
            emit[:, k] += np.bincount(ids, chances[:, k], len(emit))
    for j in range(1, x.number.shape[1]):
        a, c = x.neighbours(j)
        steps += ((last[a] / ((last[a] @ step) * behind[c]).sum(1, keepdims=True)).T @ behind[c]).astype(float) * model.step
    return first[x.number[:, 0]].sum(0).astype(float), steps


def baum_welch(sequences: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, steps and emissions over all `sequences` (classes binary), summed across partitions by row of the tables."""
    s, size = len(model.start), len(model.emit)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit, step, start = np.zeros((size, s)), np.zeros((s, s)), np.zeros(s)
        held: list[np.ndarray] = []
        tokens = 0

        def count() -> None:
            nonlocal held, tokens
            if held:
                a, b = expected(model, held, emit)
                np.add(start, a, out=start)
                np.add(step, b, out=step)
            held, tokens = [], 0

        for batch in batches:
            for raw in batch.column("classes").to_pylist():
                held.append(np.frombuffer(raw, "<u2"))
                tokens += len(held[-1])
                if tokens >= SCORED_TOKENS:
                    count()
        count()
        table = np.concatenate([emit, step, start[None]])
        used = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *[pa.array(table[used, k]) for k in range(s)]], ["line", *[f"s{k}" for k in range(s)]])

    names = [f"s{k}" for k in range(s)]
    found = sequences.mapInArrow(rows, "line int, " + ", ".join(f"{c} double" for c in names)).groupBy("line").agg(*[F.sum(c).alias(c) for c in names]).toPandas()
    table = np.zeros((size + s + 1, s))
    table[found["line"]] = found[names]
    return table[-1], table[size : size + s], table[:size]


def forward(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of whole class sequences, side by side from the longest to the shortest."""
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    flat = np.concatenate([docs[i] for i in order]) if docs else np.zeros(0, np.int64)
    n = np.array([len(docs[i]) for i in order])
    first = np.cumsum(n) - n
    total = np.zeros(len(docs))
    now = None
    active = np.searchsorted(-n, -np.arange(1, n[0] + 1), "right") if len(n) else []  # sequences of at least t + 1 tokens
    for t, k in enumerate(active):
        seen = model.emit[flat[first[:k] + t]]
        now = (model.start if t == 0 else now[:k] @ model.step) * seen
        scale = now.sum(1)
        now /= scale[:, None]
        total[:k] += np.log10(scale)
    out = np.empty(len(docs))
    out[order] = total
    return out


def fit(enc: DataFrame, prior: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> Model:
    model = Model.first(prior, states)
    train = enc.filter("not held").select("classes")
    for _ in range(rounds):
        model = Model.of_counts(*baum_welch(train, model), prior)
    return model


def scored(enc: DataFrame, counts: DataFrame, voc: Vocabulary, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document."""
    floor = float(voc.tokens + 0.5 * (voc.distinct + 1))
    spark = enc.sparkSession
    each = spark.createDataFrame([(k, float(t), float(g)) for k, (t, g) in enumerate(zip(voc.total, voc.unknown, strict=True))], "k int, t double, g double")
    rare = enc.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("id"), F.col("x.times").alias("m"))
    met = rare.join(counts, "id", "left").withColumn("k", F.col("id").bitwiseAND(F.lit(SUFFIXES - 1)).cast("int")).join(F.broadcast(each), "k")
    c = F.coalesce("c", F.lit(0))
    inner = F.when(F.col("id") == END, 0.0).when(c > 0, F.log10((1 - F.col("g")) * c / F.col("t"))).otherwise(F.log10("g"))
    sums = met.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("known2"), F.sum(F.col("m") * F.log10((c + 0.5) / floor)).alias("base2"), F.sum(F.col("m") * inner).alias("inner2")
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            docs = [np.frombuffer(c, "<u2") for b in held for c in b.column("classes").to_pylist()]
            whole = pa.Table.from_batches(held).drop_columns(["classes"]).append_column("outer", pa.array(forward(model, docs)))
            held, size = [], 0
            yield from whole.to_batches()

        for batch in batches:
            held.append(batch)
            size += batch.column("classes").nbytes // 2
            if size >= SCORED_TOKENS:
                yield from out()
        if held:
            yield from out()

    names = ["row", "doc_id", "held", "n_tokens", "known", "base", "inner"]
    outer = enc.select(*names, "classes").mapInArrow(rows, "row long, doc_id long, held boolean, n_tokens long, known long, base double, inner double, outer double")
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    return outer.join(sums, "row", "left").select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(voc.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base2")).alias("base_score"), (F.col("outer") + F.col("inner") + zero("inner2")).alias("score"),
    )


def score(docs: DataFrame, held: Column, rounds: int = ROUNDS, states: int = STATES) -> DataFrame:
    """Train on the documents for which `held` is false, score all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"), F.monotonically_increasing_id().alias("row"))
    secret = corpus_key(rows)
    counts = token_counts(rows, secret)
    voc, own_c = vocabulary(counts)
    enc = encoded(rows, voc, secret)
    return scored(enc, counts, voc, fit(enc, voc.priors(own_c), rounds, states))
