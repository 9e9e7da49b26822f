"""Codes of vectors: product quantisation by integer k-means whose assignments are kept by Drake-Hamerly adaptive bounds.

A component x is the integer floor(scale * x). Vectors are cut into `PARTS` equal parts, each with a codebook of its own that starts as that part of the
vectors of the smallest ids. A round assigns every part to its nearest entry (ties: the lower index), then moves each entry to the floor of
its parts' mean; an unused entry stays.

Between rounds a row keeps, for each part, its `b` closest entries in order, an upper bound on the distance to the first, a lower bound for each
of the others and one outer bound for all entries that aren't listed. When entries move, bounds give way by as much. A part whose upper
bound lies below all lower ones stays; else its own distance is computed, then those of the listed entries up to the first place from
which on all bounds lie above it, and only if there is none those of all entries. What decides is always an exact integer distance:
bounds, rounded outwards and compared with a margin, only tell what need not be computed. `b` begins at a quarter of the entries and shrinks, by part, to
the most that any row needed in the round, an eighth at least.

The rows with their bounds are written anew each round and the round before is deleted. Sums and counts of the entries are added up by Spark; the driver
gets one row a number of the model. Rows whose vector is null or holds null or non-finite components are dropped, as are vectors whose length isn't a
positive multiple of `PARTS` or differs from that of the smallest id left. A null vec_id is larger than any other; equal vec_ids are ordered by their vectors.
Repeated rows are vectors of their own. With fewer rows than entries the codebooks are shorter. Errors of parts must fit into 62 bits, else the job
fails. Null labels count as one label. Columns other than vec_id, embedding and label are ignored. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, saved, saved_at, tidy
from .decontam import checked

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Within this distance bounds decide nothing; distances are roots of integers.
MARGIN = 1e-3
#: Numbers of a part that are compared at a time.
AT_ONCE = 4_000_000


def integers(v: np.ndarray, scale: int = SCALE) -> np.ndarray:
    x = np.floor(v * float(scale))
    if len(x) and 4 * x.shape[1] * float(np.abs(x).max()) ** 2 >= 2.0**62:
        raise ValueError("components are too large for distances of 62 bits")
    return x.astype(np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c, exact."""
    most = max((int(np.abs(a).max()) for a in (x, c) if a.size), default=0)
    if 4 * x.shape[1] * most * most < 1 << 53:  # whole numbers that doubles hold exactly
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    step = max(1, AT_ONCE // max(1, c.size))
    return np.concatenate([((x[lo : lo + step, None, :] - c[None]) ** 2).sum(2) for lo in range(0, len(x), step)] or [np.zeros((0, len(c)), np.int64)])


def up(d: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(d.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def down(d: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(d.astype(np.float64)).astype(np.float32), np.float32(-np.inf)), 0)


def first_bounds(x: np.ndarray, c: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(the b closest entries of each row, in order; bounds: upper of the first, lower of the others, outer)."""
    d = distances(x, c)
    order = np.argsort(d, 1, kind="stable")
    near = np.take_along_axis(d, order[:, : b + 1], 1)
    bounds = np.full((len(x), b + 1), np.inf, np.float32)
    bounds[:, 0] = up(near[:, 0])
    bounds[:, 1 : near.shape[1]] = down(near[:, 1:])
    return order[:, :b].astype(np.uint8), bounds


def moved_bounds(x: np.ndarray, c: np.ndarray, moved: np.ndarray, entries: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries and bounds after all entries moved by `moved` to c, and how many listed entries each row needed (0: none was computed)."""
    b = entries.shape[1]
    entries, wide = entries.copy(), bounds.astype(np.float64)
    wide[:, 0] += moved[entries[:, 0]]
    wide[:, 1:b] -= moved[entries[:, 1:]]
    wide[:, b] -= moved.max(initial=0)
    rest = np.minimum.accumulate(wide[:, :0:-1], 1)[:, ::-1]  # at z: the least bound of listed entries beyond z and of all others
    needed = np.zeros(len(x), np.int64)
    todo = np.flatnonzero(wide[:, 0] + MARGIN >= rest[:, 0])
    own = ((x[todo] - c[entries[todo, 0]]) ** 2).sum(1)
    wide[todo, 0] = np.sqrt(own.astype(np.float64)) * (1 + 1e-9)
    needed[todo] = 1
    todo = todo[wide[todo, 0] + MARGIN >= rest[todo, 0]]
    clear = wide[todo, :1] + MARGIN < rest[todo]
    needed[todo] = np.where(clear.any(1), clear.argmax(1) + 1, b + 1)
    for z in range(2, b + 1):
        rows = np.flatnonzero(needed == z)
        if len(rows):
            some = entries[rows, :z].astype(np.int64)
            d = ((x[rows, None, :] - c[some]) ** 2).sum(2)
            order = np.lexsort((some, d), axis=1)
            entries[rows, :z] = np.take_along_axis(some, order, 1)
            d = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
            wide[rows, 0] = d[:, 0] * (1 + 1e-9)
            wide[rows, 1:z] = d[:, 1:] * (1 - 1e-9)
    bounds = np.maximum(wide, 0).astype(np.float32)
    bounds[:, 0] = np.nextafter(bounds[:, 0], np.float32(np.inf))
    bounds[:, 1:] = np.maximum(np.nextafter(bounds[:, 1:], np.float32(-np.inf)), 0)
    rows = np.flatnonzero(needed > b)
    if len(rows):
        entries[rows], bounds[rows] = first_bounds(x[rows], c, b)
    return entries, bounds, needed


def shorter(entries: np.ndarray, bounds: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Only the b closest entries stay listed; the bounds of the others go into the outer one."""
    if entries.shape[1] <= b:
        return entries, bounds
    return entries[:, :b], np.concatenate([bounds[:, :b], bounds[:, b:].min(1, keepdims=True)], 1)


def matrix(column: pa.Array, kind) -> np.ndarray:
    """A binary column of equally long rows."""
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(n, -1)


def binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


class Model:
    """Codebooks (part, entry, component), how far each entry moved last, and how many entries each part lists in the rows as they are saved and from now on."""

    def __init__(self, books: np.ndarray):
        self.books, self.moved = books, None
        self.listed = self.keep = [max(1, min(len(books[0]), ENTRIES // 4))] * len(books)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.books.shape

    def numbers(self) -> int:
        """How many sums a task hands on: of components, of parts an entry, and of rows by how many entries they needed."""
        parts, k, d = self.shape
        return parts * (k * d + k + ENTRIES + 2)

    def update(self, sums: np.ndarray) -> Model:
        parts, k, d = self.shape
        totals, counts, needed = np.split(sums, [parts * k * d, parts * k * (d + 1)])
        totals, counts, needed = totals.reshape(parts, k, d), counts.reshape(parts, k, 1), needed.reshape(parts, -1)
        new = Model(np.where(counts > 0, totals // np.maximum(counts, 1), self.books))
        new.moved = np.sqrt(((new.books - self.books) ** 2).sum(2).astype(np.float64)) * (1 + 1e-9)
        new.listed = self.keep
        most = [int(np.flatnonzero(x).max(initial=0)) for x in needed]
        new.keep = [max(min(b, max(ENTRIES // 8, m)), 1) for b, m in zip(new.listed, most, strict=True)] if self.moved is not None else new.listed
        return new


def assign(rows: DataFrame, model: Model, label_type: str, last: bool) -> DataFrame:
    """Rows (vec_id, label, x, entries, bounds) assigned anew; entries and bounds are null before the first round. With them, of each task, a row of
    sums. At last (vec_id, label, code, error)."""
    parts, k, d = model.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        totals, counts, used = np.zeros((parts, k, d), np.int64), np.zeros((parts, k), np.int64), np.zeros((parts, ENTRIES + 2), np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema.field("label").type
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"), np.int32).astype(np.int64).reshape(-1, parts, d)
            new: list[list[np.ndarray]] = [[], []]
            if model.moved is not None:
                old = np.split(matrix(batch.column("entries"), np.uint8), np.cumsum(model.listed)[:-1], 1), np.split(matrix(batch.column("bounds"), np.float32), np.cumsum([b + 1 for b in model.listed])[:-1], 1)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                own, c = np.ascontiguousarray(x[:, p]), model.books[p]
                if model.moved is None:
                    entries, bounds = first_bounds(own, c, model.listed[p])
                else:
                    entries, bounds, needed = moved_bounds(own, c, model.moved[p], old[0][p], old[1][p])
                    used[p] += np.bincount(np.minimum(needed, model.listed[p]), minlength=ENTRIES + 2)
                code[:, p] = entries[:, 0]
                if last:
                    error += ((own - c[code[:, p]]) ** 2).sum(1)
                    continue
                order = np.argsort(code[:, p], kind="stable")
                n = np.bincount(code[:, p], minlength=k)
                there = np.flatnonzero(n)
                totals[p, there] += np.add.reduceat(own[order], (np.cumsum(n) - n)[there], 0)
                counts[p] += n
                for out, y in zip(new, shorter(entries, bounds, model.keep[p]), strict=True):
                    out.append(y)
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([y.tobytes().hex() for y in code]), pa.array(error)], ["vec_id", "label", "code", "error"])
            else:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("vec_id", "label", "x")], *[binary(np.concatenate(y, 1)) for y in new], pa.nulls(len(x), pa.list_(pa.int64()))], ["vec_id", "label", "x", "entries", "bounds", "sums"])
        if not last and kind is not None:
            flat = np.concatenate([totals.ravel(), counts.ravel(), used.ravel()])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, kind), *[pa.nulls(1, pa.binary())] * 3, pa.array([flat], pa.list_(pa.int64()))], ["vec_id", "label", "x", "entries", "bounds", "sums"])

    told = "code string, error long" if last else "x binary, entries binary, bounds binary, sums array<long>"
    return rows.mapInArrow(work, f"vec_id long, label {label_type}, {told}")


def as_integers(rows: DataFrame, label_type: str, scale: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v")
                x = integers(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1), scale)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), binary(x.astype(np.int32)), *[pa.nulls(len(x), pa.binary())] * 2], ["vec_id", "label", "x", "entries", "bounds"])

    return rows.select("vec_id", "label", "v").mapInArrow(work, f"vec_id long, label {label_type}, x binary, entries binary, bounds binary")


def compress(vectors: DataFrame, scale: int = SCALE, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of `vectors` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    label_type = vectors.schema["label"].dataType.simpleString()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0) & (F.size("v") % PARTS == 0))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES)
    least = first.collect()
    if not least:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dim = len(least[0].v)
    rows = rows.filter(F.size("v") == dim)
    if any(len(x.v) != dim for x in least):
        least = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()
    start = integers(np.array([x.v for x in least], np.float64), scale).reshape(len(least), PARTS, dim // PARTS)
    model = Model(np.ascontiguousarray(start.transpose(1, 0, 2)))
    state, path = saved_at(as_integers(rows, label_type, scale), "integers")
    for _ in range(rounds):
        new, new_path = saved_at(assign(state.select("vec_id", "label", "x", "entries", "bounds"), model, label_type, False), "assigned")
        removed(spark, path)
        total = new.filter("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
        sums = np.zeros(model.numbers(), np.int64)
        for r in total:
            sums[r.pos] = r.n
        model, state, path = model.update(sums), new.filter("sums is null"), new_path
    told = saved(assign(state.select("vec_id", "label", "x", "entries", "bounds"), model, label_type, True), "codes")
    removed(spark, path)
    errors = checked(saved(told.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors"))
    digest = hashlib.sha256(",".join(map(str, model.books.ravel().tolist())).encode()).hexdigest()
    return told.join(errors, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
