"""Exact top-k search by a vector-approximation file.

A component x is the integer floor(scale * x); the score of two vectors is their inner product.

1. Rows of equal integers form a class, with its `k` + 1 smallest ids. Classes are cut into blocks of `BLOCK`. A block's components are quantised to
   `CELLS` cells a dimension between its own least and largest; the cells, one byte each, are the approximation file, a table. The integers and ids
   go to files in the shared folder, from which a block is read by its offset.
2. Different query vectors and blocks are dealt to units (group of queries, share of blocks), so that a unit's memory is bounded. A unit scans the cells of its
   share: a cell's ends bound each product from both sides, and the k+1 largest lower bounds of a query make its threshold. Then
   blocks are visited from the largest upper bound down; one that no query can use any more is never read. Inside a block the exact
   vectors are taken in the order of their bounds, and each result raises the thresholds, until no bound reaches the (k+1)th result.
3. The results of the shares are merged to k+1 by query vector; each query drops its own row.

Scores and bounds are whole numbers within what the number type holds, so results are exact: rank by score, ties to the smaller vec_id, a null one being the largest.
Vectors that are null, empty or hold null or non-finite components take no part; vectors of different lengths aren't compared. Repeated rows are rows of their own; two
rows of one vec_id find each other. A null vec_id is no query. Components of 2^26 / scale and more fail the job. Columns other than vec_id and embedding are ignored. An
empty table gives no row. Work grows with queries times rows, as the search asks; nothing but counts reaches the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import filesystem, n_parts, saved, shared_dir, tidy

SCALE, K, EVERY = 256, 5, 50
BLOCK, CELLS = 1024, 64
#: Query vectors of a unit; blocks of a unit at most.
GROUP, SHARE = 4096, 64
#: Exact vectors that are taken at a time.
TURN = 128
LEAST = -(1 << 62)


def record(dim: int, k: int) -> np.dtype:
    """An exact vector and its ids: `real` of them, and `nulls` null ones."""
    return np.dtype([("x", "<i4", (dim,)), ("ids", "<i8", (k + 1,)), ("real", "<i4"), ("nulls", "<i4")])


def grid(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least and largest of each dimension, width of its cells, cells)."""
    ends = np.array([x.min(0), x.max(0)])
    width = (ends[1] - ends[0]) // CELLS + 1
    return ends, width, ((x - ends[0]) // width).astype(np.uint8)


def cell_ends(ends: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, difference) of the largest and the least integer of each cell."""
    low = ends[0] + cells * width
    high = np.minimum(low + width - 1, ends[1])
    return low + high, high - low


def exact_kind(q: np.ndarray, most: int):
    """A number type in which sums of products with numbers of up to `most` are exact."""
    total = int(np.abs(q).sum(1).max(initial=0)) * most
    return np.float32 if total < 1 << 24 else np.float64 if total < 1 << 53 else np.int64


def approximation(classes: DataFrame, uri: str, k: int) -> DataFrame:
    """A row for each block: (block, dim, n, ends, width, cells, file, at)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        where, folder = filesystem(uri)
        where.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name, own = f"part-{part}", f"{folder}/.part-{part}.{uuid.uuid4().hex[:8]}"
        at, made = 0, 0
        held: dict[int, list[np.ndarray]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal at, made
            some = np.concatenate(held.pop(dim))
            out.write(some.tobytes())
            ends, width, cells = grid(some["x"].astype(np.int64))
            row = [(part << 32) + made, dim, len(some), ends.tobytes(), width.tobytes(), cells.tobytes(), name, at]
            at += some.nbytes
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.int64()), strict=True)], ["block", "dim", "n", "ends", "width", "cells", "file", "at"])

        with where.open_output_stream(own, compression=None) as out:
            for batch in batches:
                for c, ids, n in zip(batch.column("c"), batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    x = c.values.to_numpy(zero_copy_only=False)
                    one = np.zeros(1, record(len(x), k))
                    one["x"], one["ids"][0, : len(ids)], one["real"], one["nulls"] = x, ids, len(ids), n - len(ids)
                    held.setdefault(len(x), []).append(one)
                    if len(held[len(x)]) == BLOCK:
                        yield block(len(x))
            for dim in list(held):
                yield block(dim)
        where.move(own, f"{folder}/{name}")

    return saved(classes.mapInArrow(rows, "block long, dim int, n int, ends binary, width binary, cells binary, file string, at long"), "cells")


class Best:
    """Of each query the k+1 best (score, id) so far; a null id is larger than any other."""

    def __init__(self, queries: int, most: int):
        self.most = most
        self.query, self.score, self.id, self.null = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        self.least = np.full(queries, LEAST)  # the (k+1)th score

    def add(self, query: np.ndarray, score: np.ndarray, some: np.ndarray) -> None:
        """Pairs of a query and a record, with their score."""
        n = some["real"] + some["nulls"]
        pair = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        null = place >= some["real"][pair]
        ids = np.where(null, 0, some["ids"][pair, np.minimum(place, self.most - 1)])
        query, score, ids, null = (np.concatenate(x) for x in ((self.query, query[pair]), (self.score, score[pair]), (self.id, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = order[rank < self.most]
        self.query, self.score, self.id, self.null = query[rank < self.most], score[keep], ids[keep], null[keep]
        last = rank[rank < self.most] == self.most - 1
        self.least[self.query[last]] = self.score[last]


def search(q: np.ndarray, blocks: list[dict], read, k: int) -> tuple[Best, int]:
    """The best of a unit, and how many exact vectors were taken. `read` gives a block's records."""
    most = max(int(max(np.abs(np.frombuffer(b["ends"], np.int64)).max(initial=0) for b in blocks)), 1)
    kind = exact_kind(q, 4 * most)
    wide, size = q.astype(kind), np.abs(q).astype(kind)
    low = np.full((len(q), k + 1), LEAST if kind is np.int64 else -np.inf, kind)
    tops = np.zeros((len(blocks), len(q)))

    def bounds(b: dict, who=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Twice the score, and how far it may be off, of queries and a block's vectors."""
        dim = q.shape[1]
        ends, width, cells = np.frombuffer(b["ends"], np.int64).reshape(2, dim), np.frombuffer(b["width"], np.int64), np.frombuffer(b["cells"], np.uint8).reshape(-1, dim)
        mid, off = cell_ends(ends, width, cells)
        return wide[who] @ mid.T.astype(kind), size[who] @ off.T.astype(kind)

    for j, b in enumerate(blocks):
        mid, off = bounds(b)
        low = np.concatenate([low, mid - off], 1)
        low = np.partition(low, low.shape[1] - k - 1, 1)[:, -k - 1 :]
        tops[j] = (mid + off).max(1)
    reach = low.min(1).astype(np.float64)  # twice the score that a result must have
    best, taken = Best(len(q), k + 1), 0
    for j in np.argsort(-(tops - reach).max(1), kind="stable").tolist():
        who = np.flatnonzero(tops[j] >= reach)
        if not len(who):
            continue
        mid, off = bounds(blocks[j], who)
        above = (mid + off) - reach[who][:, None]
        ahead = above.max(0)
        order = np.argsort(-ahead, kind="stable")
        order = order[ahead[order] >= 0]
        some = None
        for lo in range(0, len(order), TURN):
            rows = order[lo : lo + TURN]
            if lo:
                rows = rows[((mid[:, rows] + off[:, rows]) >= reach[who][:, None]).any(0)]
            if not len(rows):
                continue
            if some is None:
                some = read(blocks[j])
            taken += len(rows)
            score = (wide[who] @ some["x"][rows].T.astype(kind)).astype(np.int64)
            a, r = np.nonzero((2 * score >= reach[who][:, None]) & (score >= best.least[who][:, None]))
            best.add(who[a], score[a, r], some[rows[r]])
            reach = np.maximum(reach, np.where(best.least > LEAST, 2.0 * best.least, -np.inf))
    return best, taken


def found(units: DataFrame, uri: str, k: int) -> DataFrame:
    """(qkey, score, vec_id): the k+1 best of each query vector in each share."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        where, folder = filesystem(uri)

        def read(b: dict) -> np.ndarray:
            kind = record(b["dim"], k)
            with where.open_input_file(f"{folder}/{b['file']}") as f:
                return np.frombuffer(f.read_at(b["n"] * kind.itemsize, b["at"]), kind)

        flat = (row for batch in batches for row in batch.to_pylist())
        for (dim, _, _), unit in groupby(flat, key=lambda r: (r["dim"], r["grp"], r["share"])):
            keys, q, blocks = [], [], []
            for r in unit:
                if r["cells"] is None:
                    keys.append(r["key"])
                    q.append(np.frombuffer(r["q"], np.int32))
                else:
                    blocks.append(r)
            if keys and blocks:
                best, _ = search(np.array(q, np.int64).reshape(-1, dim), blocks, read, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[best.query]), pa.array(best.score), pa.array(best.id, mask=best.null)], ["qkey", "score", "vec_id"])

    return units.mapInArrow(rows, "qkey long, score long, vec_id long")


def asked(queries: DataFrame) -> DataFrame:
    """The saved different query vectors (qkey, c, q), q being c's bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            c = batch.column("c")
            yield pa.RecordBatch.from_arrays([pa.array((part << 32) + n + np.arange(len(c))), c, pa.array([x.values.to_numpy(zero_copy_only=False).astype(np.int32).tobytes() for x in c], pa.binary())], ["qkey", "c", "q"])
            n += len(c)

    return saved(queries.select("c").distinct().mapInArrow(rows, "qkey long, c array<int>, q binary"), "asked")


def neighbours(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of `vectors` (vec_id, embedding) for each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    doubles = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    sound = doubles.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0))
    whole = F.transform("v", lambda x: F.when(F.abs(x) * scale < float(1 << 26), F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for whole scores")).cast("int")))
    rows = sound.select("vec_id", whole.alias("c"))
    place = F.row_number().over(W.partitionBy("c").orderBy(F.asc_nulls_last("vec_id")))
    few = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    classes = saved(few.groupBy("c").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.count("*").cast("int").alias("n")), "classes")
    uri = shared_dir(spark, "exact-vectors")
    cells = approximation(classes, uri, k)
    queries = saved(rows.filter(F.col("vec_id") % every == 0), "queries")
    ask = asked(queries)
    n_blocks, n_asked = cells.count(), ask.count()
    shares, groups = max(-(-n_blocks // SHARE), min(n_blocks, n_parts(spark)), 1), max(1, -(-n_asked // GROUP))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    empty = {c: F.lit(None).cast(t).alias(c) for c, t in (("n", "int"), ("ends", "binary"), ("width", "binary"), ("cells", "binary"), ("file", "string"), ("at", "long"), ("q", "binary"))}
    sent = ["dim", "grp", "share", "key", "q", "n", "ends", "width", "cells", "file", "at"]
    left = ask.select(F.size("c").alias("dim"), dealt("qkey", groups).alias("grp"), all_of(shares).alias("share"), F.col("qkey").alias("key"), "q", *[empty[c] for c in sent[5:]])
    right = cells.select("dim", all_of(groups).alias("grp"), dealt("block", shares).alias("share"), F.col("block").alias("key"), empty["q"], *sent[5:])
    unit = ["dim", "grp", "share"]
    units = left.select(*sent).union(right.select(*sent)).repartition(n_parts(spark), *unit).sortWithinPartitions(*unit)
    told = saved(found(units, uri, k), "found")
    order = W.partitionBy("qkey").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    top = told.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    lists = top.groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct("place", "score", "vec_id"))).alias("m"))
    own = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long"))
    each = queries.join(ask.select("qkey", "c"), "c").withColumn("own", own).select(F.col("vec_id").alias("query_id"), "own", "qkey").join(lists, "qkey")
    own_place = F.array_min(F.transform(F.filter("m", lambda x: (x["vec_id"] == F.col("query_id")) & (x["score"] == F.col("own"))), lambda x: x["place"]))
    rest = F.slice(F.filter("m", lambda x: F.coalesce(x["place"] != F.col("own_place"), F.lit(True))), 1, k)
    return each.withColumn("own_place", own_place).select("query_id", F.posexplode(rest).alias("rank", "m")).select("query_id", (F.col("rank") + 1).alias("rank"), "m.vec_id", "m.score")
