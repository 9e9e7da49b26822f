"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors form a class first, so that copies cost no pairs. Classes that share a sign code in a table are compared by
exact cosine in double precision; a pair is counted in the first table that holds it. Code length grows with the
logarithm of the number of classes and the number of tables follows from the wanted recall. A bucket above `cap` classes is dealt in
blocks, and every pair of blocks is a unit of work of its own, so that no bucket is held by one task and none is cut short.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null vec_id, link with nothing.
Vectors of different lengths aren't compared. Repeated rows are vectors of their own. An empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, n_parts, saved

THRESHOLD, RECALL, CAP, PER_BUCKET, SEED = 0.9, 0.98, 512, 48, 5


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits a code, tables): about PER_BUCKET classes a bucket, and a pair at the threshold is met with probability `recall`."""
    bits = min(30, max(4, math.ceil(math.log2(max(n, 1) / PER_BUCKET + 1))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def planes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))


def sign_codes(v: np.ndarray, bits: int, tables: int) -> np.ndarray:
    sides = (v @ planes(v.shape[1], bits, tables) >= 0).reshape(len(v), tables, bits)
    return (sides * (1 << np.arange(bits, dtype=np.int64))).sum(2).astype(np.int32)


def coded(classes: DataFrame, schema: str, bits: int, tables: int, rows_of) -> DataFrame:
    """For batches of classes (rep, n, v) of one length, the record batches that rows_of(reps, ns, vectors, codes) makes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: dict[int, list] = {}
            for rep, n, v in zip(*(batch.column(c).to_pylist() for c in ("rep", "n", "v")), strict=True):
                got.setdefault(len(v), []).append((rep, n, v))
            for own in got.values():
                for lo in range(0, len(own), 256):
                    some = own[lo : lo + 256]
                    v = np.array([x[2] for x in some])
                    yield rows_of([x[0] for x in some], [x[1] for x in some], v, sign_codes(v, bits, tables))

    return classes.mapInArrow(rows, schema)


def bucket_sizes(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(t, code, dim, count): the codes alone are counted, combined before the shuffle."""

    def rows(_, __, v: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        t = np.tile(np.arange(tables, dtype=np.int32), len(v))
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(codes.reshape(-1)), pa.array(np.full(len(t), v.shape[1], np.int32))], ["t", "code", "dim"])

    return coded(classes, "t int, code int, dim int", bits, tables, rows).groupBy("t", "code", "dim").count()


def hashed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """A row for each class and table: (t, code, dim, rep, n, v, codes), v as bytes, and of its codes, as bytes, those of the tables before."""

    def rows(reps: list, ns: list, v: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        raw = [x.astype(np.float32).tobytes() if (x == x.astype(np.float32)).all() else x.tobytes() for x in v]
        each = np.repeat(np.arange(len(v)), tables)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.tile(np.arange(tables, dtype=np.int32), len(v))), pa.array(codes.reshape(-1)), pa.array(np.full(len(each), v.shape[1], np.int32)),
                pa.array([reps[i] for i in each], pa.int64()), pa.array([ns[i] for i in each], pa.int64()), pa.array([raw[i] for i in each], pa.binary()),
                pa.array([c[: 4 * t] for c in (x.tobytes() for x in codes) for t in range(tables)], pa.binary()),
            ],
            ["t", "code", "dim", "rep", "n", "v", "codes"],
        )

    return coded(classes, "t int, code int, dim int, rep long, n long, v binary, codes binary", bits, tables, rows)


def compare(rows: list[tuple], a: int, b: int, dim: int, threshold: float) -> list[tuple[int, int, int]]:
    """Of a unit's rows (block, rep, n, v, codes): (rep, rows linked to it, least rep of its group here) of those with links."""
    v = np.array([np.frombuffer(r[3], np.float32 if len(r[3]) == 4 * dim else np.float64).astype(np.float64) for r in rows])
    codes = np.array([np.frombuffer(r[4], np.int32) for r in rows])
    size = np.sqrt((v * v).sum(1))
    left, right = ([i for i, r in enumerate(rows) if r[0] == x] for x in (a, b))
    if not left or not right:
        return []
    cos = (v[left] @ v[right].T) / (size[left][:, None] * size[right][None, :])
    i, j = np.nonzero(cos >= threshold)
    i, j = np.array(left)[i], np.array(right)[j]
    own = i < j if a == b else np.ones(len(i), bool)
    i, j = i[own], j[own]
    new = ~(codes[i] == codes[j]).any(1)
    i, j = i[new], j[new]
    n = np.array([r[2] for r in rows])
    links = np.bincount(i, n[j], len(rows)) + np.bincount(j, n[i], len(rows))
    root = np.array([r[1] for r in rows])
    while True:  # least label of the group
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        if (before == root).all():
            break
    return [(rows[k][1], int(links[k]), int(root[k])) for k in np.flatnonzero(links)]


def linked(classes: DataFrame, threshold: float, recall: float, cap: int) -> DataFrame:
    """(rep, links, root) rows of the units; links sum up over them, (rep, root) are edges."""
    spark = classes.sparkSession
    bits, tables = plan(classes.count(), threshold, recall)
    rows = hashed(classes, bits, tables)
    large = saved(bucket_sizes(classes, bits, tables).filter(F.col("count") > cap), "buckets")
    blocks = F.coalesce(F.ceil(F.col("count") / cap).cast("int"), F.lit(1))
    dealt = rows.join(large, ["t", "code", "dim"], "left").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("t", "code", "dim", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "rep", "n", "v", "codes")
    keys = ["t", "code", "dim", "a", "b"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for (_, _, dim, a, b), own in groupby(flat, key=lambda r: r[:5]):
            rows = [r[5:] for r in own]
            if len(rows) > 1:
                out += compare(rows, a, b, dim, threshold)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["rep", "links", "root"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["rep", "links", "root"])

    return units.repartition(n_parts(spark), *keys).sortWithinPartitions(*keys).mapInArrow(work, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, cap: int = CAP) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors` (vec_id, embedding)."""
    doubles = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("v")).withColumn("v", F.when(sound, F.col("v")))
    classes = saved(rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    found = saved(linked(classes, threshold, recall, cap), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found, "rep", "root").withColumnRenamed("node", "rep")
    known = saved(
        classes.join(links, "rep", "left").join(groups, "rep", "left")
        .select("v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")),
        "classes",
    )
    return rows.join(known, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept")
    )
