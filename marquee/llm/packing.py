"""Packing along a space-filling curve.

Every document's token counts, hashed to buckets, are projected to a few dimensions; the point's place on the
Hilbert curve is the document's key. Documents are range-sorted by key and laid end to end along the curve, and
the line is cut every `size` ids: neighbours on the curve share sequences, and only the very last sequence is padded.

Null text counts as empty; an empty document is its end id alone. Repeated rows are packed once each. Documents of
equal key keep the order of their rows. An empty table gives no sequence. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextEncoder, cut_bytes, n_parts, running_start, saved, tidy

END_ID, SIZE = 2, 4096
BUCKETS, DIMS, BITS = 1024, 4, 10


def hilbert_key(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points, one row each, coordinates below 2**bits."""
    x = axes.T.astype(np.int64).copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations, from the coarsest cell down
        for i in range(len(x)):
            far = (x[i] & q) != 0
            swap = np.where(far, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(far, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key


def curve_keys(ids: np.ndarray, lengths: np.ndarray, seed: int = 11) -> np.ndarray:
    """Keys of documents laid end to end in `ids`: hashed count vectors (square-rooted, scaled to length 1), projected
    with fixed random directions and spread evenly over each axis."""
    from math import erf, sqrt

    rng = np.random.default_rng(seed)
    bucket = rng.integers(0, BUCKETS, 1 << 16)
    directions = rng.standard_normal((BUCKETS, DIMS))
    keys = []
    step = 512
    ends = np.concatenate([[0], np.cumsum(lengths)])
    for lo in range(0, len(lengths), step):
        hi = min(lo + step, len(lengths))
        cell = np.repeat(np.arange(hi - lo) * BUCKETS, lengths[lo:hi]) + bucket[ids[ends[lo] : ends[hi]] & 0xFFFF]
        v = np.sqrt(np.bincount(cell, minlength=(hi - lo) * BUCKETS).reshape(hi - lo, BUCKETS))
        v /= np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12)
        z = v @ directions
        even = np.vectorize(lambda t: 0.5 * (1 + erf(t / sqrt(2))), otypes=[float])(z)
        keys.append(hilbert_key(np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))
    return np.concatenate(keys) if keys else np.zeros(0, np.int64)


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, row, key, n, ids): ids are little-endian, as wide as the vocabulary needs, with the end id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(tokenizer)
        encoder = TextEncoder.of(tokenizer)
        for batch in batches:
            for rows, ids, n in encoder(batch.column("text"), END_ID):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[rows], batch.column("row")[rows], pa.array(curve_keys(ids, n)), pa.array(n.astype(np.int64)), cut_bytes(ids, n)], ["doc_id", "row", "key", "n", "ids"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(encode, "doc_id long, row long, key long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """Sequences (sequence_id, ids binary of little-endian uint32, pieces of (doc_id, start, length, doc_tokens, offset)).

    The ids are shuffled once: the order and the cuts come from a table of (key, row, n) alone, of which the driver gets one row for each partition."""
    spark = docs.sparkSession
    parts, width = n_parts(spark), TextEncoder.of(tokenizer).dtype.itemsize
    tokens = saved(tokenised(docs, tokenizer), "pack-tokens", compression="zstd")
    line = saved(tokens.select("key", "row", "n").repartitionByRange(parts, "key", "row").withColumn("pid", F.spark_partition_id()), "pack-line")
    total = line.agg(F.sum("n")).first()[0] or 0
    each = max(1, -(-total // (size * parts))) * size  # ids a partition
    placed = running_start(line, "pid", ["key", "row"], "n", "start")
    # the document at each partition's first id; a document is sent to every partition that holds part of it
    cuts = (
        placed.withColumn("p0", F.ceil(F.col("start") / each).cast("long")).withColumn("p1", F.floor((F.col("start") + F.col("n") - 1) / each).cast("long"))
        .filter("p1 >= p0").select("key", "row", "start", "n", F.explode(F.sequence("p0", "p1")).alias("p")).orderBy("p").collect()
    )
    keys, rows = np.array([c["key"] for c in cuts], np.int64), np.array([c["row"] for c in cuts], np.int64)
    starts, spans = [c["start"] for c in cuts], {(c["key"], c["row"]): (c["start"] // each, (c["start"] + c["n"] - 1) // each) for c in cuts}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()  # the encoder isn't needed any more
        for batch in batches:
            k, r = batch.column("key").to_numpy(), batch.column("row").to_numpy()
            lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            part = lo - 1
            for i in np.flatnonzero(hi > lo):
                part[i] = lo[i] + np.searchsorted(rows[lo[i] : hi[i]], r[i], "left") - 1
            take, to = [], []
            for i, p in enumerate(part.tolist()):
                first, last = spans.get((k[i], r[i]), (p, p))
                take += [i] * (last - first + 1)
                to += range(first, last + 1)
            sent = pa.Table.from_batches([batch]).take(pa.array(take, pa.int64())).append_column("part", pa.array(to, pa.int32()))
            yield from sent.to_batches()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        dtype = np.dtype(f"<u{width}")
        done: list[tuple] = []
        ids: list[np.ndarray] = []
        pieces: list[dict] = []
        held, at, part = 0, 0, None

        def close():
            nonlocal held, ids, pieces
            if pieces:
                done.append((seq, np.concatenate(ids).astype("<u4").tobytes(), pieces))
            held, ids, pieces = 0, [], []

        def rows_out():
            nonlocal done
            out = pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.binary()), pa.array([d[2] for d in done], pa.list_(PIECE))], ["sequence_id", "ids", "pieces"]
            )
            done = []
            return out

        seq = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                p, doc, raw = row
                if p != part:
                    close()
                    part, at, seq = p, starts[p], p * each // size
                doc_ids = np.frombuffer(raw, dtype)
                a, b = max(at, p * each), min(at + len(doc_ids), (p + 1) * each)
                while a < b:
                    seq = a // size
                    take = min(b, (seq + 1) * size) - a
                    ids.append(doc_ids[a - at : a - at + take])
                    pieces.append({"doc_id": doc, "start": a - at, "length": take, "doc_tokens": len(doc_ids), "offset": a - seq * size})
                    a += take
                    if a == (seq + 1) * size:
                        close()
                at += len(doc_ids)
            if len(done) >= 128:
                yield rows_out()
        close()
        if done:
            yield rows_out()

    schema = "sequence_id long, ids binary, pieces array<struct<doc_id:long,start:long,length:long,doc_tokens:long,offset:long>>"
    routed = tokens.mapInArrow(route, "doc_id long, row long, key long, n long, ids binary, part int")
    return routed.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "row").mapInArrow(fill, schema)


PIECE = pa.struct([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "offset")])


def pieces(sequences: DataFrame) -> DataFrame:
    """A row for each piece, with the unsigned CRC-32 of its ids as they lie in the sequence."""
    p = F.col("piece")
    return sequences.select("sequence_id", "ids", F.explode("pieces").alias("piece")).select(
        p.doc_id.alias("doc_id"), p.start.alias("start"), p.length.alias("length"),
        F.crc32(F.substring(F.col("ids"), (p.offset * 4 + 1).cast("int"), (p.length * 4).cast("int"))).alias("ids_crc32"),
        p.doc_tokens.alias("doc_tokens"), "sequence_id", p.offset.alias("offset"),
    )
