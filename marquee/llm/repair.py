"""Token-id files under a grammar.

Documents in ascending doc_id order are encoded, cut into shards of bounded size and each shard is compressed by
Re-Pair: pairs of neighbouring symbols that occur often are replaced by nonterminals, round after round, never across
the end of a document. A file holds the rules with their expansion lengths, an index of the documents and the
remaining symbols, so that one document, or one id of it, is decoded without the rest.

A shard's file, little-endian: b"RPG1", then five uint32 (base, rules, documents, symbols, ids), then
rules uint32[rules, 2], expansion lengths uint32[rules], doc_ids int64[documents], null marks uint8[documents],
first symbols uint32[documents + 1], symbols uint16 or uint32[symbols] (uint16 where base + rules <= 65536).

Null text counts as empty; an empty document is its end id alone. Documents of equal doc_id are ordered by a hash
of the text, all kept, and may lie in several tasks' files; a null doc_id comes first. An empty table gives no file. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TextEncoder, filesystem, n_parts, running_start, saved, shared_dir, tidy, write_file

MAGIC, END_ID = b"RPG1", 2
#: Ids a shard; a task holds one shard at a time.
SHARD_IDS = 1_000_000
#: How often a pair must occur in a shard to become a rule: a rule takes 12 bytes of a file, each use saves 2.
LEAST = 7
SLOTS = 18
#: Share of the free nonterminals that a round hands out, and how many it does at least.
ROUND_SHARE, ROUND_RULES = 4, 256


def frequent_pairs(sym: np.ndarray, joins: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the `most` most frequent pairs with at least `least` occurrences, their ranks by falling frequency, and the
    pairs' codes by rank. Hashed slots, which hold no fewer than any pair of theirs, tell what can be frequent; of that, pairs are
    counted exactly."""
    code = (sym[:-1].astype(np.uint64) << np.uint64(20)) | sym[1:]
    slot = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int32)
    n = np.bincount(slot[joins[:-1]], minlength=1 << SLOTS)
    at = np.flatnonzero((n >= least)[slot] & joins[:-1])
    slot, code = slot[at], code[at]
    pairs = np.sort(code)
    begin = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    pairs, n = pairs[begin], np.diff(np.append(begin, len(pairs)))
    best = np.flatnonzero(n >= least)
    hashed = pairs[best] * np.uint64(0x9E3779B97F4A7C15)  # in this order ties are scattered, so that fewer of them overlap in a row
    pairs = pairs[best[np.lexsort((hashed, -n[best]))[:most]]]
    # ranks: by slot, one pair each, and the pairs that share a slot with it one layer after the other
    ranks, left = np.full(len(at), -1, np.int32), np.arange(len(pairs))
    home = ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int32)
    while len(left):
        owner = np.full(1 << SLOTS, -1, np.int32)
        owner[home[left]] = left
        mine = owner[slot]
        ranks = np.where((mine >= 0) & (pairs[mine] == code), mine, ranks)
        left = left[owner[home[left]] != left]
    return at[ranks >= 0], ranks[ranks >= 0], pairs


def choose(at: np.ndarray, rank: np.ndarray, passes: int = 3) -> np.ndarray:
    """Of candidate positions (ascending), marks of those to replace: where two overlap the more frequent pair goes first.
    Later passes take candidates that overlap none of those taken."""
    taken, left = np.zeros(len(at), bool), np.arange(len(at))
    for _ in range(passes):
        best = left[undisputed(at[left], rank[left])]
        taken[best] = True
        spoilt = np.zeros(len(at) + 2, bool)  # a neighbour in the list that touches a taken one
        spoilt[best[best > 0] - 1] |= at[best[best > 0]] - at[best[best > 0] - 1] == 1
        after = best[best < len(at) - 1]
        spoilt[after + 1] |= at[after + 1] - at[after] == 1
        left = left[~taken[left] & ~spoilt[left]]
        if not len(left):
            break
    return taken


def undisputed(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Marks of candidates that are no less frequent than those they overlap; in a run of one pair (aaa) every other
    position from the left."""
    touch = np.diff(at) == 1
    same = touch & (np.diff(rank) == 0)
    first = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(at)), 0))
    even = (np.arange(len(at)) - first) % 2 == 0
    better_than_left = np.concatenate([[True], ~touch | (rank[1:] <= rank[:-1])])
    better_than_right = np.concatenate([~touch | (rank[:-1] <= rank[1:]), [True]])
    return even & better_than_left & better_than_right


def compress(ids: np.ndarray, last: np.ndarray, base: int, rounds: int | None = None, least: int = LEAST, max_rules: int | None = None):
    """Re-Pair of `ids`, until no pair occurs `least` times or the nonterminals are used up (`rounds` stops it before); `last` marks
    each document's last id. Returns (symbols, their `last` marks, rules)."""
    sym, joins, rules = ids.astype(np.uint32), ~last, []
    room = max(0, 0x10000 - base) if max_rules is None else max_rules
    while len(sym) > 1 and room > 0 and (rounds is None or len(rules) < rounds):
        at, rank, pairs = frequent_pairs(sym, joins, min(room, max(ROUND_RULES, room // ROUND_SHARE)), least)
        if not len(pairs):
            break
        chosen = choose(at, rank)
        at, rank = at[chosen], rank[chosen]
        used, new = np.unique(rank, return_inverse=True)
        code = pairs[used]
        sym[at] = (base + sum(map(len, rules)) + new).astype(np.uint32)
        joins[at] = joins[at + 1]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, joins = sym[keep], joins[keep]
        rules.append(np.stack([code >> np.uint64(20), code & np.uint64(0xFFFFF)], 1).astype(np.uint32))
        room -= len(used)
    return sym, ~joins, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat ids of all symbols below base + rules that are rules, where each begins, expansion lengths)."""
    full: list[np.ndarray] = []
    for a, b in rules.tolist():
        full.append(np.concatenate([full[x - base] if x >= base else np.array([x], np.uint32) for x in (a, b)]))
    sizes = np.array([len(x) for x in full], np.int64)
    return (np.concatenate(full) if full else np.zeros(0, np.uint32)), np.cumsum(sizes) - sizes, sizes


def expand(sym: np.ndarray, rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the symbols, how many ids each symbol stands for)."""
    flat, begin, sizes = expansions(rules, base)
    table = np.concatenate([np.arange(base, dtype=np.uint32), flat])
    starts = np.concatenate([np.arange(base, dtype=np.int64), base + begin])[sym]
    n = np.concatenate([np.ones(base, np.int64), sizes])[sym]
    where = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
    return table[where], n


def file_bytes(doc_ids: list, sym: np.ndarray, last: np.ndarray, rules: np.ndarray, base: int, n_ids: int) -> Iterator[bytes]:
    sizes = expansions(rules, base)[2]
    first = np.concatenate([[0], np.flatnonzero(last) + 1]).astype("<u4")
    yield MAGIC + np.array([base, len(rules), len(doc_ids), len(sym), n_ids], "<u4").tobytes()
    yield rules.astype("<u4").tobytes() + sizes.astype("<u4").tobytes()
    yield np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + first.tobytes()
    yield sym.astype("<u2" if base + len(rules) <= 0x10000 else "<u4").tobytes()


class Shard:
    """A file's content. `document(i)` decodes one document, `token(i, k)` one id of it."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token grammar file")
        self.base, n_rules, n_docs, n_sym, self.n_ids = np.frombuffer(data, "<u4", 5, 4).tolist()
        at = 24

        def take(dtype, n):
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        doc_ids, null = take("<i8", n_docs), take(np.uint8, n_docs)
        self.doc_ids = [None if gone else d for d, gone in zip(doc_ids.tolist(), null.tolist(), strict=True)]
        self.first = take("<u4", n_docs + 1)
        self.sym = take("<u2" if self.base + n_rules <= 0x10000 else "<u4", n_sym)

    def document(self, i: int) -> np.ndarray:
        return expand(self.sym[self.first[i] : self.first[i + 1]], self.rules, self.base)[0]

    def token(self, i: int, k: int) -> int:
        """Skip symbols by their expansion lengths, then go down the rules."""
        size = lambda s: int(self.lengths[s - self.base]) if s >= self.base else 1
        for s in self.sym[self.first[i] : self.first[i + 1]].tolist():
            if k < size(s):
                while s >= self.base:
                    a, b = self.rules[s - self.base].tolist()
                    s, k = (a, k) if k < size(a) else (b, k - size(a))
                return s
            k -= size(s)
        raise IndexError(k)

    def all_ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, how many each has)."""
        ids, n = expand(self.sym, self.rules, self.base)
        ends = np.concatenate([[0], np.cumsum(n)])[self.first]
        return ids, np.diff(ends)


def write(docs: DataFrame, tokenizer: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the files; returns the saved manifest (pid, shard, folder, name, n_docs, n_ids, n_bytes, start), a row for
    each file, start being the ids of all files before it."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "repair")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy(tokenizer)
        encoder, pid, k = TextEncoder.of(tokenizer), TaskContext.get().partitionId(), 0
        base = encoder.vocab_size
        doc_ids, ids, counts, held = [], [], [], 0

        def flush():
            nonlocal doc_ids, ids, counts, held, k
            flat, lengths = np.concatenate(ids), np.concatenate(counts)
            last = np.zeros(len(flat), bool)
            last[np.cumsum(lengths) - 1] = True
            name = f"ids-{pid:06d}-{k:06d}.rpg"
            n_bytes = write_file(folder, name, file_bytes(doc_ids, *compress(flat, last, base), base, len(flat)))
            row = {"pid": pid, "shard": k, "folder": folder, "name": name, "n_docs": len(doc_ids), "n_ids": len(flat), "n_bytes": n_bytes}
            doc_ids, ids, counts, held, k = [], [], [], 0, k + 1
            return pa.RecordBatch.from_pylist([row], MANIFEST)

        for batch in batches:
            for rows, flat, n in encoder(batch.column("text"), END_ID):
                docs, ends, lo = batch.column("doc_id")[rows].to_pylist(), np.cumsum(n), 0
                while lo < len(n):
                    before = int(ends[lo - 1]) if lo else 0
                    hi = min(len(n), int(np.searchsorted(ends, before + shard_ids - held)) + 1)
                    doc_ids += docs[lo:hi]
                    ids.append(flat[before : ends[hi - 1]])
                    counts.append(n[lo:hi])
                    held += int(ends[hi - 1]) - before
                    lo = hi
                    if held >= shard_ids:
                        yield flush()
        if doc_ids:
            yield flush()

    text = F.col("text").cast("string").alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    placed = rows.repartitionByRange(n_parts(spark), "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")
    manifest = saved(placed.mapInArrow(shards, "pid int, shard int, folder string, name string, n_docs long, n_ids long, n_bytes long"), "repair-manifest")
    return running_start(manifest, "pid", ["shard"], "n_ids", "start")


MANIFEST = pa.schema([("pid", pa.int32()), ("shard", pa.int32()), ("folder", pa.string()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def read(manifest: DataFrame) -> DataFrame:
    """Decode the files of a manifest: a row (doc_id, start, n_tokens, ids_crc32) for each document."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, name, start in zip(*(batch.column(c).to_pylist() for c in ("folder", "name", "start")), strict=True):
                where, path = filesystem(folder)
                with where.open_input_stream(f"{path}/{name}", compression=None) as f:
                    shard = Shard(f.read())
                ids, n = shard.all_ids()
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(n)
                crc = [zlib.crc32(raw[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(start + ends - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("folder", "name", "start").repartition(n_parts(manifest.sparkSession))
    return spread.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
