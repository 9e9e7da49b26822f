"""What the operators of this subpackage share: saved tables, files in the shared folder, running
totals over range partitions, tokenizers and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import itertools
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder (as a URI) below spark.checkpoint.dir, which driver and executors share. Only where
    that is unset, as in tests on one machine, a temporary folder is set for the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


#: Rows and bytes of a batch that a Python worker gets at a time; neither changes a result.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """What is run inside hands small batches to Python workers; the session's own settings come back behind it."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    for k, v in BATCHES.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def saved(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write a table to the shared folder and read it again: later steps neither repeat its work nor
    depend on an executor that may be lost."""
    return saved_at(df, tag, **options)[0]


def saved_at(df: DataFrame, tag: str, **options) -> tuple[DataFrame, str]:
    """The same, and the folder, for tables that are removed once a later one replaces them."""
    path = shared_dir(df.sparkSession, tag)
    with small_batches(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that saved_at() wrote and that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tidy(keep: str | None = None) -> None:
    """At the start of a task's work: a worker gives back what other operators' tasks left in its memory, but for the encoder of the file `keep`."""
    for path in [p for p in TextEncoder.kept if p != keep]:
        del TextEncoder.kept[path]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """pyarrow's file system for a folder's URI and its path there; used inside tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write_file(uri: str, name: str, chunks: Iterable[bytes]) -> int:
    """Write one file whole: under a name of this attempt first, then moved, so that a task that is run
    again (or twice at once) leaves the same file. Returns its size."""
    where, folder = filesystem(uri)
    where.create_dir(folder, recursive=True)
    part, size = f"{folder}/.{name}.{uuid.uuid4().hex[:8]}", 0
    with where.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    where.move(part, f"{folder}/{name}")
    return size


def running_start(df: DataFrame, part: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add the sum of `value` over all rows before each row. `df` is saved and range-partitioned: `part`
    numbers its partitions in order, `order` sorts within one. Only one total a partition reaches the driver."""
    bases = running_base(df.groupBy(part).agg(F.sum(value).alias("_t")), part, "_t")
    inside = F.sum(value).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, inside - F.col(value)).join(bases, part).withColumn(out, F.col(out) + F.col("_base")).drop("_base")


def running_base(totals: DataFrame, part: str, value: str) -> DataFrame:
    """(part, _base): of a row for each partition, the sum of `value` over those before it. The driver gets these rows."""
    base, at = [], 0
    for row in totals.orderBy(part).collect():
        base.append((row[part], at))
        at += row[value]
    return totals.sparkSession.createDataFrame(base or [(0, 0)], f"{part} int, _base long")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for further columns, like `names`, that the table has not."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. lower() is taken where the text is ASCII, as translate() is far slower."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def text_slices(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows of a string column, about `most` bytes at a time: (rows, their UTF-8 bytes end to end, where each row begins and the last
    ends). A null is empty. The bytes are the column's own memory, no copy."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield slice(lo, hi), data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]
        lo = hi


ODD = np.random.default_rng(20).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FIRST_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def padded_words(u: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of `u` on as a number; behind the end there are zeros."""
    return np.ndarray(len(u) + 1, "<u8", np.concatenate([u, np.zeros(8, np.uint8)]), strides=(1,))


def corpus_key(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """A key for run_hashes that all texts together give: who knows or writes some of them can't build two texts of one hash."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    a, b = docs.agg(F.bit_xor(F.xxhash64(text, F.lit(1))), F.bit_xor(F.xxhash64(F.lit(2), text))).first()
    return (a or 0) & (1 << 64) - 1, (b or 0) & (1 << 64) - 1


def run_hashes(u: np.ndarray, starts: np.ndarray, size: np.ndarray, key: tuple[int, int] = (0, 0), eight: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of runs of bytes in `u` under a key, eight bytes of all runs at a time; runs of over 512 bytes one by one."""
    eight = padded_words(u) if eight is None else eight
    h = mix((eight[starts] & _FIRST_BYTES[np.minimum(size, 8)]) ^ np.uint64(key[0])) + size.astype(np.uint64) * (ODD[63] ^ np.uint64(key[1] & ~1))
    todo, at = np.flatnonzero(size > 8), 8
    while len(todo) and at < 512:
        part = eight[starts[todo] + at] & _FIRST_BYTES[np.minimum(size[todo] - at, 8)]
        h[todo] = mix(h[todo] * ODD[0] + part)
        at += 8
        todo = todo[size[todo] > at]
    for i in todo.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(u[starts[i] : starts[i] + size[i]], digest_size=8, key=b"%d,%d" % key).digest(), "little")
    return h


def same_runs(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether runs of equal size hold the same bytes; a and b are padded_words."""
    same, todo, at = np.ones(len(size), bool), np.flatnonzero(size > 0), 0
    while len(todo):
        differ = ((a[a_at[todo] + at] ^ b[b_at[todo] + at]) & _FIRST_BYTES[np.minimum(size[todo] - at, 8)]) != 0
        same[todo[differ]] = False
        at += 8
        todo = todo[~differ & (size[todo] > at)]
        if at >= 512:
            for i in todo.tolist():
                same[i] = bytes(a.base[a_at[i] : a_at[i] + size[i]]) == bytes(b.base[b_at[i] : b_at[i] + size[i]])
            break
    return same


def low_words(u: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased, where their words `[^\\x20\\x09-\\x0D]+` start, sizes of the words, words of each text). `begin`: where each
    text begins, and the last one ends."""
    low = u | (((u - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5))
    inside = np.zeros(len(u) + 2, bool)
    inside[1:-1] = (u != 32) & ((u - np.uint8(9)) > 4)
    first, last = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = begin[(begin > 0) & (begin < len(u))]  # words of neighbouring texts touch here
    first[edge] = inside[edge + 1]
    last[edge - 1] = inside[edge]
    starts = np.flatnonzero(first)
    return low, starts, np.flatnonzero(last) + 1 - starts, np.diff(np.searchsorted(starts, begin))


def unit_starts(u: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where texts may be cut without a change to their ids: at the space after a character that is none, and between a letter and an
    ASCII character that is none. Of characters beyond ASCII only U+00C0 to U+07FF count, among which there is no space, and of these
    only U+00C0 to U+00FF (but for the two signs there) as letters. `begin`: where each text begins, and the last one ends."""
    one = np.uint8
    space = (u == 32) | (u == 10) | (u == 9) | (u == 13)
    solid = (u - one(33)) < 94
    letter = ((u | one(32)) - one(97)) < 26
    mark = solid & ~letter
    tail = (u[:-1] - one(0xC3)) < 29  # the next byte ends a character that counts
    solid[1:] |= tail
    letter[1:] |= (u[:-1] == 0xC3) & (u[1:] != 0x97) & (u[1:] != 0xB7)
    cut = np.zeros(len(u) + 1, bool)
    cut[1:-1] = (space[1:] & solid[:-1]) | (mark[1:] & letter[:-1])
    cut[begin] = True
    return np.flatnonzero(cut[:-1])


class TextEncoder:
    """Texts -> their ids, by a `tokenizers` file, remembering the ids of pieces met before.

    Texts are cut into units of which the ids don't depend on each other (unit_starts). A unit is found again by a hash under this worker's own key, and is
    the same only if its bytes are; new ones are given to the tokenizer. A text that holds one of the tokenizer's special tokens is encoded whole. Beyond `limit` units, or `MOST_BYTES`
    of them, all are forgotten, so a worker's memory doesn't grow with its input."""

    kept: ClassVar[dict[str, TextEncoder]] = {}
    MOST_BYTES = 32 << 20
    LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"

    def __init__(self, path: str, limit: int = 1_500_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype(np.uint16 if self.vocab_size <= 0x10000 else np.uint32)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit = limit
        self.key = (int.from_bytes(os.urandom(8), "little"), int.from_bytes(os.urandom(8), "little"))
        vocab = self.tokenizer.get_vocab()
        self.by_word = any(w.endswith("</w>") for w in vocab)
        self.edge = np.zeros(self.vocab_size, bool)  # ids that end a word, or that begin one after a space
        self.edge[[i for w, i in vocab.items() if (w.endswith("</w>") if self.by_word else w.startswith("\u0120"))]] = True
        self.plain = re.compile((b"[ \n]?" if self.by_word else b" ") + self.LETTERS).fullmatch  # units that are one word
        self.forget()

    def forget(self) -> None:
        bits = max(10, (2 * self.limit).bit_length())
        self.slots, self.shift = np.full(1 << bits, -1, np.int32), np.uint64(64 - bits)
        self.hash, self.at, self.n, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.dtype)
        self.bytes, self.byte_at, self.size = padded_words(np.zeros(0, np.uint8)), np.zeros(0, np.int32), np.zeros(0, np.int32)

    @classmethod
    def of(cls, path: str) -> TextEncoder:
        """The one of this Python worker, which goes on with later tasks."""
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of the units, their ids end to end in that order, ids of each)."""
        words = [i for i, t in enumerate(texts) if self.plain(t)]
        order, ids, counts = [], [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        rest = np.ones(len(texts), bool)
        for lo in range(0, len(words), 256):  # of words together the ids are told apart by their edges
            own = words[lo : lo + 256]
            line = (b" " if self.by_word else b"").join([texts[i] for i in own]).decode()
            flat = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self.edge[flat])
            if len(at) == len(own):
                order += own
                rest[own] = False
                ids.append(flat)
                counts.append(np.diff(at + 1, prepend=0) if self.by_word else np.diff(at, append=len(flat)))
        left = np.flatnonzero(rest).tolist()
        for lo in range(0, len(left), 1000):
            own = left[lo : lo + 1000]
            got = self.tokenizer.encode([texts[i].decode() for i in own], is_pretokenized=True, add_special_tokens=False)
            order += own
            ids.append(np.array(got.ids, self.dtype))
            counts.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(own)))
        return np.array(order, np.int64), np.concatenate(ids), np.concatenate(counts).astype(np.int32)

    def find(self, h: np.ndarray, eight: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of known units, -1 for others."""
        slot, out, todo = (h >> self.shift).astype(np.int64), np.full(len(h), -1, np.int32), np.arange(len(h))
        while len(todo):
            at = self.slots[slot[todo]]
            here = at >= 0
            here[here] = (self.hash[at[here]] == h[todo[here]]) & (self.size[at[here]] == size[todo[here]])
            here[here] = same_runs(self.bytes, self.byte_at[at[here]], eight, starts[todo[here]], size[todo[here]])
            out[todo[here]] = at[here]
            todo = todo[(at >= 0) & ~here]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
        return out

    def learn(self, h: np.ndarray, texts: list[bytes]) -> None:
        """Add units that are new; their hashes differ."""
        order, ids, n = self.units(texts)
        h = h[order]
        number = len(self.hash) + np.arange(len(h), dtype=np.int32)
        slot, todo = (h >> self.shift).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            self.slots[slot[free]] = number[free]  # of several the last has it
            todo = todo[self.slots[slot[todo]] != number[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
        self.hash, self.at = np.concatenate([self.hash, h]), np.concatenate([self.at, (len(self.pool) + np.cumsum(n) - n).astype(np.int32)])
        self.n, self.pool = np.concatenate([self.n, n]), np.concatenate([self.pool, ids])
        known, size = len(self.bytes) - 1, np.array([len(texts[i]) for i in order], np.int32)
        self.byte_at, self.size = np.concatenate([self.byte_at, (known + np.cumsum(size, dtype=np.int64) - size).astype(np.int32)]), np.concatenate([self.size, size])
        self.bytes = padded_words(np.concatenate([self.bytes.base[:known], np.frombuffer(b"".join([texts[i] for i in order]), np.uint8)]))

    def some(self, u: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of units that begin at `starts`, ids of each)."""
        size, eight = np.diff(starts, append=len(u)), padded_words(u)
        h = run_hashes(u, starts, size, self.key, eight)
        place = self.find(h, eight, starts, size)
        new = np.flatnonzero(place < 0)
        if len(new) and (len(self.hash) + len(new) > self.limit or len(self.bytes) + int(size[new].sum()) > self.MOST_BYTES):
            self.forget()
            self.slots = np.full(max(len(self.slots), 1 << (2 * len(h)).bit_length()), -1, np.int32)
            self.shift = np.uint64(64 - (len(self.slots) - 1).bit_length())
            new = np.arange(len(h))
        raw = u.tobytes() if len(new) else b""
        while len(new):  # of different units of one hash each turn learns one
            hashes, first = np.unique(h[new], return_index=True)
            at, n = starts[new[first]].tolist(), size[new[first]].tolist()
            self.learn(hashes, [raw[a : a + k] for a, k in zip(at, n, strict=True)])
            place[new] = self.find(h[new], eight, starts[new], size[new])
            new = new[place[new] < 0]
        return gathered(self.pool, self.at[place], self.n[place]), self.n[place]

    def __call__(self, column: pa.Array, end: int | None = None, most: int = 2_000_000) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, their ids end to end, ids of each row), about `most` bytes of text at a time; `end` is put behind each row's ids."""
        for rows, u, begin in text_slices(column, most):
            raw = u.tobytes() if self.special else b""
            whole = {}  # row -> ids of a text with a special token
            if any(s.encode() in raw for s in self.special):
                for i, (a, b) in enumerate(itertools.pairwise(begin.tolist())):
                    if any(s.encode() in raw[a:b] for s in self.special):
                        whole[i] = np.array(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, self.dtype)
            starts = unit_starts(u, begin)
            at, ids, n = 0, [], []
            while at < len(starts):  # a long text takes several turns
                to = int(np.searchsorted(starts, starts[at] + 2 * most))
                lo, hi = starts[at], starts[to] if to < len(starts) else len(u)
                some, k = self.some(u[lo:hi], starts[at:to] - lo)
                ids.append(some)
                n.append(k)
                at = to
            flat = np.concatenate(ids) if ids else np.zeros(0, self.dtype)
            edges = np.concatenate([[0], np.cumsum(np.concatenate(n))])[np.searchsorted(starts, begin)] if n else np.zeros(len(begin), np.int64)
            if whole:
                parts = [whole.get(i, flat[a:b]) for i, (a, b) in enumerate(itertools.pairwise(edges.tolist()))]
                flat, edges = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            count = np.diff(edges)
            if end is not None:
                flat, count = np.insert(flat, edges[1:], end), count + 1
            yield rows, flat, count


def gathered(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Runs of `pool` end to end."""
    return pool[np.arange(int(n.sum())) + np.repeat(at - (np.cumsum(n) - n), n)]


def cut_bytes(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    """A binary column of runs of `flat`, `n` items each."""
    ends = np.concatenate([[0], np.cumsum(n)]) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Connected components of an undirected graph of long ids: (node, component), component being the
    smallest node reachable. Nodes without an edge have no row; rows with a null end are dropped.

    Each round hooks every node to the least of itself and its neighbours, follows these pointers two steps further, and contracts
    the graph to what they point at; edges inside a contracted node fall away, so the graph shrinks fast and every edge is
    joined a few times only. Grouped minima combine before the shuffle: a node with very many neighbours is no group of one
    task. Each round's tables are saved."""
    spark = edges.sparkSession
    ends = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull())
    graph = saved(ends.filter("a < b").distinct(), "edges")
    labels = None
    while not graph.isEmpty():
        near = graph.union(graph.select(F.col("b"), F.col("a"))).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        hook = saved(near.select("node", F.least("node", "near").alias("to")), "hooks")
        one, two = hook.toDF("to", "to1"), hook.toDF("to1", "to2")
        far = saved(hook.join(one, "to").join(two, "to1").select("node", F.col("to2").alias("to")), "hooks")
        labels = far.toDF("node", "label") if labels is None else saved(labels.join(far.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        x, y = far.toDF("a", "x"), far.toDF("b", "y")
        graph = saved(graph.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct(), "edges")
    return spark.createDataFrame([], "node long, component long") if labels is None else labels.toDF("node", "component")
