"""Spelling variants: words one inserted, deleted or replaced code point apart, by a dictionary of pairs of trie nodes.

1. Maximal runs `[A-Za-z\\u00C0-\\u00FF]+` are counted over all texts, A-Z lower-cased. A run whose crc32 with its document is divisible by `DAMAGE`
   loses one code point first. Words have `MIN_LENGTH` code points and `MIN_COUNT` occurrences at least.
2. The words, sorted over range partitions, number the nodes of their trie: a word makes a new node for each prefix that the word before
   it lacks. Nodes of prefixes that lie in several partitions are prefixes of a partition's first word; they are named by the first
   border that they cross, which the first and last word of each partition tell. The reversed words number the suffixes.
3. A word gives a pair (prefix node, suffix node) for each place, once with the code point there skipped and once with nothing taken out. Words with
   equal pairs that both skip differ in that code point alone; a skipping word and a whole one differ by an insertion. Only the first of equal
   neighbouring code points is skipped for insertions, so each pair of words is met once. A pair of nodes has as many words as the
   alphabet has letters, and one, at most.
4. A word's form is its near word of most occurrences (ties: the smallest), if it has `RATIO` times the word's at least. Forms are followed
   to their ends by doubling the steps.

Nodes are numbers of prefixes, not hashes: neighbours are exact. Null text has no words; a null doc_id stands as an empty string before the colon. Repeated rows
count each. Columns other than doc_id and text are ignored. An empty table gives no row. The driver gets two words a partition.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_parts, saved, tidy

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DAMAGE, MIN_LENGTH, MIN_COUNT, RATIO = 97, 5, 3, 2
#: Different words, and code points of them, that a task counts before it hands them on.
HELD_WORDS, HELD_CHARS = 200_000, 8_000_000
#: Bits of a number inside a partition.
INSIDE = 40


def lowered(run: str) -> str:
    return run.lower() if run.isascii() else run.encode().lower().decode()


def damaged(run: str, before: int) -> str:
    """`before`: the crc32 of what stands before the run."""
    h = zlib.crc32(run.encode(), before)
    if h % DAMAGE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(s, n) of all words, s being the word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held: Counter[str] = Counter()
        chars = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["s", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                own: Counter[str] = Counter()
                for run, n in Counter(m[0] for m in RUN.finditer(text.as_py())).items():
                    own[lowered(run)] += n
                before = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for run, n in own.items():
                    word = damaged(run, before)
                    if len(word) >= min_length:
                        chars += 0 if word in held else len(word)
                        held[word] += n
                if len(held) > HELD_WORDS or chars > HELD_CHARS:
                    yield out()
                    held.clear()
                    chars = 0
        if held:
            yield out()

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "s string, n long")
    return found.groupBy("s").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def shared_length(a: str, b: str) -> int:
    """Length of the common prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    lo, hi = 0, most  # a[:lo] is shared, a[:hi] isn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


def numbered(words: DataFrame, tag: str, parts: int) -> DataFrame:
    """The saved table `words` (s and two longs) with part, at (the row's place in it) and `nodes`, the numbers of all prefixes of s in this partition."""
    columns = [c for c in words.columns if c != "s"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        part, at, made, before, path = TaskContext.get().partitionId(), 0, 0, "", []
        for batch in batches:
            texts = batch.column("s").to_pylist()
            lo = 0
            while lo < len(texts):
                nodes, ends, hi = [], [0], lo
                while hi < len(texts) and ends[-1] < 200_000:
                    word = texts[hi]
                    known = shared_length(before, word)
                    del path[known:]
                    path.extend(range(made + 1, made + 1 + len(word) - known))
                    made += len(word) - known
                    nodes.append(np.array(path, np.int64))
                    ends.append(ends[-1] + len(word))
                    before = word
                    hi += 1
                flat = np.concatenate(nodes) + (part << INSIDE)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c)[lo:hi] for c in ("s", *columns)], pa.array(np.full(hi - lo, part, np.int32)), pa.array(np.arange(at, at + hi - lo)), pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64()))],
                    ["s", *columns, "part", "at", "nodes"],
                )
                at += hi - lo
                lo = hi

    schema = ", ".join(f"{c} {t}" for c, t in [("s", "string"), *[x for x in words.dtypes if x[0] != "s"], ("part", "int"), ("at", "long"), ("nodes", "array<long>")])
    return saved(words.repartitionByRange(parts, "s").sortWithinPartitions("s").mapInArrow(rows, schema), tag)


def borders(rows: DataFrame) -> dict[int, list[tuple[str, list[tuple[int, int]]]]]:
    """Of each partition, for the border before it and the one behind it: (the first word behind the border, [(length, border)]): its prefixes up to
    that length, and beyond the one before, cross that border first."""
    ends = rows.groupBy("part").agg(F.min("s").alias("first"), F.max("s").alias("last")).orderBy("part").collect()
    runs: list[list[tuple[int, int]]] = [[]]  # before the first partition nothing is shared
    for b in range(1, len(ends)):
        cross = shared_length(ends[b - 1].last, ends[b].first)
        through = min(shared_length(ends[b - 1].first, ends[b - 1].last), cross, runs[-1][-1][0] if runs[-1] else 0)
        own, at = [], 0
        for length, border in runs[-1]:  # prefixes that reach through the whole partition before
            if at < min(length, through):
                own.append((at := min(length, through), border))
        if cross > at:
            own.append((cross, b))
        runs.append(own)
    runs.append([])
    first = [x.first for x in ends] + [""]
    return {x.part: [(first[b], runs[b]), (first[b + 1], runs[b + 1])] for b, x in enumerate(ends)}


def common_names(word: str, nodes: np.ndarray, own: list[tuple[str, list[tuple[int, int]]]]) -> np.ndarray:
    """Nodes of prefixes that cross a border get the name that all partitions give them, a negative number."""
    at = 0
    for first, runs in own:
        most = shared_length(word, first) if runs and word[:1] == first[:1] else 0
        lo = 0
        for length, border in runs:
            hi = min(length, most)
            if hi > max(lo, at):
                lo = max(lo, at)
                nodes[lo:hi] = -((border << INSIDE) + np.arange(lo + 1, hi + 1))
                at = hi
            lo = max(lo, length)
    return nodes


def node_pairs(words: DataFrame, before: dict, behind: dict) -> DataFrame:
    """(p, s, kind, n, id) of words (id, n, word, part, nodes, back_part, back_nodes); kind: 0 whole, 1 skips a code point, 2 skips one that isn't
    like the one before it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            held = 0
            for id_, n, word, part, nodes, back_part, back in zip(*(batch.column(c) for c in ("id", "n", "word", "part", "nodes", "back_part", "back_nodes")), strict=True):
                text = word.as_py()
                k = len(text)
                p = np.concatenate([[0], common_names(text, nodes.values.to_numpy(zero_copy_only=False).copy(), before[part.as_py()])])
                s = np.concatenate([[0], common_names(text[::-1], back.values.to_numpy(zero_copy_only=False).copy(), behind[back_part.as_py()])])[::-1]
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                new = np.ones(k, np.int8)
                new[0] = 2
                new[1:] += codes[1:] != codes[:-1]
                for c, x in zip(out, (np.concatenate([p, p[:-1]]), np.concatenate([s, s[1:]]), np.concatenate([np.zeros(k + 1, np.int8), new]), np.full(2 * k + 1, n.as_py()), np.full(2 * k + 1, id_.as_py())), strict=True):
                    c.append(x)
                held += 2 * k + 1
                if held > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["p", "s", "kind", "n", "id"])
                    out, held = [[], [], [], [], []], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["p", "s", "kind", "n", "id"])

    return words.mapInArrow(rows, "p long, s long, kind byte, n long, id long")


def near_words(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): of each word with near ones their number, and the struct (n, -id) of the most frequent one."""
    groups = pairs.groupBy("p", "s").agg(F.collect_list(F.struct("kind", "n", "id")).alias("m")).filter((F.size("m") > 1) & F.exists("m", lambda x: x["kind"] > 0))

    def others(x):
        met = lambda y: F.when(x["kind"] == 0, y["kind"] == 2).when(x["kind"] == 1, (y["kind"] > 0) & (y["id"] != x["id"])).otherwise(y["id"] != x["id"])
        near = F.transform(F.filter("m", met), lambda y: F.struct(y["n"].alias("n"), (-y["id"]).alias("back")))
        return F.struct(x["id"].alias("id"), F.size(near).alias("k"), F.array_max(near).alias("best"))

    each = groups.select(F.inline(F.transform("m", others))).filter("k > 0")
    return each.groupBy("id").agg(F.sum("k").cast("long").alias("n_near"), F.max("best").alias("best"))


def ends_of(steps: DataFrame) -> DataFrame:
    """(id, root): of (id, to), where following `to` ends. Each round doubles the steps taken."""
    at = steps.select("id", F.col("to").alias("root"))
    while True:
        further = at.select(F.col("id").alias("root"), F.col("root").alias("far"))
        at = saved(at.join(further, "root", "left").select("id", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if at.filter("moved").isEmpty():
            return at.select("id", "root")
        at = at.select("id", "root")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of docs (doc_id, text)."""
    parts = n_parts(docs.sparkSession)
    forward = numbered(saved(vocabulary(docs, min_length, min_count), "vocabulary"), "prefixes", parts)
    words = forward.select((F.shiftleft(F.col("part").cast("long"), INSIDE) + F.col("at")).alias("id"), F.col("s").alias("word"), "n", "part", "nodes")
    reverse = numbered(words.select(F.reverse("word").alias("s"), "id"), "suffixes", parts)
    both = words.join(reverse.select("id", F.col("part").alias("back_part"), F.col("nodes").alias("back_nodes")), "id")
    near = near_words(node_pairs(both, borders(forward), borders(reverse)))
    near = saved(near.select("id", "n_near", (-F.col("best.back")).alias("to"), F.col("best.n").alias("to_n")), "near-words")
    told = saved(words.join(near, "id", "left").withColumn("is_form", F.coalesce(F.col("to_n") >= ratio * F.col("n"), F.lit(False))).select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *[F.when(F.col("is_form"), F.col(c)).alias(c) for c in ("to", "to_n")]), "forms")
    roots = ends_of(told.filter("to is not null").select("id", "to"))
    names = told.select("id", "word")
    told = told.join(roots, "id", "left").join(names.toDF("to", "form"), "to", "left").join(names.toDF("root", "end"), "root", "left")
    return told.select("word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", F.col("to_n").alias("form_n"))
