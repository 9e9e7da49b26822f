"""Exact n-gram Jaccard join by signature trees.

A document's set holds its distinct five-word shingles. Two documents link when their sets' Jaccard similarity is at least
`percent` per cent; classes of equal sets are linked, so copies cost no pairs.

1. Linked sets share a token of their prefixes: a set's first tokens, one more than it may lack of a partner, in an order that all sets
   agree on. Tokens of a fixed `SAMPLED` share of the hash range come first, by how many sets hold them. Posting
   lists of these count the sets; a set whose prefix no other set touches is out. Along what is left of each list, ordered by size,
   neighbours of fitting sizes are tied; the tied groups hold all links.
2. A group's sets, ordered by their least hashes, are cut into leaf blocks under trees of nodes. A node has the OR of its sets' token
   bitmaps and their size range. A dual traversal, level by level, keeps a pair of nodes only while the largest overlap they
   allow reaches what the larger of their least sizes needs.
3. Kept pairs of blocks are tasks: the traversal goes on inside down to single sets, whose overlap is counted exactly; nodes that
   are one component already are skipped, so that a group of very many near copies costs no quadratic work. The links found span
   the components of all links.

Tokens and classes are 64-bit hashes of shingles and sets, under a key that the whole corpus gives, so that a pair of texts can't be built to
share one; among n different ones two meet by chance with probability n * n / 2^65. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a text of
fewer words than `words` has their whole sequence as its one shingle. Null text and text without words have an empty set, which links with
nothing. Repeated rows are documents of their own. A null doc_id is larger than any other. An empty table gives no row.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ODD, components, corpus_key, low_words, mix, n_parts, run_hashes, running_base, saved, text_slices, tidy
from .decontam import key

WORDS, PERCENT = 5, 75
#: A leaf block's most sets and tokens; sets a leaf inside a task; nodes under a node.
BLOCK_SETS, BLOCK_TOKENS, LEAF, FAN = 256, 400_000, 8, 8
BITS = 1 << 16
#: Share of the hash range whose tokens are counted; sets of a token beyond which all counts are alike.
SAMPLED, MANY = 0.4, 50_000
#: Classes that a task remembers, to send one of equal sets.
REMEMBERED = 500_000
#: Rows up to which a saved table is sent to all executors.
BROADCAST_ROWS = 500_000


def shingle_sets(column: pa.Array, words: int = WORDS, secret: tuple[int, int] = (0, 0)) -> Iterator[tuple[slice, list[np.ndarray]]]:
    """(rows, sorted distinct shingle hashes of each of them)."""
    for rows, u, begin in text_slices(column):
        low, starts, size, n = low_words(u, begin)
        h = run_hashes(low, starts, size, secret)
        if len(h) >= words:
            grams = np.zeros(len(h) - words + 1, np.uint64)
            for j in range(words):
                grams += h[j : len(h) - words + 1 + j] * ODD[j]
            grams = mix(grams)
        out, at = [], 0
        for k in n.tolist():
            if k >= words:
                out.append(np.unique(grams[at : at + k - words + 1]))
            elif k:
                out.append(mix((h[at : at + k] * ODD[:k]).sum(keepdims=True) + ODD[62 - k : 63 - k]))
            else:
                out.append(np.zeros(0, np.uint64))
            at += k
        yield rows, out


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def needed(n: int, percent: int) -> int:
    """The least overlap of a set of n tokens with a set that it links to."""
    return -(-percent * n // 100)


def classes(docs: DataFrame, words: int, secret: tuple[int, int]) -> DataFrame:
    """Saved (doc_id, k1, k2, n, cls): a set's size and class for each document; k1 and k2 are kept from docs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for s, sets in shingle_sets(batch.column("text"), words, secret):
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[s] for c in ("doc_id", "k1", "k2")], pa.array([len(x) for x in sets], pa.int64()), pa.array([class_of(x) if len(x) else None for x in sets], pa.int64())], ["doc_id", "k1", "k2", "n", "cls"])

    return saved(docs.mapInArrow(rows, "doc_id long, k1 long, k2 long, n long, cls long"), "classes")


def postings(docs: DataFrame, words: int, percent: int, secret: tuple[int, int]) -> DataFrame:
    """(token, cls, n, sent): the tokens of every set in the sampled range, filled up beyond it to the length of the prefix;
    sent is how many the set has here. Of equal sets a task sends one, if they are among the last `REMEMBERED` or so that it met."""
    limit = np.uint64(int(SAMPLED * (1 << 64)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tidy()
        for batch in batches:
            for _, sets in shingle_sets(batch.column("text"), words, secret):
                seen = set() if len(seen) > REMEMBERED else seen
                own = []
                for h in sets:
                    if len(h) and (cls := class_of(h)) not in seen:
                        seen.add(cls)
                        own.append((cls, len(h), h[: max(int(np.searchsorted(h, limit)), len(h) - needed(len(h), percent) + 1)]))
                if own:
                    each = [len(x) for _, _, x in own]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([x for _, _, x in own]).view(np.int64)), pa.array(np.repeat(np.array([c for c, _, _ in own], np.int64), each)),
                            pa.array(np.repeat(np.array([n for _, n, _ in own], np.int32), each)), pa.array(np.repeat(np.array(each, np.int32), each)),
                        ],
                        ["token", "cls", "n", "sent"],
                    )

    return docs.select("text").mapInArrow(rows, "token long, cls long, n int, sent int")


def shared(lists: DataFrame) -> DataFrame:
    """Of posting lists sorted by (token, cls), without repeated rows, those of at least two sets, with `sets`: how many, MANY at
    most, and more for tokens outside the sampled range. A list is held up to MANY rows only."""
    limit = int(SAMPLED * (1 << 64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        long_token, last = None, None  # a token whose list was too long to hold; the last row seen

        def out(cols: list[np.ndarray], sets: np.ndarray) -> pa.RecordBatch:
            sets = np.where(cols[0].view(np.uint64) < np.uint64(limit), np.minimum(sets, MANY), MANY + 1)
            return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(sets.astype(np.int32))], ["token", "cls", "n", "sent", "sets"])

        def whole(cols: list[np.ndarray]) -> pa.RecordBatch | None:
            _, at, n = np.unique(cols[0], return_inverse=True, return_counts=True)
            n = np.where(cols[0] == long_token, MANY, n[at]) if long_token is not None else n[at]
            keep = n > 1
            return out([c[keep] for c in cols], n[keep]) if keep.any() else None

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            new = np.ones(len(cols[0]), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            if last == (cols[0][0], cols[1][0]):
                new[0] = False
            last = (cols[0][-1], cols[1][-1])
            cols = [np.concatenate([*([h] if held else []), c[new]]) for h, c in zip(held or cols, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if len(cols[0]) - cut > MANY or cols[0][-1] == long_token:
                done, held = cols, []
                if cut:
                    before = whole([c[:cut] for c in cols])
                    if before is not None:
                        yield before
                long_token = cols[0][-1]
                yield out([c[cut:] for c in done], np.full(len(done[0]) - cut, MANY))
                continue
            held = [c[cut:] for c in cols]
            before = whole([c[:cut] for c in cols])
            if before is not None:
                yield before
        if held:
            before = whole(held)
            if before is not None:
                yield before

    return saved(lists.mapInArrow(rows, "token long, cls long, n int, sent int, sets int"), "shared")


def prefixes(found: DataFrame, percent: int) -> DataFrame:
    """(token, cls, n): a set's shared tokens that lie in its prefix. Tokens that it shares with none come before them."""
    own = W.partitionBy("cls")
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("sent") - F.count("*").over(own))
    ranked = found.withColumn("rank", F.row_number().over(own.orderBy("sets", "token"))).withColumn("room", room)
    return ranked.filter("rank <= room").select("token", "cls", "n")


def ties(prefix: DataFrame, percent: int) -> DataFrame:
    """Saved distinct (a, b) of neighbours along each posting list whose sizes fit. Lists are streamed, and a long one is dealt over
    several partitions; the rows on both sides of a cut between partitions reach the driver, two a partition."""
    spark = prefix.sparkSession
    lists = saved(prefix.repartitionByRange(n_parts(spark), "token", "n", "cls").sortWithinPartitions("token", "n", "cls").withColumn("pid", F.spark_partition_id()), "lists")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] | None = None
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            t, c, n, pid = now if last is None else [np.concatenate([x, y]) for x, y in zip(last, now, strict=True)]
            last = [x[-1:] for x in (t, c, n, pid)]
            tied = (pid[1:] == pid[:-1]) & (t[1:] == t[:-1]) & (c[1:] != c[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(c[1:], c[:-1])[tied]), pa.array(np.maximum(c[1:], c[:-1])[tied])], ["a", "b"])

    row = F.struct("token", "n", "cls")
    cuts = [r for r in lists.groupBy("pid").agg(F.min(row).alias("first"), F.max(row).alias("last")).orderBy("pid").collect()]
    over = [(*sorted((x["last"].cls, y["first"].cls)),) for x, y in itertools.pairwise(cuts) if x["last"].token == y["first"].token and x["last"].cls != y["first"].cls and 100 * x["last"].n >= percent * y["first"].n]
    inside = lists.repartitionById(n_parts(spark), F.col("pid")).sortWithinPartitions("pid", "token", "n", "cls").mapInArrow(rows, "a long, b long")
    return saved(inside.union(spark.createDataFrame(over, "a long, b long")).distinct(), "ties")


def checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def tied_sets(docs: DataFrame, found: DataFrame, groups: DataFrame, words: int, secret: tuple[int, int]) -> DataFrame:
    """Saved (grp, cls, low, tokens) of one document of each tied class, computed again from its text. The document is named by its id
    and its text's hash; of equal rows a task computes one."""
    one = found.filter("cls is not null").groupBy("cls").agg(F.min(F.struct("k1", "k2")).alias("doc"))
    wanted = saved(groups.withColumnRenamed("component", "grp").join(one, groups.node == one.cls).select(F.col("doc.k1").alias("k1"), F.col("doc.k2").alias("k2"), "cls", "grp"), "tied")
    texts = docs.join(checked(wanted), ["k1", "k2"]).select("cls", "grp", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            seen = set() if len(seen) > REMEMBERED else seen
            new = []
            for i, c in enumerate(batch.column("cls").to_pylist()):
                if c not in seen:
                    seen.add(c)
                    new.append(i)
            few = batch.take(pa.array(new, pa.int64()))
            for s, sets in shingle_sets(few.column("text"), words, secret):
                yield pa.RecordBatch.from_arrays(
                    [few.column("grp")[s], few.column("cls")[s], pa.array([int(h[0] >> np.uint64(1)) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["grp", "cls", "low", "tokens"]
                )

    return saved(texts.mapInArrow(rows, "grp long, cls long, low long, tokens binary"), "tied-sets")


def bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, bool)
    bits[(tokens >> np.uint64(48)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


class Node:
    """Sets lo..hi of a task's list: OR of their bitmaps, size range, and the most tokens that one of them hides in shared bits."""

    __slots__ = ("bits", "children", "hi", "hidden", "least", "lo", "most")

    def __init__(self, lo, hi, bits, least, most, hidden, children=()):
        self.lo, self.hi, self.bits, self.least, self.most, self.hidden, self.children = lo, hi, bits, least, most, hidden, children


def joined(nodes: list[Node]) -> Node:
    bits = np.bitwise_or.reduce([x.bits for x in nodes])
    return Node(nodes[0].lo, nodes[-1].hi, bits, min(x.least for x in nodes), max(x.most for x in nodes), max(x.hidden for x in nodes), nodes)


def tree(sets: list[np.ndarray], lo: int, hi: int) -> Node:
    """A signature tree over sets lo..hi."""
    level = []
    for i in range(lo, hi):
        bits = bitmap(sets[i])
        level.append(Node(i, i + 1, bits, len(sets[i]), len(sets[i]), len(sets[i]) - int(np.bitwise_count(bits).sum())))
    width = LEAF
    while len(level) > 1:
        level = [joined(level[i : i + width]) for i in range(0, len(level), width)]
        width = FAN
    return level[0]


def may_link(x: Node, y: Node, percent: int) -> bool:
    """Whether the largest overlap of a set under x and one under y can be enough."""
    if 100 * x.most < percent * y.least or 100 * y.most < percent * x.least:
        return False
    overlap = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.hidden, y.hidden)
    return overlap >= needed(max(x.least, y.least), percent)


def links_among(sets: list[np.ndarray], cut: int, percent: int) -> list[tuple[int, int]]:
    """Links that span the components of sets[:cut] and sets[cut:] together, from pairs across the cut; of all pairs if
    cut is 0."""
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    whole: set[tuple[int, int]] = set()  # ranges known to be one component

    def one(x: Node, y: Node) -> bool:
        for n in (x, y):
            if (n.lo, n.hi) not in whole:
                r = root(n.lo)
                if any(root(i) != r for i in range(n.lo + 1, n.hi)):
                    return False
                whole.add((n.lo, n.hi))
        return root(x.lo) == root(y.lo)

    def visit(x: Node, y: Node) -> None:
        if x is y:
            for i, c in enumerate(x.children):
                visit(c, c)
            for i, c in enumerate(x.children):
                for d in x.children[i + 1 :]:
                    visit(c, d)
            return
        if one(x, y) or not may_link(x, y, percent):
            return
        if x.children or y.children:
            for c in x.children or [x]:
                for d in y.children or [y]:
                    visit(c, d)
            return
        a, b = sets[x.lo], sets[y.lo]
        both = len(np.intersect1d(a, b, assume_unique=True))
        if 100 * both >= percent * (len(a) + len(b) - both):
            parent[root(x.lo)] = root(y.lo)
            out.append((x.lo, y.lo))

    if cut:
        visit(tree(sets, 0, cut), tree(sets, cut, len(sets)))
    else:
        top = tree(sets, 0, len(sets))
        visit(top, top)
    return out


MEMBER = "array<struct<cls:long,tokens:binary>>"


def leaf_blocks(sets: DataFrame, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Saved blocks (grp, block, path, members, least, most, hidden, bits): runs of a group's sets in the order of their least hashes,
    cut at partition ends too, so that no group is one task's."""
    spark = sets.sparkSession

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, k, grp, own, held, seen = TaskContext.get().partitionId(), 0, None, [], 0, None

        def close() -> pa.RecordBatch:
            nonlocal own, held, k
            tokens = [np.frombuffer(x["tokens"], np.uint64) for x in own]
            top = tree(tokens, 0, len(tokens))
            row = {"grp": grp, "block": pid * (1 << 32) + k, "members": own, "least": top.least, "most": top.most, "hidden": top.hidden, "bits": top.bits.tobytes()}
            own, held, k = [], 0, k + 1
            return pa.RecordBatch.from_pylist([row], BLOCK)

        for batch in batches:
            for g, c, raw in zip(*(batch.column(x).to_pylist() for x in ("grp", "cls", "tokens")), strict=True):
                if own and (g != grp or len(own) >= block_sets or held >= BLOCK_TOKENS):
                    yield close()
                if (g, c) == seen:  # a repeated row
                    continue
                grp, seen = g, (g, c)
                own.append({"cls": c, "tokens": raw})
                held += len(raw) // 8
        if own:
            yield close()

    placed = sets.repartitionByRange(n_parts(spark), "grp", "low", "cls").sortWithinPartitions("grp", "low", "cls")
    return saved(placed.mapInArrow(rows, f"grp long, block long, members {MEMBER}, least long, most long, hidden long, bits binary"), "blocks")


BLOCK = pa.schema([("grp", pa.int64()), ("block", pa.int64()), ("members", pa.list_(pa.struct([("cls", pa.int64()), ("tokens", pa.binary())]))), ("least", pa.int64()), ("most", pa.int64()), ("hidden", pa.int64()), ("bits", pa.binary())])


def block_pairs(blocks: DataFrame, percent: int, fan: int = FAN) -> DataFrame:
    """Saved (x, y) of different blocks of a group that may hold a link: from the top of each group's tree, node pairs are
    expanded to their children and pruned, level by level."""
    most = blocks.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    if most < 2:
        return blocks.select(F.col("block").alias("x"), F.col("block").alias("y")).limit(0)
    # leaves are numbered along their partitions, and by what lies before their group's first one; a node's parent has its number over `fan`
    pid = F.shiftright("block", 32).cast("int").alias("pid")
    before = running_base(blocks.groupBy(pid).count(), "pid", "count")
    placed = blocks.select("grp", "block", pid).join(before, "pid").select("grp", "block", (F.col("_base") + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))).alias("place"))
    first = placed.groupBy("grp").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    leaves = saved(placed.join(first, "grp").select("grp", "block", (F.col("place") - F.col("first")).alias("node")), "leaves")
    nodes = [saved(leaves.join(blocks.select("block", "least", "most", "hidden", "bits"), "block").drop("block").withColumn("up", F.floor(F.col("node") / fan)), "nodes")]
    while most > 1:
        up = nodes[-1].groupBy("grp", F.col("up").alias("node")).agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("hidden").alias("hidden"), F.collect_list("bits").alias("all"))
        nodes.append(saved(up.mapInArrow(or_all, "grp long, node long, least long, most long, hidden long, bits binary").withColumn("up", F.floor(F.col("node") / fan)), "nodes"))
        most = -(-most // fan)
    pairs = nodes[-1].select("grp", F.col("node").alias("x"), F.col("node").alias("y"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = lambda s: [Node(0, 1, np.frombuffer(b, np.uint64), a, m, h) for b, a, m, h in zip(*(batch.column(f"{c}_{s}").to_pylist() for c in ("bits", "least", "most", "hidden")), strict=True)]
            ok = [may_link(p, q, percent) for p, q in zip(side("x"), side("y"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("grp", "x", "y")], ["grp", "x", "y"]).filter(pa.array(ok, pa.bool_()))

    for level in reversed(nodes[:-1]):
        side = lambda s: level.select("grp", F.col("up").alias(s), F.col("node").alias(f"node_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("bits", "least", "most", "hidden")])  # noqa: B023, E731
        both = pairs.join(side("x"), ["grp", "x"]).join(side("y"), ["grp", "y"]).filter("node_x <= node_y").drop("x", "y").withColumnsRenamed({"node_x": "x", "node_y": "y"})
        pairs = saved(both.mapInArrow(keep, "grp long, x long, y long"), "node-pairs")
    block = lambda n: leaves.select("grp", F.col("node").alias(n), F.col("block").alias(f"{n}_block"))
    return saved(pairs.filter("x < y").join(block("x"), ["grp", "x"]).join(block("y"), ["grp", "y"]).select(F.col("x_block").alias("x"), F.col("y_block").alias("y")), "block-pairs")


def or_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.bitwise_or.reduce([np.frombuffer(b, np.uint64) for b in own]).tobytes() for own in batch.column("all").to_pylist()]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("grp", "node", "least", "most", "hidden")], pa.array(bits, pa.binary())], ["grp", "node", "least", "most", "hidden", "bits"])


def links(blocks: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Saved (a, b) of linked classes: inside every block, and across the pairs of blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, other in zip(batch.column("own").to_pylist(), batch.column("other").to_pylist(), strict=True):
                members = own + (other or [])
                sets = [np.frombuffer(m["tokens"], np.uint64) for m in members]
                got = links_among(sets, len(own) if other else 0, percent) if len(sets) > 1 else []
                yield pa.RecordBatch.from_arrays([pa.array([members[i]["cls"] for i, _ in got], pa.int64()), pa.array([members[j]["cls"] for _, j in got], pa.int64())], ["a", "b"])

    inside = blocks.select(F.col("members").alias("own"), F.lit(None).cast(MEMBER).alias("other"))
    side = lambda s, name: blocks.select(F.col("block").alias(s), F.col("members").alias(name))
    across = pairs.join(side("x", "own"), "x").join(side("y", "other"), "y").select("own", "other")
    return saved(inside.union(across).mapInArrow(rows, "a long, b long"), "set-links")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block_sets: int = BLOCK_SETS, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has (doc_id, k2, n_shingles, cls, grp, component_id) for each document, k2 being the text's part of
    decontam.key and grp the number of its component, null where it is alone; links has pairs of classes that link and span the
    components of all links."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *key(docs))
    spark = docs.sparkSession
    secret = corpus_key(docs)
    found = classes(docs, words, secret)
    lists = postings(docs, words, percent, secret).repartition(n_parts(spark), "token").sortWithinPartitions("token", "cls")
    groups = components(ties(prefixes(shared(lists), percent), percent), "a", "b")
    sets = tied_sets(docs, found, groups, words, secret)
    blocks = leaf_blocks(sets, block_sets)
    linked = links(blocks, block_pairs(blocks, percent, fan), percent)
    label = components(linked, "a", "b")
    rows = found.join(label.withColumnRenamed("node", "cls"), "cls", "left")
    rows = saved(rows.select("doc_id", "k2", "n", "cls", F.coalesce("component", "cls").alias("grp")), "members")
    least = saved(rows.filter("grp is not null").groupBy("grp").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")).filter("size > 1").select("grp", "first", F.col("grp").alias("own")), "components")
    members = rows.join(least, "grp", "left").select("doc_id", "k2", F.col("n").alias("n_shingles"), "cls", F.col("own").alias("grp"), F.coalesce("first", "doc_id").alias("component_id"))
    return members, linked
