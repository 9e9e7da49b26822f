import random
import re
import zlib
from collections import Counter

import pytest

from marquee.llm import spelling


def brute(rows, ratio=2):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w in n:
        close = [v for v in n if near(w, v)]
        best = min(close, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = len(close)
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], out[w], n.get(form[w])))
    return sorted(rows)


def told(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(seed, letters, most, size):
    rng = random.Random(seed)
    words = []
    for _ in range(size):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(4, most)))
        words += [w] * rng.choice([1, 2, 4, 9])
        for _ in range(3):
            i = rng.randrange(len(w))
            words += [rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])] * rng.choice([1, 3, 5])
    rng.shuffle(words)
    return [(i, " ".join(words[i::40])) for i in range(40)]


@pytest.mark.parametrize(("letters", "most", "parts"), [("ab", 8, "4"), ("abcdeéÿÉ", 9, "7"), ("aab", 30, "16")])
def test_equals_all_pairs_of_words(spark, letters, most, parts):
    rows = corpus(len(letters), letters, most, 60)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert told(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark):
    long = "x" * 70_000 + "y"
    rows = [(1, None), (2, ""), (None, "walls Walls WALLS"), (None, "walls Walls WALLS"), (3, "wallS halls halls halls 12 balls-balls,balls"), (3, "Étude Étude Étude étude étude étude ×××××")]
    rows += [(k, long) for k in range(4, 9)] + [(k, long[1:]) for k in range(9, 13)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, word string, n long, id long")
    got = told(spelling.variants(frame))
    assert got == brute(rows)
    assert len(got) > 4
    assert told(spelling.variants(frame.limit(0))) == []


def test_borders_inside_long_common_prefixes(spark):
    """Words that share long prefixes lie on both sides of every border."""
    words = ["prefix" * 3 + a + b for a in "abcdefgh" for b in "abcdefgh"] + ["prefix" * 2, "prefix" * 3]
    rows = [(k, " ".join(words)) for k in range(3)]
    for parts in (3, 9, 40):
        table = spelling.numbered(spelling.saved(spark.createDataFrame([(w, k) for k, w in enumerate(words)], "s string, k long"), "t"), "t", parts)
        own = spelling.borders(table)
        named, prefixes = {}, {}
        for r in table.collect():
            nodes = spelling.common_names(r.s, spelling.np.array(r.nodes), own[r.part]).tolist()
            for i, x in enumerate(nodes):
                assert named.setdefault(r.s[: i + 1], x) == x
                assert prefixes.setdefault(x, r.s[: i + 1]) == r.s[: i + 1]
    assert told(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
