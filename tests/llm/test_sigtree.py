import random
import re

import numpy as np
import pytest

from marquee.llm import sigtree
from marquee.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 75 * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= 75 * (len(a) + len(b) - both) and group[i] != group[j]:
                    old, new = group[i], group[j]
                    group = [new if g == old else g for g in group]
    first = {}
    for g, (doc, _) in zip(group, rows, strict=True):
        first[g] = min(x for x in (first.get(g), doc) if x is not None) if (first.get(g), doc) != (None, None) else None
    return sorted(((doc, len(s), first[g] if s else doc) for (doc, _), s, g in zip(rows, sets, group, strict=True)), key=str)


def run(spark, rows, **sizes):
    docs = spark.createDataFrame([(d, t, 1, "c") for d, t in rows], "doc_id long, text string, n int, cls string").repartition(3)
    members, _ = sigtree.join(docs, **sizes)
    return sorted(map(tuple, members.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def text(rng, n):
    return " ".join(rng.choice("abcdefgh") + rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(n))


def edited(rng, t, share):
    return " ".join(rng.choice("pqrs") * 3 if rng.random() < share else w for w in t.split(" "))


@pytest.mark.parametrize("sizes", [{}, {"block_sets": 4, "fan": 2}])  # the latter: several blocks a group, several levels
def test_copies_edits_and_odd_texts(spark, sizes):
    rng = random.Random(5)
    bases = [text(rng, n) for n in (4, 30, 60, 60, 200, 900)]
    passage = text(rng, 50)
    texts = [edited(rng, rng.choice(bases), rng.choice([0, 0.01, 0.03, 0.05])) for _ in range(140)]
    texts += [edited(rng, bases[4], 0.02) for _ in range(60)] + [f"{text(rng, 60)} {passage} {text(rng, 60)}" for _ in range(30)]
    texts += [None, "", " \t\n", "One", "one", "a b c d e", "A b\u000bc d e", "a b c d", "x" * 200, "é É", "é é", *[bases[1]] * 5]
    rows = [*enumerate(texts), (3, texts[3]), (3, "other text altogether for id three"), (None, bases[1]), (None, "alone")]
    assert run(spark, rows, **sizes) == brute(rows)


def test_similarities_at_the_threshold(spark):
    rng = random.Random(6)
    rows = []
    for k in range(60):  # a tail of new words leaves exactly known overlaps
        base = [f"w{rng.randrange(10**6)}" for _ in range(44)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + [f"v{rng.randrange(10**6)}" for _ in range(k % 20 + 5)]))]
    assert run(spark, rows) == brute(rows)


def test_given_documents(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    members, _ = sigtree.join(docs)
    got = sorted(map(tuple, members.select("doc_id", "n_shingles", "component_id").collect()), key=str)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want and sum(r[0] != r[2] for r in want) > 20


def test_no_documents(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1)]


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64) << np.uint64(int(rng.integers(44, 50)))) for _ in range(9)]
        x, y = sigtree.tree(sets, 0, 4), sigtree.tree(sets, 4, 9)
        linked = any(100 * (k := len(np.intersect1d(a, b))) >= 75 * (len(a) + len(b) - k) for a in sets[:4] for b in sets[4:])
        assert sigtree.may_link(x, y, 75) or not linked


def test_long_lists_are_not_held(spark, monkeypatch):
    rows = [(t, c, 9, 9) for t in (3, 5, 8, 1 << 62) for c in range({3: 1, 5: 40, 8: 2, 1 << 62: 3}[t]) for _ in range(2)]
    lists = spark.createDataFrame(rows, "token long, cls long, n int, sent int").coalesce(1).sortWithinPartitions("token", "cls")
    got = sigtree.shared(lists).collect()
    assert len(got) == 45 and {(r.token, r.sets) for r in got} == {(5, 40), (8, 2), (1 << 62, 3)}
