import hashlib
import random
import re
from collections import Counter

import pytest

from marquee.llm import decontam
from marquee.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return WORD.findall((text or "").translate(LOW))


def near(windows, docs, slop):
    """Windows that each text has a proximity match of, but no exact one: every term within `slop` of its place from the rarest term."""
    df = Counter(x for _, t in docs for x in split(t))
    out = {}
    for text in {t for _, t in docs}:
        w, n = split(text), 0
        for terms in windows:
            rare = min(range(len(terms)), key=lambda o: (df[terms[o]], o))
            starts = [p - rare for p, x in enumerate(w) if x == terms[rare]]
            at = lambda p, x: 0 <= p < len(w) and w[p] == x
            exact = any(all(at(k + o, x) for o, x in enumerate(terms)) for k in starts)
            n += not exact and any(all(any(at(k + o + d, x) for d in range(-slop, slop + 1)) for o, x in enumerate(terms)) for k in starts)
        out[text] = n
    return out


def brute(docs, items, width=10, slop=0):
    wins = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    sizes, close = {len(w) for w in wins}, near(wins, docs, slop) if slop else {}
    out = []
    for doc, text in docs:
        w, hit, own = split(text), set(), set()
        for i in range(len(w)):
            for n in sizes:
                if tuple(w[i : i + n]) in wins and i + n <= len(w):
                    hit |= set(range(i, i + n))
                    own |= wins[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit), close.get(text, 0)))
    return sorted(out, key=str)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and runs away"), (2, "Short one!"), (3, "Short one!"), (4, None), (5, "..."), (6, "one"), (7, "a a a a a a a a a a a a"), (None, "null id item"), (12, "À la carte é")]
TEXTS = [
    "x the QUICK brown fox jumps over the lazy dog and RUNS away y", "the quick brown fox jumps over the lazy cat", "short, one. short two one", None, "", "a " * 40, "a " * 9,
    "b short one short one " * 3000, "short one", "short one", "Null id  item; à la carte é À la carte é", "one",
]


def run(spark, docs, items, width, slop=0):
    d = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id long, text string, pos int, word string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, decontam.digest(decontam.report(d, b, width, slop)).collect()), key=str)


@pytest.mark.parametrize(("width", "slop"), [(10, 0), (10, 2), (3, 1), (1, 0)])
def test_windows_of_every_kind(spark, width, slop):
    docs = [*enumerate(TEXTS), (3, None), (8, "short one"), (None, "short one"), (-(1 << 63), "short one"), (20, "the quick brown very fox jumps over lazy the dog and runs away")]
    items = [(None, t) if i is None else (i, t) for i, t in ITEMS if i is not None]
    assert run(spark, docs, items, width, slop) == brute(docs, items, width, slop)


def test_repeated_rows_take_no_more_than_their_number(spark):
    docs = spark.range(20_000).selectExpr("7L doc_id", "'b short one short one' text")
    items = spark.createDataFrame([(1, "short one"), (2, "one short one")], "item_id long, text string")
    index, _, found = decontam.match(docs, items, slop=2)
    assert index.count() == 20_000 * 5 and found.filter("exact").count() == 3
    assert decontam.report(docs, items).filter("n_hit = 4").count() == 20_000


def test_random_texts(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("ab cd ef gh".split()) for _ in range(n))
    docs, items = [(i, text(rng.randrange(60))) for i in range(80)], [(i, text(rng.randrange(1, 9))) for i in range(12)]
    for slop in (0, 1):
        assert run(spark, docs, items, 4, slop) == brute(docs, items, 4, slop)


def test_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    got = sorted(map(tuple, decontam.digest(decontam.report(docs, items)).collect()), key=str)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and sum(r[-2] for r in want) > 3


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta"), (2, "alpha beta"), (3, "alpha x x x x x beta"), (4, "beta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert sorted((r.k1, r.exact) for r in decontam.match(docs, items, slop=2)[2].collect()) == [(1, False), (2, True), (4, False)]
    assert [(r.n_hit, r.n_near) for r in decontam.report(docs, items, slop=2).orderBy("doc_id").collect()] == [(0, 1), (2, 0), (0, 0), (0, 1)]


@pytest.mark.parametrize(("docs", "items"), [([], ITEMS[:2]), ([(1, "short one")], []), ([], [])])
def test_empty_tables(spark, docs, items):
    assert run(spark, docs, items, 10) == brute(docs, items)
