import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marquee.llm import hmm
from marquee.llm.common import table
from marquee.llm.queries import op4_hidden_markov_lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, held):
    toks = [[*WORD.findall((t or "").translate(LOW)), None] for _, t in docs]
    c = Counter(x for t, h in zip(toks, held, strict=True) if not h for x in t)
    n, v = sum(c.values()), len(c)
    return [(len(t), sum(x in c for x in t), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for t in toks]


def model(states, classes, seed=1):
    rng = np.random.default_rng(seed)
    return hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(classes), states).T.copy())


def all_paths(m, x):
    return {p: m.start[p[0]] * m.emit[x[0], p[0]] * math.prod(m.step[a, b] * m.emit[c, b] for a, b, c in zip(p, p[1:], x[1:])) for p in itertools.product(range(len(m.start)), repeat=len(x))}


def test_forward_sums_over_all_paths():
    m = model(3, 5)
    docs = [np.array(x) for x in ([0], [1, 2], [4, 4, 0, 1], [3, 2, 1, 0, 4, 2], [2])]
    assert np.allclose(hmm.forward(m, docs), [math.log10(sum(all_paths(m, x).values())) for x in docs])


def test_likelihoods_of_all_texts_sum_to_one():
    m = model(3, 4)
    assert np.isclose((10 ** hmm.forward(m, [np.array(x) for x in itertools.product(range(4), repeat=4)])).sum(), 1)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_expected_counts_equal_those_of_all_paths(monkeypatch, size):
    monkeypatch.setattr(hmm, "SIDE_BY_SIDE", 3)
    m = model(2, 3)
    docs = [np.array(x, np.uint16) for x in ([0], [1, 2], [0, 2, 1, 1], [1, 1, 0, 2, 2, 0, 1], [2, 0, 0], [1, 2, 2, 0, 1])]
    emit, want_emit = np.zeros((3, 2)), np.zeros((3, 2))
    start, step = hmm.expected(m, docs, emit, size)
    want_start, want_step = np.zeros(2), np.zeros((2, 2))
    for x in docs:
        paths = all_paths(m, x)
        whole = sum(paths.values())
        for p, w in paths.items():
            want_start[p[0]] += w / whole
            for a, b in zip(p, p[1:]):
                want_step[a, b] += w / whole
            for c, s in zip(x, p, strict=True):
                want_emit[c, s] += w / whole
    assert np.allclose(emit, want_emit, atol=1e-5) and np.allclose(start, want_start, atol=1e-5) and np.allclose(step, want_step, atol=1e-5)


def independent(docs, held, rounds, secret):
    """Scores by a plain class model: dictionaries, one document at a time, doubles."""
    ids, classes = [], []
    for _, t in docs:
        (_, i, _), = hmm.token_ids(pa.array([t], pa.string()), secret)
        ids.append([int(x) for x in i])
    c = Counter(x for d, h in zip(ids, held, strict=True) if not h for x in d)
    best = sorted((x for x in c if x != hmm.END), key=lambda x: (-c[x], x))[: hmm.OWN - 1]
    own = {hmm.END: 0, **{x: k + 1 for k, x in enumerate(best)}}
    suffix = lambda x: x & (hmm.SUFFIXES - 1)
    total, once = Counter(), Counter()
    for x, n in c.items():
        if x not in own:
            total[suffix(x)] += n
            once[suffix(x)] += n == 1
    unknown = lambda k: (once[k] + 0.5) / (total[k] + 1) if total[k] else 1.0
    cls = lambda x: own[x] if x in own else hmm.OWN + suffix(x)
    prior = np.array([c[hmm.END], *(c[x] for x in best), *[0] * (hmm.OWN - 1 - len(best)), *(total[k] for k in range(hmm.SUFFIXES))]) + 0.5
    prior = prior / prior.sum()
    m, s = hmm.Model.first(prior), hmm.STATES
    classes = [[cls(x) for x in d] for d in ids]

    def alphas(d):
        out, scale = [], []
        for t, k in enumerate(d):
            a = (out[-1] @ m.step if t else m.start) * m.emit[k]
            scale.append(a.sum())
            out.append(a / scale[-1])
        return out, scale

    for _ in range(rounds):
        start, step, emit = np.zeros(s), np.zeros((s, s)), np.zeros((len(prior), s))
        for d, h in zip(classes, held, strict=True):
            if h:
                continue
            a, scale = alphas(d)
            beta = np.ones(s)
            for t in range(len(d) - 1, -1, -1):
                emit[d[t]] += a[t] * beta
                if t:
                    step += np.outer(a[t - 1], m.emit[d[t]] * beta / scale[t]) * m.step
                    beta = m.step @ (m.emit[d[t]] * beta / scale[t])
                else:
                    start += a[0] * beta
        emit += hmm.PRIOR * prior[:, None]
        step += hmm.PRIOR / s / s
        start += 1 / s
        m = hmm.Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))
    inner = lambda x: 0.0 if x in own else math.log10((1 - unknown(suffix(x))) * c[x] / total[suffix(x)]) if c[x] else math.log10(unknown(suffix(x)))
    return [sum(map(math.log10, alphas(k)[1])) + sum(map(inner, d)) for d, k in zip(ids, classes, strict=True)]


def test_scores_equal_an_independent_model(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id").collect()]
    held = [zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs]
    frame = spark.createDataFrame([(d, t, h) for (d, t), h in zip(docs, held, strict=True)], "doc_id long, text string, held boolean")
    got = [r.score for r in hmm.score(frame, hmm.F.col("held"), rounds=2).orderBy("doc_id").collect()]
    assert np.allclose(got, independent(docs, held, 2, hmm.corpus_key(frame)), rtol=1e-4)


def test_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").orderBy("doc_id").collect()]
    held = [zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs]
    got = op4_hidden_markov_lm(spark, sf).orderBy("doc_id").collect()
    assert [r.held_out for r in got] == held
    for r, (tokens, known, n, base) in zip(got, brute(docs, held), strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n) and math.isclose(r.base_score, base, rel_tol=1e-9)
    mean = lambda x: sum(getattr(r, x) for r in got if r.held_out) / sum(r.n_tokens for r in got if r.held_out)
    print("held-out log10 a token: base", mean("base_score"), "model", mean("score"))
    assert mean("score") > mean("base_score") + 0.1


@pytest.mark.parametrize("common", [3, 262_144])
def test_rows_of_every_kind(spark, monkeypatch, common):
    monkeypatch.setattr(hmm, "COMMON", common)
    texts = ["The cat sat", "the cat\u000bran", None, "", " \n ", "zzz the", "the cat sat", "word " * 30000, "É é é 一 二"]
    docs = [*enumerate(texts), (None, "the null cat")]
    held = [(d or 0) % 3 == 2 for d, _ in docs]
    frame = spark.createDataFrame([(d, t, h, "c", 1) for (d, t), h in zip(docs, held, strict=True)], "doc_id long, text string, held boolean, classes string, row int")
    got = sorted(hmm.score(frame, hmm.F.col("held"), rounds=2, states=2).collect(), key=lambda r: 99 if r.doc_id is None else r.doc_id)
    for r, (tokens, known, n, base) in zip(got, brute(docs, held), strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n) and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    assert len(got) == len(docs)


def test_nothing_to_learn(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = hmm.score(frame, hmm.F.lit(True), rounds=1).collect()
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in got)
    assert hmm.score(frame.limit(0), hmm.F.lit(False), rounds=1).count() == 0
