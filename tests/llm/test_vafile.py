import numpy as np
import pytest

from marquee.llm import vafile


def brute(rows, every=50, k=5, scale=256):
    ok = [(i, np.floor(scale * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i is None or i % every:
            continue
        all_ = sorted((-int(q @ x), j is None, j or 0) for b, (j, x) in enumerate(ok) if a != b and len(x) == len(q))
        out += [(i, r + 1, None if null else j, -s) for r, (s, null, j) in enumerate(all_[:k])]
    return sorted(out, key=str)


def told(frame):
    return sorted((tuple(r) for r in frame.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "q") for i, v in rows], "vec_id long, embedding array<double>, c int, n int, q string").repartition(3)


@pytest.mark.parametrize(("n", "dim", "spread"), [(1500, 16, 1.0), (600, 64, 0.1), (400, 3, 4_000.0), (300, 8, 40_000.0)])
def test_equals_all_scores(spark, n, dim, spread, monkeypatch):
    rng = np.random.default_rng(n)
    centre = rng.standard_normal((9, dim)) * spread
    rows = [(int(i), (centre[rng.integers(9)] + 0.2 * spread * rng.standard_normal(dim)).tolist()) for i in range(n)]
    rows += [(i + n, rows[7][1]) for i in range(60)]  # one vector very often
    monkeypatch.setattr(vafile, "BLOCK", 100)
    monkeypatch.setattr(vafile, "GROUP", 7)
    monkeypatch.setattr(vafile, "SHARE", 3)
    assert told(vafile.neighbours(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(120)]  # many ties
    rows += rows[:3] + [(50, [1.0] * 4), (50, [9.0] * 4), (None, [3.0] * 4), (None, [3.0] * 4), (-50, [2.0] * 4), (100, [-1.0] * 4)]
    rows += [(150, None), (200, []), (250, [1.0, None, 1.0, 1.0]), (300, [float("nan")] * 4), (350, [float("-inf")] * 4), (400, [1.0, 2.0]), (401, [0.0, 1.0]), (450, [1.0])]
    assert told(vafile.neighbours(frame(spark, rows))) == brute(rows)
    assert told(vafile.neighbours(frame(spark, rows).limit(0))) == []
    assert told(vafile.neighbours(frame(spark, [(50, [1.0])]))) == []


def test_a_component_too_large_fails(spark):
    with pytest.raises(Exception, match="too large"):
        vafile.neighbours(frame(spark, [(50, [1e30]), (51, [1.0])])).collect()


def test_bounds_spare_exact_vectors():
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((40, 32))
    x = np.floor(256 * (centre[rng.integers(40, size=4096)] + 0.1 * rng.standard_normal((4096, 32)))).astype(np.int64)
    some = np.zeros(len(x), vafile.record(32, 5))
    some["x"], some["ids"][:, 0], some["real"] = x, np.arange(len(x)), 1
    blocks = []
    for lo in range(0, len(x), 512):
        ends, width, cells = vafile.grid(x[lo : lo + 512])
        mid, off = vafile.cell_ends(ends, width, cells)
        assert (mid - off <= 2 * x[lo : lo + 512]).all() and (2 * x[lo : lo + 512] <= mid + off).all()
        blocks.append({"ends": ends.tobytes(), "width": width.tobytes(), "cells": cells.tobytes(), "lo": lo})
    best, taken = vafile.search(x[:2], blocks, lambda b: some[b["lo"] : b["lo"] + 512], 5)
    for i in range(2):
        want = sorted(zip((-(x @ x[i])).tolist(), range(len(x)), strict=True))[:6]
        assert [(-s, j) for s, j in zip(best.score[best.query == i].tolist(), best.id[best.query == i].tolist(), strict=True)] == want
    assert taken < 400
