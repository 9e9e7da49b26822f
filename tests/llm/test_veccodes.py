import hashlib

import numpy as np
import pytest

from marquee.llm import veccodes


def brute(rows, rounds=6, scale=4096):
    """Plain k-means over (vec_id, vector, label), without any bound."""
    ok = [r for r in rows if r[1] is not None and len(r[1]) and len(r[1]) % 8 == 0 and all(x is not None and np.isfinite(x) for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    x = np.floor(scale * np.array([r[1] for r in ok], float)).astype(np.int64).reshape(len(ok), 8, -1)
    books = x[:16].transpose(1, 0, 2).copy()

    def nearest():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2).sum(1)

    for _ in range(rounds):
        at, _ = nearest()
        for p in range(8):
            for e in range(books.shape[1]):
                own = x[at[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    at, error = nearest()
    by: dict = {}
    for r, e in zip(ok, error, strict=True):
        by[r[2]] = by.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in a), int(e), by[r[2]], sha) for r, a, e in zip(ok, at.tolist(), error, strict=True)), key=str)


def told(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


SCHEMA = "vec_id long, embedding array<double>, label int, code string, x int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, 2) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("n", "dim", "spread", "scale"), [(700, 16, 1.0, 4096), (500, 64, 0.2, 4096), (400, 8, 1.0, 3), (9, 24, 1.0, 4096), (300, 16, 8_000.0, 4096)])
def test_equals_plain_rounds(spark, n, dim, spread, scale):
    rng = np.random.default_rng(n)
    centre = rng.standard_normal((12, dim)) * spread
    rows = [(int(i), (centre[rng.integers(12)] + 0.4 * spread * rng.standard_normal(dim)).tolist(), [None, 1, 2][i % 3]) for i in rng.permutation(n)]
    assert told(veccodes.compress(frame(spark, rows), scale)) == brute(rows, scale=scale)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 8).astype(float).tolist(), i % 2) for i in range(60)]  # many ties
    rows += rows[:20] + [(None, [1.0] * 8, None), (None, [2.0] * 8, 1), (5, [0.5] * 8, 7)]
    rows += [(70, None, 1), (71, [], 1), (72, [1.0, None] * 4, 1), (73, [float("nan")] * 8, 1), (74, [float("inf")] * 8, 1), (75, [1.0] * 16, 1), (76, [1.0] * 7, 1)]
    assert told(veccodes.compress(frame(spark, rows))) == brute(rows)
    assert told(veccodes.compress(frame(spark, [r for r in rows if r[0] in (70, 71, 76)]))) == []
    assert told(veccodes.compress(frame(spark, [(1, [3.0] * 8, None)]))) == brute([(1, [3.0] * 8, None)])


def test_bounds_spare_distances_and_lists_shrink():
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((16, 8)) * 10_000
    x = np.floor(centre[rng.integers(16, size=4000)] + 300 * rng.standard_normal((4000, 8))).astype(np.int64)
    c = np.floor(centre).astype(np.int64)
    entries, bounds = veccodes.first_bounds(x, c, 4)
    new = c + 20
    moved = np.sqrt(((new - c) ** 2).sum(1).astype(float))
    entries, bounds, needed = veccodes.moved_bounds(x, new, moved, entries, bounds)
    d = veccodes.distances(x, new)
    assert (entries[:, 0] == d.argmin(1)).all() and (needed == 0).mean() > 0.9
    for b in (3, 2):
        entries, bounds = veccodes.shorter(entries, bounds, b)
        listed = np.zeros((len(x), 16), bool)
        np.put_along_axis(listed, entries.astype(int), True, 1)
        assert (np.sqrt(np.take_along_axis(d, entries.astype(int), 1))[:, 1:] >= bounds[:, 1:b]).all()
        assert (np.where(listed, np.inf, np.sqrt(d)).min(1) >= bounds[:, b]).all()
