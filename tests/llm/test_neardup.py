import numpy as np
import pandas as pd
import pytest

from marquee.llm import neardup
from marquee.llm.common import components, table


def brute(ids, vectors, threshold=0.9):
    ok = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and ids[i] is not None]
    n, low = [0] * len(ids), list(ids)
    pairs = []
    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            x, y = (np.array(vectors[ok[k]], float) for k in (a, b))
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                pairs.append((ok[a], ok[b]))
                n[ok[a]] += 1
                n[ok[b]] += 1
    for _ in range(len(ids)):
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    return pd.DataFrame({"vec_id": ids, "n_links": n, "component_id": low})


@pytest.mark.parametrize("cap", [4, 512])
def test_odd_vectors_copies_and_blocks(spark, cap):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((6, 16))
    vectors = [list(map(float, base[i % 6] + 0.12 * rng.standard_normal(16))) for i in range(60)] + [[1.0] * 16] * 7
    vectors += [None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, [1.0] * 8]
    ids = list(range(len(vectors)))
    frame = spark.createDataFrame([(i, v, 3, 4) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>, n int, t int").repartition(3)
    got = neardup.near_duplicates(frame, recall=0.9999, cap=cap).toPandas().sort_values("vec_id").reset_index(drop=True)
    want = brute(ids, vectors)
    pd.testing.assert_frame_equal(got[["vec_id", "n_links", "component_id"]], want, check_dtype=False)
    assert (got.kept == (got.vec_id == got.component_id)).all()


def test_recall_among_the_given_embeddings(spark):
    rng = np.random.default_rng(2)
    rows = [(r.vec_id, r.embedding) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    for i, (_, v) in enumerate(rows[:200]):  # copies turned by up to the largest angle that still links
        v, turn = np.array(v), rng.standard_normal(len(v))
        turn -= v * (v @ turn) / (v @ v)
        angle = np.arccos(0.9) * rng.uniform(0.5, 1.1)
        rows.append((10_000 + i, list(map(float, np.cos(angle) * v + np.sin(angle) * np.linalg.norm(v) * turn / np.linalg.norm(turn)))))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id")
    want = brute(*map(list, zip(*rows, strict=True))).sort_values("vec_id")
    assert len(got) == len(want) and (got.n_links.values <= want.n_links.values).all()
    assert got.n_links.sum() >= 0.95 * want.n_links.sum() > 0


def test_no_vectors_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = neardup.near_duplicates(spark.createDataFrame([(None, [1.0]), (1, [1.0]), (1, [1.0])], schema)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True)]


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(0, 99)] + [(200, 203), (203, 201), (7, 7), (300, None)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "x long, y long"), "x", "y").collect()))
    assert got == {**{i: 0 for i in range(100)}, 200: 200, 201: 200, 203: 200}
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0
