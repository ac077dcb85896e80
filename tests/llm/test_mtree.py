"""M-tree search against brute force, and the computations it saves."""

import numpy as np
from pyspark.sql import functions as F

from sway.llm import mtree


def brute(rows, k, step=50):
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(good):
        if q % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for n, (i, w) in enumerate(good) if n != at)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=5, step=50, kind="float"):
    df = spark.createDataFrame([(i, v, 1, "x", 3) for i, v in rows], f"vec_id long, embedding array<{kind}>, part int, id string, row int")
    vector = F.transform("embedding", lambda x: 256 * x.cast("double"))
    return sorted(map(tuple, mtree.top_k(df, vector, F.col("id") % step == 0, k).collect()))


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PART_ROWS", 40)
    monkeypatch.setattr(mtree, "PAGE", 6)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] * (1 + i % 3) + rng.normal(0, .2, 8)]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [(5000 + i, [0.5] * 8) for i in range(0, 100, 10)]
    rows += [(6000, None), (6050, [None] + [1.0] * 7), (6100, [float("nan")] * 8), (6150, [float("inf")] * 8), (None, [1.0] * 8),
             (6200, [1.0, 2.0]), (6250, []), (400, rows[0][1]), (400, rows[1][1])]
    assert run(spark, rows) == brute(rows, 5)


def test_large_components_take_part(spark):
    """Products beyond a long are exact too, and a large vector heads the lists of others."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 2)]) for i in range(120)]
    got = run(spark, rows + [(500, [1e6, 0.0])], kind="double")
    assert got == brute(rows + [(500, [1e6, 0.0])], 5)
    assert {(q, r) for q, r, i, _ in got if i == 500} == {(q, 1) for q, v in rows if q % 50 == 0 and v[0] > 0} | {(q, 5) for q, r, i, _ in got if i == 500 and r == 5}
    assert sum(q == 500 for q, *_ in got) == 5
    huge = rows + [(550, [2.0 ** 50, -3.0]), (600, [2.0 ** 50, 2.0 ** 49]), (650, [-2.0 ** 50, 1.5])]
    assert run(spark, huge, kind="double") == brute(huge, 5)


def test_repeated_ids_stay(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 60, [float(np.float32(x)) for x in rng.normal(0, 1, 4)]) for i in range(200)] + [(50, [1.0] * 4)] * 30
    got = run(spark, rows)
    assert got == brute(rows, 5) and len(got) == 5 * sum(i % 50 == 0 for i, _ in rows)


def test_few_rows_and_none(spark):
    assert run(spark, [(0, [1.0]), (50, [2.0]), (7, [-1.0])]) == brute([(0, [1.0]), (50, [2.0]), (7, [-1.0])], 5)
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []


def test_tree_saves_computations(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (20, 16))
    x = (centres[rng.integers(0, 20, 3000)] + rng.integers(-15, 16, (3000, 16))).astype(np.int64)
    most = float((x.astype(float) ** 2).sum(axis=1).max())
    pages = dict(enumerate(mtree.build(np.stack([np.arange(3000)] * 2, axis=1), x, x[0], most)))
    assert all(p.leaf or len(p.refs) <= mtree.PAGE for p in pages.values())
    computed = []
    for q in range(0, 3000, 100):
        got = mtree.search(pages, x[q], q, 5, most, computed=computed)
        want = sorted(((int(x[q] @ x[i]), -i) for i in range(3000) if i != q), reverse=True)[:5]
        assert got == [(s, -i, -i) for s, i in want]
    assert np.mean(computed) < 1500
