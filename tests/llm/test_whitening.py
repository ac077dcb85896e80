"""Whitening against numpy's eigensolver and whole-number sums in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sway.llm import queries, whitening


def same_space(a, values, vectors):
    """Unit, orthogonal and an eigenvector each, to double precision."""
    size = max(np.abs(a).max(), 1e-300)
    k = len(values)
    assert np.abs(a / size @ vectors - vectors * (values / size)).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() <= 1e-12 * size


def matrices():
    rng = np.random.default_rng(5)
    gram = lambda m: m @ m.T
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    return {"random": gram(rng.normal(size=(64, 80))), "identity": 3 * np.eye(10), "diagonal": np.diag([1.0, 5, 5, 0, 5]),
            "zero": np.zeros((6, 6)), "one": np.array([[2.0]]), "two": np.array([[2.0, 1], [1, 2]]), "rank one": np.ones((20, 20)),
            "cluster": q @ np.diag([1, 1 - 1e-10, 1 - 2e-10, 1 - 1e-6] + [0.1] * 26) @ q.T, "wide": 1e200 * gram(rng.normal(size=(40, 80))),
            "small": 1e-200 * gram(rng.normal(size=(40, 80))), "blocks": np.diag([2.0] * 3 + [1.0] * 3)}


@pytest.mark.parametrize("name", matrices())
def test_leading_components(name):
    a = matrices()[name]
    same_space(a, *whitening.leading_components(a, min(4, len(a))))


def test_sturm_counts():
    rng = np.random.default_rng(2)
    d, e = rng.normal(size=12), rng.normal(size=11)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-4, 4, 50)
    assert whitening.counts_below(d, e, at).tolist() == [int((values < x).sum()) for x in at]


def brute(rows, k=4):
    """(key, component) -> (n, deviation, whitened, explained) of (key, vector) rows, signs as they come."""
    fine = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit], float) / n
    cov = z.T @ z / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    out = {}
    for i, x in fine:
        gaps = [n * c - s for c, s in zip(x, sums, strict=True)]
        w = np.array(gaps, float) / n @ q[:, :k] / np.sqrt(e[:k])
        for j in range(min(k, len(e))):
            out.setdefault((i, j + 1), []).append((n, sum(g * g for g in gaps), w[j], e[j] / e.sum()))
    return out


def compare(got, want):
    keys = {(r["vec_id"], r["component"]) for r in got}
    assert keys == set(want) and len(got) == sum(map(len, want.values()))
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r["whitened"])):
        choices = want[r["vec_id"], r["component"]]
        n, deviation, w, share = min(choices, key=lambda c: (c[1] != r["deviation"], abs(abs(c[2]) - abs(r["whitened"]))))
        assert (r["n"], r["deviation"], r["deviation_digits"]) == (n, deviation, str(deviation))
        sign = signs.setdefault(r["component"], math.copysign(1, w * r["whitened"]))
        assert abs(sign * w - r["whitened"]) < 1e-9 and abs(share - r["explained"]) < 1e-12
        assert r["identity_error"] < 1e-9


def test_query_on_its_table(spark, sf_dir):
    out = queries.op11_whitening(spark, sf_dir)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(out.collect(), brute(rows))


def test_hostile_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=5) * [3, 2, 1, 0.5, 0.1]]) for i in range(60)]
    rows += [(i + 100, rows[0][1]) for i in range(200)]  # one vector is most of the rows
    rows += [(7, rows[3][1]), (None, rows[4][1]), (500, None), (501, [1.0, None, 0.0, 0.0, 0.0]), (502, [math.nan] * 5), (503, [math.inf] + [0.0] * 4),
             (504, []), (505, [-0.0] * 5), (506, [0.0] * 5)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + [(900, [1.0, 2.0])]], "vec_id long, embedding array<double>, component int, key string")
    out = whitening.whiten(df.repartition(7)).collect()
    assert 900 not in {r["vec_id"] for r in out}
    compare(out, brute([r for r in rows if r[1] != []]))


def test_large_components_stay_exact(spark):
    rows = [(0, [2.0 ** 50, 0.0]), (1, [-2.0 ** 50, 3.0]), (2, [5.0, 2.0 ** 40]), (3, [1e300, 0.0]), (4, [-1e300, 1.0])]
    out = {(r["vec_id"], r["component"]): r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    xs = [[max(-2 ** 63, min(2 ** 63 - 1, math.floor(256 * c) if abs(c) < 1e200 else int(math.copysign(2 ** 63, c)))) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*xs, strict=True)]
    for (i, _), x in zip(rows, xs, strict=True):
        want = sum((5 * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        assert out[i, 1]["deviation_digits"] == str(want) and out[i, 1]["deviation"] is None


def test_few_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, None), (2, [])])).count() == 0
    one = whitening.whiten(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["n"] == 1 and r["deviation"] == 0 and r["identity_error"] is None for r in one)
    line = whitening.whiten(make([(1, [0.0, 0.0]), (2, [2.0, 0.0])])).where(F.col("component") == 1).collect()
    assert sorted(abs(r["whitened"]) for r in line) == [1.0, 1.0] and all(r["explained"] == 1.0 for r in line)


def test_too_many_dimensions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MAX_DIMS", 2)
    with pytest.raises(ValueError, match="3 dimensions"):
        whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>"))
