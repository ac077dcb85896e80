"""Hierarchical splitting against real resamples, and its SQL against its numpy form."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sway.functions import splits
from sway.operators.evstats import resampled_median_gap
from sway.operators.ranks import values_at


def test_uniforms_are_keyed_and_even():
    u = splits.uniform(12345, np.arange(200_000), 3)
    assert (u == splits.uniform(12345, np.arange(200_000), 3)).all() and ((u > 0) & (u < 1)).all()
    counts = np.bincount((u * 50).astype(int), minlength=50)
    assert ((counts - 4000) ** 2 / 4000).sum() < 100  # chi-square of 49
    for other in (splits.uniform(12346, np.arange(200_000), 3), splits.uniform(12345, np.arange(200_000), 4), np.roll(u, 1)):
        assert abs(np.corrcoef(u, other)[0, 1]) < 0.01


@pytest.mark.parametrize("m,p", [(0, 0.5), (1, 0.3), (50, 0.3), (400, 0.5)])
def test_binomials(m, p):
    x = splits.binomial(np.random.default_rng(1).random(100_000), m, p)
    sd = np.sqrt(m * p * (1 - p))
    assert x.min() >= 0 and x.max() <= m and abs(x.mean() - m * p) <= 0.02 * sd and abs(x.std() - sd) <= 0.02 * sd


@pytest.mark.parametrize("n", [1, 2, 9, 100, 501])
def test_positions_spread_as_those_of_resamples(n):
    rng = np.random.default_rng(n)
    got = splits.position_of_rank(n, (n + 1) // 2, 777, np.arange(1, 10_001))
    want = np.sort(rng.integers(0, n, (10_000, n)), axis=1)[:, (n + 1) // 2 - 1]
    assert abs(got.mean() - want.mean()) < 0.06 * max(want.std(), 1e-9) + 1e-9
    assert abs(got.std() - want.std()) < 0.05 * max(want.std(), 1e-9) + 1e-9
    second = splits.position_of_rank(n, n // 2 + 1, 777, np.arange(1, 10_001))
    assert (second >= got).all()


def test_sql_repeats_the_splits():
    groups = {"a": (1, 5), "b": (2, 77), "c": (17, 1234567), "d": (300, 99999999)}
    con = duckdb.connect()
    con.execute("CREATE TABLE g (f VARCHAR, n BIGINT, salt BIGINT)")
    con.executemany("INSERT INTO g VALUES (?, ?, ?)", [(f, *v) for f, v in groups.items()])
    rows = con.execute("WITH RECURSIVE " + splits.positions_ctes("g", ["f"], 500) + " SELECT f, b, list_sort(list(i)) FROM drawn GROUP BY f, b").fetchall()
    assert len(rows) == 500 * len(groups)
    for f, (n, salt) in groups.items():
        b = np.array([r[1] for r in rows if r[0] == f])
        want = np.stack([splits.position_of_rank(n, k, salt, b) for k in ((n + 1) // 2, n // 2 + 1)], axis=1)
        assert want.tolist() == [r[2] for r in rows if r[0] == f]


def test_values_at_positions(spark):
    rng = np.random.default_rng(3)
    data = [("x", float(v)) for v in np.round(rng.normal(size=3000), 1)] + [("y", 5.0)] * 700 + [("y", 1.0), ("z", -1.0), ("z", None)]
    wanted = [(g, i, i * 10) for g, n in (("x", 3000), ("y", 701), ("z", 1)) for i in {0, 1, 7, n // 2, n - 1} if i < n]
    got = values_at(spark.createDataFrame(data, "g string, v double"), ["g"], "v", spark.createDataFrame(wanted, "g string, i long, tag long"), "i", "at").collect()
    assert len(got) == len(wanted)
    for g, i, tag, v in got:
        assert v == sorted(x for k, x in data if k == g and x is not None)[i] and tag == i * 10


def test_median_gap_bootstrap(spark):
    """Observed gap exactly; spread like that of plain resampling; no table of replicates x items in the plan."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(1, 1, 151), rng.normal(0, 2, 200)
    df = spark.createDataFrame([("k", True, float(x)) for x in a] + [("k", False, float(x)) for x in b], "k string, g boolean, x double")
    out = resampled_median_gap(df, ["k"], "g", "x", 3000).toPandas().set_index("b")["gap"]
    assert np.isclose(out[0], np.median(a) - np.median(b)) and len(out) == 3001
    plain = np.median(rng.choice(a, (3000, 151)), axis=1) - np.median(rng.choice(b, (3000, 200)), axis=1)
    assert np.allclose(np.percentile(out[out.index > 0], [2.5, 50, 97.5]), np.percentile(plain, [2.5, 50, 97.5]), atol=0.06)
    tiny = spark.createDataFrame([("k", True, 1.0), ("k", False, 3.0)], "k string, g boolean, x double")
    assert set(resampled_median_gap(tiny, ["k"], "g", "x", 20).select(F.col("gap")).toPandas()["gap"]) == {-2.0}
