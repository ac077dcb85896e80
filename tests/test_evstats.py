"""Pattern tests and family gaps against direct numpy computations on the same item table."""

import math

import numpy as np
import pandas as pd

from sway.functions import dist
from sway.plans import q_evidence as QE
from sway.sources import fixtures as fx


def _mw_p(x, y):
    allv = np.concatenate([x, y])
    ranks = pd.Series(allv).rank(method="average").to_numpy()
    n1, n2 = len(x), len(y)
    u1 = ranks[:n1].sum() - n1 * (n1 + 1) / 2
    u = max(u1, n1 * n2 - u1)
    _, counts = np.unique(np.round(allv, 12), return_counts=True)
    n = n1 + n2
    tie = (counts ** 3 - counts).sum()
    if min(n1, n2) <= 8 and tie == 0:
        # exact: U distribution by brute-force enumeration of rank subsets of the smaller group
        from itertools import combinations
        small, big = (n1, n2) if n1 <= n2 else (n2, n1)
        us = np.array([sum(c) - small * (small + 1) / 2 for c in combinations(range(1, n + 1), small)])
        return min(1.0, 2 * np.mean(us >= u))
    s = math.sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1))))
    z = (u - n1 * n2 / 2 - 0.5) / s
    return min(1.0, math.erfc(z / math.sqrt(2)))


def test_pattern_tests_brute_force(spark, sf_dir):
    items = QE._analysis_items(spark, sf_dir).toPandas()
    got = QE.ES.pattern_tests(QE._analysis_items(spark, sf_dir), list(QE.BINARY_FEATURES),
                              list(QE.NUMERIC_FEATURES)).toPandas()
    assert len(got) > 0
    for _, r in got.iterrows():
        inn = items["evidence_effect_pattern"] == r["pattern"]
        x = items.loc[inn, r["feature"]].astype(float).to_numpy()
        y = items.loc[~inn, r["feature"]].astype(float).to_numpy()
        assert math.isclose(r["mean_in"], x.mean(), rel_tol=1e-9, abs_tol=1e-12)
        if len(y):
            assert math.isclose(r["mean_out"], y.mean(), rel_tol=1e-9, abs_tol=1e-12)
        if r["feature_type"] == "binary":
            a, c = int(x.sum()), int(y.sum())
            p = dist.fisher_exact([a], [len(x) - a], [c], [len(y) - c])[0]
            assert math.isclose(r["p_value"], p, rel_tol=1e-9)
        elif len(x) and len(y):
            assert math.isclose(r["p_value"], _mw_p(x, y), rel_tol=1e-6, abs_tol=1e-12)


def test_family_gap_observed_and_bounds(spark, sf_dir):
    pairs = QE._pairs(spark, sf_dir).toPandas()
    fam = dict(fx.model_families(spark, sf_dir).toPandas().values)
    same = pairs.apply(lambda r: fam[r["model_a"]] == fam[r["model_b"]], axis=1)
    g = QE.ES.family_gap(QE._pairs(spark, sf_dir), fx.model_families(spark, sf_dir),
                         ["pearson_r", "spearman_rho"], 200, 200).toPandas().set_index("metric")
    for m in ("pearson_r", "spearman_rho"):
        v = pairs[m]
        exp = np.median(v[same].dropna()) - np.median(v[~same].dropna())
        assert math.isclose(g.loc[m, "median_gap_same_minus_cross"], exp, rel_tol=1e-9, abs_tol=1e-12)
        assert 0.0 <= g.loc[m, "label_permutation_p_value"] <= 1.0
        assert g.loc[m, "pair_bootstrap_ci_lower"] <= g.loc[m, "pair_bootstrap_ci_upper"]


def test_average_rank_and_numbering_match_pandas(spark):
    from sway.operators.ranks import average_rank, numbered

    rng = np.random.default_rng(0)
    p = pd.DataFrame({"g": rng.integers(0, 3, 4000), "v": np.round(rng.normal(0, 1, 4000), 2)})
    p["h"] = [f"{x:08x}" for x in rng.permutation(4000) * 1000003]
    p.loc[::97, "v"] = 7.0
    got = average_rank(spark.createDataFrame(p), ["g"], "v", "r").toPandas().set_index("h")
    want = p.assign(r=p.groupby("g")["v"].rank()).set_index("h")
    assert (got["r"].sort_index() == want["r"].sort_index()).all()
    got = numbered(spark.createDataFrame(p), ["g"], "h").toPandas().set_index("h")
    want = p.assign(idx=p.groupby("g")["h"].rank().astype(int) - 1).set_index("h")
    assert (got["idx"].sort_index() == want["idx"].sort_index()).all()
    nulls = spark.createDataFrame([(1, None), (1, 2.0)], "g int, v double")
    assert sorted(average_rank(nulls, ["g"], "v", "r").select("r").collect(), key=str) == [(1.0,), (None,)]


def test_pattern_tests_pass_over_the_items_once(spark):
    rng = np.random.default_rng(3)
    n = 400
    items = pd.DataFrame({"evidence_hash": [f"{i:04x}" for i in range(n)], "evidence_effect_pattern": rng.choice(["a", "b", "c"], n, p=[0.6, 0.39, 0.01]),
                          "flag": rng.random(n) < 0.3, "tied": np.round(rng.normal(0, 1, n), 1), "free": rng.normal(0, 1, n)})
    items.loc[items.index[::50], "tied"] = -0.0
    items.loc[5, "free"] = None
    items.loc[7, "evidence_effect_pattern"] = "lone"
    df = spark.createDataFrame(items.astype({"flag": float, "free": object}).where(items.notna(), None), "evidence_hash string, evidence_effect_pattern string, flag double, tied double, free double")
    out = QE.ES.pattern_tests(df, ["flag"], ["tied", "free"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "evidence_hash" not in plan and "Generate" not in plan and "Expand" not in plan  # only counts of values
    got = out.toPandas()
    assert len(got) == 3 * items["evidence_effect_pattern"].nunique()
    for _, r in got.iterrows():
        known = items[items[r["feature"]].notna()]
        inn = known["evidence_effect_pattern"] == r["pattern"]
        x, y = known.loc[inn, r["feature"]].to_numpy(float), known.loc[~inn, r["feature"]].to_numpy(float)
        assert math.isclose(r["mean_in"], x.mean(), rel_tol=1e-9, abs_tol=1e-12) and math.isclose(r["mean_out"], y.mean(), rel_tol=1e-9, abs_tol=1e-12)
        if r["feature"] == "flag":
            p = dist.fisher_exact([int(x.sum())], [int((1 - x).sum())], [int(y.sum())], [int((1 - y).sum())])[0]
        else:
            p = _mw_p(x, y) if min(len(x), len(y)) > 2 else r["p_value"]
            v = [((z - z.mean()) ** 2).sum() for z in (x, y)]
            assert math.isclose(r["cohens_d"], (x.mean() - y.mean()) / math.sqrt(sum(v) / (len(known) - 2)), rel_tol=1e-9)
        assert math.isclose(r["p_value"], p, rel_tol=1e-6, abs_tol=1e-12), r
