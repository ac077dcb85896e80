"""Queries: bootstrap intervals, BH adjustment, ridge sufficient statistics and fit (step 8)."""

from __future__ import annotations

import numpy as np

from sway.operators import resample as RS
from sway.operators import shares, shift
from sway.plans.catalog import query
from sway.plans.q_evidence import _ITEMS, PATTERN_FEATURES, _analysis_items
from sway.plans.q_omind import _SCORES_CTE
from sway.plans.q_shift import _TEST_COLUMNS, SHIFT_TESTS
from sway.sources import fixtures as fx

N_BOOT = 2000


@query("bootstrap_mean_ci", _SCORES_CTE + f"""
, items AS (SELECT variant, model, open_mindedness_score AS x,
              row_number() OVER (PARTITION BY variant, model ORDER BY issue) - 1 AS idx FROM scores),
g AS (SELECT variant, model, count(*) AS n, avg(x) AS mean FROM items GROUP BY variant, model),
dr AS (SELECT g.variant, g.model, g.n, b.b, i.i FROM g, range(1, {N_BOOT} + 1) b(b), range(0, g.n) i(i)),
dx AS (SELECT variant, model, b,
         ('0x' || substr(md5(concat_ws(':', '42', variant, model, CAST(b AS VARCHAR), CAST(i AS VARCHAR))), 1, 8))::BIGINT
           % n AS idx FROM dr),
reps AS (SELECT dx.variant, dx.model, dx.b, avg(items.x) AS m FROM dx JOIN items USING (variant, model, idx)
         GROUP BY dx.variant, dx.model, dx.b),
bd AS (SELECT variant, model, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM reps
       GROUP BY variant, model)
SELECT g.variant, g.model, g.n, round(g.mean, 6) AS mean,
  round(CASE WHEN g.n = 1 THEN g.mean ELSE bd.lo END, 6) AS ci_low,
  round(CASE WHEN g.n = 1 THEN g.mean ELSE bd.hi END, 6) AS ci_high
FROM g LEFT JOIN bd USING (variant, model)
""")
def q_bootstrap_mean_ci(spark, sf_dir):
    """Bootstrap (2 000 draws) percentile interval of the mean open-mindedness score per
    (variant, model) over issues; draws are keyed MD5 indices, so DuckDB reproduces them."""
    from sway.plans.q_omind import _scores
    _, s = _scores(spark, sf_dir)
    return RS.bootstrap_mean_ci(s, ["variant", "model"], "open_mindedness_score", "issue", N_BOOT)


@query("bh_adjust", SHIFT_TESTS + f"""
, r AS (SELECT *, row_number() OVER (ORDER BY p_value, model, ecase) AS rk, count(*) OVER () AS total FROM tests WHERE p_value IS NOT NULL)
SELECT {_TEST_COLUMNS}, round(least(1, min(p_value * total / rk) OVER (ORDER BY rk DESC)), 6) AS p_adjusted FROM r
""")
def q_bh_adjust(spark, sf_dir):
    """Benjamini-Hochberg adjusted p-values of the paired-shift tests."""
    from sway.session import materialize
    st = materialize(shift.shift_statistics(shares.trial_shares(fx.trials(spark, sf_dir))))
    return RS.bh_adjust(st, "p_value", ["model", "ecase"])


def _ridge_table(spark, sf_dir):
    j = _analysis_items(spark, sf_dir).select("evidence_hash", "median_abs_shift", *PATTERN_FEATURES).dropna()
    z = RS.standardize(j, list(PATTERN_FEATURES))
    return RS.kfold_index(z, "evidence_hash", 5)


def _gram_sql() -> str:
    z = ", ".join(f"coalesce(({c}::DOUBLE - avg({c}::DOUBLE) OVER ()) / nullif(stddev_pop({c}::DOUBLE) OVER (), 0), 0) AS {c}" for c in PATTERN_FEATURES)
    fs = PATTERN_FEATURES
    sums = [("n", "count(*)"), *[(f"sx:{a}", f"sum({a})") for a in fs],
            *[(f"sxx:{a}:{b}", f"sum({a} * {b})") for i, a in enumerate(fs) for b in fs[i:]],
            *[(f"sxy:{a}", f"sum({a} * median_abs_shift)") for a in fs], ("sy", "sum(median_abs_shift)"), ("syy", "sum(median_abs_shift * median_abs_shift)")]
    cells = ", ".join(f"{{'term': '{t}', 'value': ({e})::DOUBLE}}" for t, e in sums)
    return _ITEMS + f""", zs AS (SELECT evidence_hash, median_abs_shift, {z}, row_number() OVER (ORDER BY evidence_hash) - 1 AS pos, count(*) OVER () AS n FROM it),
fs AS (SELECT *, CASE WHEN pos < (n % 5) * (n // 5 + 1) THEN pos // (n // 5 + 1) ELSE n % 5 + (pos - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold FROM zs)
SELECT fold, c.term, round(c.value, 6) AS value FROM (SELECT fold::INTEGER AS fold, unnest([{cells}]) AS c FROM fs GROUP BY fold)"""


@query("ridge_gram", _gram_sql())
def q_ridge_gram(spark, sf_dir):
    """Per-fold sufficient statistics (n, sums, cross-products) of the standardised
    12-feature ridge model, one Spark aggregate."""
    return RS.fold_gram(_ridge_table(spark, sf_dir), list(PATTERN_FEATURES), "median_abs_shift")


@query("ridge_cv")
def q_ridge_cv(spark, sf_dir):
    """Ridge with alpha chosen by 5-fold CV over 80 log-spaced values (1e-4 .. 1e3); the
    12 x 12 solves run on the fold Gram table (a few hundred numbers)."""
    g = q_ridge_gram(spark, sf_dir).collect()
    alphas = np.logspace(-4, 3, 80)
    best, beta = RS.ridge_cv_from_gram([(r["fold"], r["term"], r["value"]) for r in g],
                                       list(PATTERN_FEATURES), alphas)
    rows = [(f, float(b), float(abs(b)), best) for f, b in zip(PATTERN_FEATURES, beta)]
    return spark.createDataFrame(rows, "feature string, coef_standardized double, abs_coef double, alpha double")


@query("ridge_bootstrap")
def q_ridge_bootstrap(spark, sf_dir):
    """Median, 95 % interval and sign rates of the ridge coefficients over 250 bootstrap
    replicates (keyed splits; rows-only, brute force in tests/test_ridge.py)."""
    j = _analysis_items(spark, sf_dir).select("evidence_hash", "median_abs_shift", *PATTERN_FEATURES).dropna()
    return RS.ridge_bootstrap(j, list(PATTERN_FEATURES), "median_abs_shift", "evidence_hash", 250)
