"""Ridge CV from fold sums equals a direct fit; raw-sum standardisation equals scaling first."""

import numpy as np

from sway.operators import resample as RS


def _direct(X, y, alphas, k=5):
    n = len(y)
    sizes = np.full(k, n // k)
    sizes[: n % k] += 1
    bounds = np.cumsum(np.r_[0, sizes])
    scores = []
    for a in alphas:
        r2 = []
        for f in range(k):
            te = np.zeros(n, bool)
            te[bounds[f]:bounds[f + 1]] = True
            Xt, yt = X[~te], y[~te]
            mx, my = Xt.mean(0), yt.mean()
            beta = np.linalg.solve((Xt - mx).T @ (Xt - mx) + a * np.eye(X.shape[1]), (Xt - mx).T @ (yt - my))
            pred = my + (X[te] - mx) @ beta
            r2.append(1 - ((y[te] - pred) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum())
        scores.append(np.mean(r2))
    best = alphas[int(np.argmax(scores))]
    mx, my = X.mean(0), y.mean()
    return best, np.linalg.solve((X - mx).T @ (X - mx) + best * np.eye(X.shape[1]), (X - mx).T @ (y - my))


def _rows(X, y, feats, k=5):
    n = len(y)
    sizes = np.full(k, n // k)
    sizes[: n % k] += 1
    bounds = np.cumsum(np.r_[0, sizes])
    rows = []
    for f in range(k):
        Xf, yf = X[bounds[f]:bounds[f + 1]], y[bounds[f]:bounds[f + 1]]
        rows.append((f, "n", len(yf)))
        rows += [(f, f"sx:{a}", Xf[:, i].sum()) for i, a in enumerate(feats)]
        rows += [(f, f"sxx:{a}:{feats[j]}", (Xf[:, i] * Xf[:, j]).sum())
                 for i, a in enumerate(feats) for j in range(i, len(feats))]
        rows += [(f, f"sxy:{a}", (Xf[:, i] * yf).sum()) for i, a in enumerate(feats)]
        rows += [(f, "sy", yf.sum()), (f, "syy", (yf * yf).sum())]
    return rows


def test_ridge_cv_matches_direct():
    rng = np.random.default_rng(0)
    X = rng.normal(size=(103, 4))
    y = X @ np.array([0.5, -0.2, 0.0, 0.1]) + rng.normal(scale=0.5, size=103)
    Z = (X - X.mean(0)) / X.std(0)
    feats = ["a", "b", "c", "d"]
    alphas = np.logspace(-4, 3, 80)
    best, beta = RS.ridge_cv_from_gram(_rows(Z, y, feats), feats, alphas)
    best2, beta2 = _direct(Z, y, alphas)
    assert best == best2
    assert np.allclose(beta, beta2, rtol=1e-8, atol=1e-10)


def test_raw_sums_standardised():
    rng = np.random.default_rng(1)
    X = rng.normal(loc=3, scale=2, size=(57, 3))
    y = rng.normal(size=57)
    feats = ["a", "b", "c"]
    raw = {}
    for f, t, v in _rows(X, y, feats):
        raw.setdefault(f, {})[t] = v
    z = RS._standardized(raw, feats)
    Z = (X - X.mean(0)) / X.std(0)
    exp = {}
    for f, t, v in _rows(Z, y, feats):
        exp.setdefault(f, {})[t] = v
    for f in exp:
        for t in exp[f]:
            assert np.isclose(z[f][t], exp[f][t], rtol=1e-9, atol=1e-9), (f, t)


def _hashed(n, seed):
    rng = np.random.default_rng(seed)
    X = rng.normal(loc=2, scale=[1, 3, 0.5], size=(n, 3))
    y = X @ np.array([0.5, -0.1, 0.0]) + rng.normal(scale=0.3, size=n)
    keys = sorted(f"{int(k):016x}" for k in rng.integers(0, 1 << 62, n))
    return X, y, keys


def test_bucket_draws_add_up():
    """Every draw of a resample falls into one bucket, and buckets are hit in proportion to their items."""
    sizes = np.array([5, 0, 900, 20, 75, 0, 0, 1000], np.int64)
    draws = np.full(4000, 700)
    got = np.stack([RS.bucket_draws(sizes, i, draws, 42) for i in range(len(sizes))])
    assert (got.sum(axis=0) == 700).all() and (got[[1, 5, 6]] == 0).all()
    assert np.allclose(got.mean(axis=1), 700 * sizes / 2000, atol=0.8)
    counts = RS.item_counts(sizes, 4, draws, 42)
    assert (counts.sum(axis=1) == got[4]).all() and np.allclose(counts.mean(axis=0), 0.35, atol=0.05)


def test_ridge_bootstrap_equals_fits_on_explicit_resamples(spark):
    n, k, n_boot, salt = 3000, 5, 6, 7
    X, y, keys = _hashed(n, 3)
    feats = ["a", "b", "c"]
    df = spark.createDataFrame([(h, float(t), *map(float, x)) for h, t, x in zip(keys, y, X)], "h string, y double, a double, b double, c double")
    alphas = np.logspace(-4, 3, 20)
    got = RS.ridge_bootstrap(df.repartition(7), feats, "y", "h", n_boot, k, salt, alphas).toPandas().set_index("feature")

    buckets = np.array([int(h[0], 16) for h in keys])  # one digit: 3000 / 2048 is nearer to 16 than to 1
    sizes = np.bincount(buckets, minlength=16)
    draws = np.tile(RS.fold_sizes(n, k), n_boot)
    counts = np.concatenate([RS.item_counts(sizes, b, draws, salt) for b in range(16)], axis=1)  # items in hash order
    assert (counts.sum(axis=1) == draws).all()
    betas = []
    for b in range(n_boot):
        rows = np.concatenate([np.repeat(np.arange(n), counts[b * k + f]) for f in range(k)])  # fold after fold
        Z = (X[rows] - X[rows].mean(0)) / X[rows].std(0)
        betas.append(_direct(Z, y[rows], alphas, k)[1])
    betas = np.array(betas)
    for i, f in enumerate(feats):
        assert np.isclose(got.loc[f, "coef_median"], np.median(betas[:, i]), rtol=1e-8)
        assert np.isclose(got.loc[f, "coef_ci_lower"], np.percentile(betas[:, i], 2.5), rtol=1e-8, atol=1e-12)


def test_ridge_bootstrap_plan_has_no_replicate_rows(spark):
    X, y, keys = _hashed(50, 4)
    df = spark.createDataFrame([(h, float(t), *map(float, x)) for h, t, x in zip(keys, y, X)], "h string, y double, a double, b double, c double")
    plan = RS.weighted_gram(df, ["a", "b", "c"], "y", "h", 250, 5, 1)._jdf.queryExecution().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_draws_are_dealt_to_tasks_however_small_the_items_are(spark):
    X, y, keys = _hashed(3000, 4)
    df = spark.createDataFrame([(h, float(t), *map(float, x)) for h, t, x in zip(keys, y, X)], "h string, y double, a double, b double, c double")
    sums = RS.weighted_gram(df, ["a", "b", "c"], "y", "h", 2, 5, 1).toPandas()
    assert sums["part"].nunique() == 4  # a task for each bucket that holds items
    out = RS.ridge_bootstrap(df, ["a", "b", "c"], "y", "h", 4, 5, 1, np.logspace(-1, 1, 3))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 2
