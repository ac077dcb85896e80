"""Resampling and regression on aggregated tables (bootstrap, BH, ridge via Gram sums).

Bootstraps of group means draw in Spark: every (group, replicate, slot) row of
a report (its groups are issues, a bounded number) gets an item index from a keyed MD5 of its
coordinates (reproducible and engine-independent, unlike ``rand()``).  The ridge
bootstrap over evidence items never makes its draws as rows: tasks count the draws of
their own items by keyed splits and add weighted sums.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sway.functions import splits
from sway.operators.ranks import numbered


def draw_index(seed: str, key_cols: list[str], b: str, i: str, n: str):
    h = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in key_cols],
                          F.col(b).cast("string"), F.col(i).cast("string")))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.col(n))


def bootstrap_mean_ci(values: DataFrame, keys: list[str], value: str, order_col: str, n_boot: int = 2000,
                      ci: float = 0.95, seed: str = "42") -> DataFrame:
    """Percentile bootstrap interval of a group mean (n = 1 gives a zero-width interval)."""
    v = values.filter(F.col(value).isNotNull() & ~F.isnan(value))
    items = v.withColumn("idx", F.row_number().over(W.partitionBy(*keys).orderBy(order_col)) - 1)
    groups = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    draws = (groups.select(*keys, "n", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("b"))
             .select(*keys, "n", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")))
    draws = draws.withColumn("idx", draw_index(seed, keys, "b", "i", "n"))
    reps = (draws.join(items.select(*keys, "idx", F.col(value).alias("x")), [*keys, "idx"])
            .groupBy(*keys, "b").agg(F.avg("x").alias("m")))
    a = (1 - ci) / 2
    bounds = reps.groupBy(*keys).agg(F.percentile("m", a).alias("lo"), F.percentile("m", 1 - a).alias("hi"))
    out = groups.join(bounds, keys, "left")
    one = F.col("n") == 1
    return out.select(*keys, "n", "mean", F.when(one, F.col("mean")).otherwise(F.col("lo")).alias("ci_low"),
                      F.when(one, F.col("mean")).otherwise(F.col("hi")).alias("ci_high"))


def bh_adjust(df: DataFrame, p: str, order_cols: list[str]) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values (reverse running minimum, clipped to [0, 1]).

    Applied to a results table with one row per test (a bounded table), so the
    single ordered window is small."""
    d = df.filter(F.col(p).isNotNull())
    n = d.select(F.count(F.lit(1))).scalar()
    ranked = d.withColumn("_rank", F.row_number().over(W.orderBy(F.col(p), *order_cols)))
    adj = F.col(p) * n / F.col("_rank")
    rev = W.orderBy(F.col("_rank").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.min(adj).over(rev))))
            .drop("_rank"))


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Scale columns by the population mean and sd of the whole table.

    All moments come from one aggregate row, read as a scalar subquery."""
    moments = df.select(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols])).scalar()
    out = [F.coalesce(F.try_divide(F.col(c) - moments[c]["m"], moments[c]["s"]), F.lit(0.0)).alias(c) for c in cols]
    return df.select(*[x for x in df.columns if x not in cols], *out)


def kfold_index(df: DataFrame, order_col: str, k: int = 5) -> DataFrame:
    """Contiguous, unshuffled k-fold split over rows ordered by ``order_col``, a hex hash (first
    n % k folds one larger)."""
    n = df.select(F.count(F.lit(1))).scalar()
    d = numbered(df, [], order_col, "_pos").withColumn("_n", n)
    q, r = F.floor(F.col("_n") / k), F.col("_n") % k
    big = r * (q + 1)
    fold = F.when(F.col("_pos") < big, F.floor(F.col("_pos") / (q + 1))).otherwise(
        r + F.floor((F.col("_pos") - big) / q))
    return d.withColumn("fold", fold.cast("int")).drop("_pos", "_n")


def gram_terms(features: list[str], target: str) -> list[tuple[str, object]]:
    terms = [("n", F.count(F.lit(1)))]
    terms += [(f"sx:{a}", F.sum(a)) for a in features]
    terms += [(f"sxx:{a}:{b}", F.sum(F.col(a) * F.col(b))) for i, a in enumerate(features) for b in features[i:]]
    terms += [(f"sxy:{a}", F.sum(F.col(a) * F.col(target))) for a in features]
    terms += [("sy", F.sum(target)), ("syy", F.sum(F.col(target) * F.col(target)))]
    return terms


def fold_gram(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Per fold, every sufficient statistic of a linear model in one aggregate, long format."""
    terms = gram_terms(features, target)
    g = df.groupBy("fold").agg(*[e.cast("double").alias(f"t{k}") for k, (_, e) in enumerate(terms)])
    stack = ", ".join(f"'{name}', t{k}" for k, (name, _) in enumerate(terms))
    return g.selectExpr("fold", f"stack({len(terms)}, {stack}) AS (term, value)")


def _stats(rows: dict, features: list[str]):
    p = len(features)
    n = rows["n"]
    sx = np.array([rows[f"sx:{a}"] for a in features])
    sxx = np.zeros((p, p))
    for i, a in enumerate(features):
        for j in range(i, p):
            sxx[i, j] = sxx[j, i] = rows[f"sxx:{a}:{features[j]}"]
    sxy = np.array([rows[f"sxy:{a}"] for a in features])
    return n, sx, sxx, sxy, rows["sy"], rows["syy"]


def ridge_cv_from_gram(gram_rows: list[tuple[int, str, float]], features: list[str], alphas: np.ndarray):
    """Select alpha by mean held-out R^2 over folds and refit on all rows (with intercept).

    Works on the (fold, term, value) table only: a few hundred numbers."""
    folds: dict[int, dict] = {}
    for f, t, v in gram_rows:
        folds.setdefault(int(f), {})[t] = float(v)
    st = {f: _stats(r, features) for f, r in folds.items()}
    tot = [sum(s[i] for s in st.values()) for i in range(6)]

    def fit(s, alpha):
        n, sx, sxx, sxy, sy, _ = s
        mx, my = sx / n, sy / n
        cxx = sxx - n * np.outer(mx, mx)
        cxy = sxy - n * mx * my
        beta = np.linalg.solve(cxx + alpha * np.eye(len(features)), cxy)
        return beta, my - mx @ beta

    scores = []
    for alpha in alphas:
        r2 = []
        for f, s in st.items():
            train = [tot[i] - s[i] for i in range(6)]
            beta, b0 = fit(train, alpha)
            n, sx, sxx, sxy, sy, syy = s
            # residual sum of squares of y - b0 - x beta on the held-out fold
            sse = (syy - 2 * b0 * sy - 2 * beta @ sxy + n * b0 * b0 + 2 * b0 * beta @ sx + beta @ sxx @ beta)
            sst = syy - sy * sy / n
            r2.append(1 - sse / sst if sst > 0 else np.nan)
        scores.append(np.nanmean(r2))
    best = float(alphas[int(np.nanargmax(scores))])
    beta, _ = fit(tot, best)
    return best, beta


def _standardized(folds: dict, features: list[str]) -> dict:
    """Turn raw per-fold sums into sums of features standardised by the whole sample
    (population sd; a constant feature keeps scale 1, as a standard scaler does)."""
    p = len(features)
    st = {f: _stats(r, features) for f, r in folds.items()}
    n = sum(s[0] for s in st.values())
    sx = sum(s[1] for s in st.values())
    sxx = sum(s[2] for s in st.values())
    mu = sx / n
    sd = np.sqrt(np.maximum(np.diag(sxx) / n - mu * mu, 0.0))
    sd = np.where(sd > 0, sd, 1.0)
    out = {}
    for f, (nf, fx, fxx, fxy, fy, fyy) in st.items():
        zx = (fx - nf * mu) / sd
        zxx = (fxx - np.outer(mu, fx) - np.outer(fx, mu) + nf * np.outer(mu, mu)) / np.outer(sd, sd)
        zxy = (fxy - mu * fy) / sd
        rows = {"n": nf, "sy": fy, "syy": fyy}
        for i, a in enumerate(features):
            rows[f"sx:{a}"] = zx[i]
            rows[f"sxy:{a}"] = zxy[i]
            for j in range(i, p):
                rows[f"sxx:{a}:{features[j]}"] = zxx[i, j]
        out[f] = rows
    return out


def _term_matrix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The summands of ``gram_terms`` of every item, a row per item."""
    p = x.shape[1]
    crosses = [x[:, i] * x[:, j] for i in range(p) for j in range(i, p)]
    return np.column_stack([np.ones(len(x)), *x.T, *crosses, *(x * y[:, None]).T, y, y * y])


def fold_sizes(n: int, k: int) -> np.ndarray:
    """Draws of each fold (the first n % k folds have one more)."""
    return np.array([n // k + (f < n % k) for f in range(k)], np.int64)


def bucket_draws(sizes: np.ndarray, bucket: int, draws: np.ndarray, salt: int) -> np.ndarray:
    """Of each resample's ``draws``, those that fall into one bucket of items, by splits down the tree of buckets.

    Each split is keyed by (salt, resample, node), so tasks that hold different buckets agree without talking."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    low, high, node, left = 0, len(sizes), 1, draws.copy()
    resample = np.arange(len(draws))
    while high - low > 1:
        middle = (low + high) // 2
        part, whole = upto[middle] - upto[low], upto[high] - upto[low]
        if part in (0, whole):
            goes = left if part else np.zeros_like(left)
        else:
            goes = splits.binomial(splits.uniform(salt, resample, node), left, part / whole)
        if bucket < middle:
            left, high, node = goes, middle, 2 * node
        else:
            left, low, node = left - goes, middle, 2 * node + 1
    return left


def item_counts(sizes: np.ndarray, bucket: int, draws: np.ndarray, salt: int) -> np.ndarray:
    """How often each resample draws each item of a bucket (resamples x items)."""
    items, counts = int(sizes[bucket]), bucket_draws(sizes, bucket, draws, salt)
    resample = np.repeat(np.arange(len(counts)), counts)
    slot = np.arange(len(resample)) - np.repeat(np.cumsum(counts) - counts, counts)
    picked = np.floor(splits.uniform((salt * 31 + bucket + 1) % splits.PRIME, resample, slot) * items).astype(np.int64)
    return np.bincount(resample * items + picked, minlength=len(counts) * items).reshape(len(counts), items)


#: Items of a bucket on average, and resamples x items counted at a time.
BUCKET_ITEMS, COUNTED = 2048, 1 << 22
#: Tasks for each core; named, as tasks put together by their bytes would leave most cores idle in work that is all computing.
TASKS_A_CORE = 4


def weighted_gram(items: DataFrame, features: list[str], target: str, order_col: str, n_boot: int, k: int, seed: int) -> DataFrame:
    """(part, b, fold, sums): the Gram sums of every replicate and fold, weighted by how often it draws each item.

    One scan: items lie in buckets by the prefix of their hash (at most 16^4 of them; their sizes go to every task), each
    task works out how many draws of every resample fall into its buckets, deals them to the items and adds the
    weighted sums, so no item is exploded or joined.  A fold of a replicate is a resample of its own."""
    spark = items.sparkSession
    n = items.count()
    digits = min(4, max(1, round(math.log(max(n / BUCKET_ITEMS, 1), 16))))
    bucketed = items.withColumn("_bucket", F.conv(F.substring(order_col, 1, digits), 16, 10).cast("int"))
    sizes = np.zeros(16 ** digits, np.int64)
    for r in bucketed.groupBy("_bucket").count().collect():
        sizes[r["_bucket"]] = r["count"]
    draws = np.tile(fold_sizes(n, k), n_boot)
    shared = spark.sparkContext.broadcast(sizes)
    columns = ["_bucket", target, *features]

    def run(batches):
        total, first, held = 0.0, None, []

        def add(bucket, rows):
            xy = np.concatenate(rows)
            terms = _term_matrix(xy[:, 1:], xy[:, 0])
            counts = item_counts(shared.value, bucket, draws, seed)
            step = max(1, COUNTED // max(1, len(xy)))
            return np.concatenate([counts[i:i + step].astype(float) @ terms for i in range(0, len(counts), step)])

        at = None
        for batch in batches:
            frame = batch.to_pandas()
            values = frame[columns[1:]].to_numpy(float)
            for bucket in frame["_bucket"].unique():  # in order: the partition is sorted
                if at is not None and bucket != at:
                    total, held = total + add(at, held), []
                at = int(bucket)
                first = at if first is None else first
                held.append(values[(frame["_bucket"] == bucket).to_numpy()])
        if at is not None:
            total = total + add(at, held)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(total), first, np.int32)), pa.array(np.arange(len(total), dtype=np.int64) // k + 1),
                pa.array((np.arange(len(total)) % k).astype(np.int32)), pa.array(list(total), pa.list_(pa.float64()))], names=["part", "b", "fold", "sums"])

    tasks = min(16 ** digits, TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    dealt = bucketed.select(*columns, order_col).repartitionById(tasks, F.col("_bucket") % tasks).sortWithinPartitions("_bucket", order_col).select(*columns)
    return dealt.mapInArrow(run, "part int, b long, fold int, sums array<double>")


def ridge_bootstrap(items: DataFrame, features: list[str], target: str, order_col: str, n_boot: int = 250,
                    k: int = 5, seed: int = 42, alphas=None) -> DataFrame:
    """Coefficient stability: rows resampled with replacement per replicate, each replicate
    standardised on its own sample and fit with k-fold ridge CV.  ``order_col`` is a hex hash of the
    item.  The replicate x fold sums come from one scan (``weighted_gram``); each replicate's small solve runs in
    ``applyInPandas``."""
    alphas = np.logspace(-4, 3, 80) if alphas is None else alphas
    names = [name for name, _ in gram_terms(features, target)]
    sums = weighted_gram(items, features, target, order_col, n_boot, k, seed)

    def solve(pdf):
        folds: dict = {}
        for f, values in pdf.sort_values(["fold", "part"])[["fold", "sums"]].itertuples(index=False):
            folds[f] = folds.get(f, 0.0) + np.asarray(values)
        z = _standardized({f: dict(zip(names, v)) for f, v in folds.items()}, features)
        rows = [(f, t, v) for f, d in z.items() for t, v in d.items()]
        _, beta = ridge_cv_from_gram(rows, features, alphas)
        return pd.DataFrame({"b": int(pdf["b"].iloc[0]), "feature": features, "coef": beta})

    tasks = min(n_boot, TASKS_A_CORE * items.sparkSession.sparkContext.defaultParallelism)
    coefs = sums.repartition(tasks, "b").groupBy("b").applyInPandas(solve, "b long, feature string, coef double")
    return coefs.groupBy("feature").agg(
        F.median("coef").alias("coef_median"), F.percentile("coef", 0.025).alias("coef_ci_lower"),
        F.percentile("coef", 0.975).alias("coef_ci_upper"),
        F.avg((F.col("coef") > 0).cast("double")).alias("coef_positive_rate"),
        F.avg((F.col("coef") < 0).cast("double")).alias("coef_negative_rate"))


def bootstrap_weighted_mean_ci(values: DataFrame, keys: list[str], value: str, weight: str, order_col: str,
                               n_boot: int = 1200, ci: float = 0.95, seed: str = "42") -> DataFrame:
    """Weighted mean per group with a percentile bootstrap over items (items resampled with
    replacement; each replicate's weighted mean); n = 1 gives a zero-width interval."""
    v = values.filter(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(weight) > 0))
    items = v.withColumn("idx", F.row_number().over(W.partitionBy(*keys).orderBy(order_col)) - 1)
    groups = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                      (F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("mean"))
    draws = (groups.select(*keys, "n", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("b"))
             .select(*keys, "n", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")))
    draws = draws.withColumn("idx", draw_index(seed, keys, "b", "i", "n"))
    reps = (draws.join(items.select(*keys, "idx", F.col(value).alias("x"), F.col(weight).alias("w")), [*keys, "idx"])
            .groupBy(*keys, "b").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m")))
    a = (1 - ci) / 2
    bounds = reps.groupBy(*keys).agg(F.percentile("m", a).alias("lo"), F.percentile("m", 1 - a).alias("hi"))
    out = groups.join(bounds, keys, "left")
    one = F.col("n") == 1
    return out.select(*keys, "n", "mean", F.when(one, F.col("mean")).otherwise(F.col("lo")).alias("issue_ci_low"),
                      F.when(one, F.col("mean")).otherwise(F.col("hi")).alias("issue_ci_high"))
