"""Statistics over evidence items: feature associations, pattern tests, family gaps.

All inputs are item-level (one row per evidence item) or pair-level (one
row per model pair) tables.  A resampled median costs a row per replicate: its position
comes from keyed splits of the resample's counts, never from a table of replicates x items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window as W

from sway.functions.splits import position_of_rank
from sway.functions.stats import fisher_two_sided, mann_whitney_p, p_marker, t_two_sided_p
from sway.operators.ranks import counted_rank, values_at
from sway.session import materialize

# Model family prefixes of the study.
FAMILY_PREFIXES = ("llama", "grok", "gpt", "claude", "gemini")


def family_of(model: Column) -> Column:
    """Family by name prefix (NULL when none applies)."""
    out = F.lit(None).cast("string")
    for p in reversed(FAMILY_PREFIXES):
        out = F.when(model.startswith(p), F.lit(p)).otherwise(out)
    return out


def salted(sizes: DataFrame, seed: str, keys: list[str]) -> DataFrame:
    """Add a number of a group's own for the keyed draws."""
    text = F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys])
    return sizes.withColumn("salt", F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long"))


@F.pandas_udf(ArrayType(LongType()))
def middle_positions(n: pd.Series, salt: pd.Series, b: pd.Series) -> pd.Series:
    """Positions (from 0, of the sorted items) of both middle draws of replicate ``b``; those of the items for b = 0."""
    size = n.to_numpy(np.int64)
    ranks = [(size + 1) // 2, size // 2 + 1]
    drawn = [position_of_rank(size, r, salt.to_numpy(np.int64), b.to_numpy(np.int64)) for r in ranks]
    plain = b.to_numpy() == 0
    pair = np.stack([np.where(plain, r - 1, d) for r, d in zip(ranks, drawn)], axis=1)
    return pd.Series(list(pair))


def resampled_median_gap(values: DataFrame, keys: list[str], group: str, value: str, n_boot: int, seed: str = "42") -> DataFrame:
    """Bootstrap of median(group=True) - median(group=False) per ``keys``: each side is resampled with replacement
    to its own size; returns (keys, b, gap), with the gap of the values themselves at b = 0.

    A replicate's median needs the draws of the two middle ranks only, which hierarchical splitting finds without
    making the others (``functions.splits``): a row per replicate, whatever the number of items."""
    v = materialize(values.select(*keys, group, value))
    sizes = salted(v.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("n")), seed, keys + [group])
    draws = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_boot))).alias("b")).repartition(*keys, group, "b")
    draws = draws.withColumn("_at", middle_positions("n", "salt", "b")).select(*keys, group, "b", F.explode("_at").alias("_pos"))
    found = values_at(v, keys + [group], value, draws, "_pos", "_x")
    side = lambda flag: F.avg(F.when(flag, F.col("_x")))
    reps = found.groupBy(*keys, "b").agg(side(F.col(group)).alias("mt"), side(~F.col(group)).alias("mf"))
    return reps.select(*keys, "b", (F.col("mt") - F.col("mf")).alias("gap"))


def binary_feature_gaps(items: DataFrame, features: list[str], target: str, n_boot: int = 3000,
                        min_side: int = 5) -> DataFrame:
    """Per binary feature: n_true, n_false, median gap of ``target`` (true - false) and its
    bootstrap 95 % interval; NULL statistics when a side has fewer than ``min_side`` items."""
    stack = ", ".join(f"'{f}', CAST({f} AS BOOLEAN)" for f in features)
    long = items.selectExpr(target, f"stack({len(features)}, {stack}) AS (feature, flag)")
    long = long.filter(F.col(target).isNotNull() & F.col("flag").isNotNull())
    obs = materialize(long.groupBy("feature").agg(F.count_if(F.col("flag")).alias("n_true"), F.count_if(~F.col("flag")).alias("n_false")))
    ok = obs.filter((F.col("n_true") >= min_side) & (F.col("n_false") >= min_side)).select("feature")
    boot = resampled_median_gap(long.join(ok, "feature", "left_semi"), ["feature"], "flag", target, n_boot)
    resampled = F.when(F.col("b") > 0, F.col("gap"))
    ci = boot.groupBy("feature").agg(F.max(F.when(F.col("b") == 0, F.col("gap"))).alias("gap"),
                                     F.percentile(resampled, 0.025).alias("lo"), F.percentile(resampled, 0.975).alias("hi"))
    return obs.join(ci, "feature", "left").select(
        "feature", F.lit("binary").alias("feature_type"), "n_true", "n_false",
        F.col("gap").alias("effectiveness_gap_true_minus_false"),
        F.col("lo").alias("gap_ci_lower"), F.col("hi").alias("gap_ci_upper"))


def spearman_with_p(long: DataFrame, target: str) -> DataFrame:
    """Spearman rho per feature with the t-approximation p-value (n - 2 df)."""
    from sway.operators.evidence import spearman_by_feature
    s = spearman_by_feature(long, target)
    rho, n = F.col("spearman_rho"), F.col("n")
    t = rho * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - rho * rho))
    t = F.when(F.abs(rho) >= 1, F.lit(float("inf")) * F.signum(rho)).otherwise(t)
    return s.withColumn("spearman_p_value", F.when(n > 2, t_two_sided_p(t, (n - 2).cast("double"))))


def pattern_tests(items: DataFrame, binary: list[str], numeric: list[str]) -> DataFrame:
    """Each pattern against the rest: binary features -> proportions and Fisher exact p;
    numeric -> means, pooled-sd Cohen's d and Mann-Whitney U p (normal approximation with
    tie correction and continuity 0.5)."""
    feats = binary + numeric
    stack = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in feats)
    long = items.selectExpr("evidence_hash", "evidence_effect_pattern",
                            f"stack({len(feats)}, {stack}) AS (feature, value)").filter(F.col("value").isNotNull())
    # items of a pattern with equal values count as one row from here on
    counted = materialize(long.groupBy("feature", "evidence_effect_pattern", (F.round("value", 12) + F.lit(0.0)).alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")))
    ranked = counted_rank(counted, ["feature"], "v", "n", "rk")
    per = ranked.groupBy("feature", "evidence_effect_pattern").agg(
        F.sum("n").alias("n1"), F.sum("s").alias("s1"), F.sum("ss").alias("ss1"), F.sum(F.col("rk") * F.col("n")).alias("r1"),
        # t items of a value add t^3 - t, each pattern its part
        F.sum(F.col("n").cast("double") * (F.col("_c") * F.col("_c") - 1)).alias("tie1"))
    whole = W.partitionBy("feature")  # a row per pattern
    j = per.withColumns({name: F.sum(c).over(whole) for name, c in (("N", "n1"), ("S", "s1"), ("SS", "ss1"), ("tie", "tie1"))})
    n1, n2 = F.col("n1"), F.col("N") - F.col("n1")
    s2, ss2 = F.col("S") - F.col("s1"), F.col("SS") - F.col("ss1")
    m1, m2 = F.col("s1") / n1, F.try_divide(s2, n2.cast("double"))
    v1 = F.when(n1 > 1, (F.col("ss1") - n1 * m1 * m1) / (n1 - 1)).otherwise(0.0)
    v2 = F.when(n2 > 1, (ss2 - n2 * m2 * m2) / (n2 - 1)).otherwise(0.0)
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, (n1 + n2 - 2).cast("double")))
    is_bin = F.col("feature").isin(*binary)
    # Mann-Whitney: U1 from the rank sum; exact or normal p chosen as the study's test does
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    mw_p = mann_whitney_p(F.when(~is_bin, u1), n1.cast("double"), n2.cast("double"), F.col("tie").cast("double"))
    # 2x2 cells only exist for binary features (NULL elsewhere, so the UDF skips them)
    a, b = F.when(is_bin, F.col("s1")).cast("long"), F.when(is_bin, n1 - F.col("s1")).cast("long")
    c, d = F.when(is_bin, s2).cast("long"), F.when(is_bin, n2 - s2).cast("long")
    p = F.when(is_bin, fisher_two_sided(a, b, c, d)).otherwise(F.when((n1 > 0) & (n2 > 0), mw_p))
    out = j.select(
        F.col("evidence_effect_pattern").alias("pattern"), "feature",
        F.when(is_bin, "binary").otherwise("numeric").alias("feature_type"),
        m1.alias("mean_in"), m2.alias("mean_out"), (m1 - m2).alias("effect_size_diff"),
        F.when(is_bin, F.lit(None).cast("double")).otherwise(F.when(pooled > 0, (m1 - m2) / pooled))
         .alias("cohens_d"), p.alias("p_value"))
    return out.withColumn("sig", p_marker(F.col("p_value"), ns=""))


def family_pairs(pairs: DataFrame, families: DataFrame) -> DataFrame:
    """Attach same-family flags to model pairs (families: model -> family)."""
    fa = families.select(F.col("model").alias("model_a"), F.col("family").alias("fam_a"))
    fb = families.select(F.col("model").alias("model_b"), F.col("family").alias("fam_b"))
    p = pairs.join(fa, "model_a", "left").join(fb, "model_b", "left")
    return p.withColumn("same_family", F.coalesce(F.col("fam_a") == F.col("fam_b"), F.lit(False)))


def _long_metrics(pairs: DataFrame, metrics: list[str]) -> DataFrame:
    stack = ", ".join(f"'{m}', {m}" for m in metrics)
    return pairs.selectExpr("model_a", "model_b", "fam_a", "fam_b", "same_family",
                            f"stack({len(metrics)}, {stack}) AS (metric, value)").filter(F.col("value").isNotNull())


def family_gap(pairs: DataFrame, families: DataFrame, metrics: list[str], n_perm: int = 20000,
               n_boot: int = 5000, seed: str = "42") -> DataFrame:
    """Median same-family minus cross-family value per metric, with a label-permutation p
    (family labels shuffled over models, keyed MD5 order per permutation) and a pair
    bootstrap interval."""
    fp = family_pairs(pairs, families)
    long = _long_metrics(fp, metrics)
    obs = long.groupBy("metric").agg(
        F.median(F.when(F.col("same_family"), F.col("value"))).alias("median_same_family"),
        F.median(F.when(~F.col("same_family"), F.col("value"))).alias("median_cross_family"))
    obs = obs.withColumn("gap", F.col("median_same_family") - F.col("median_cross_family"))
    # permutations: the k-th model in hash order takes the family of the k-th model by name
    fam = families.withColumn("pos", F.row_number().over(W.orderBy("model")))
    perms = fam.select("model", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("perm"))
    perms = perms.withColumn("pos", F.row_number().over(
        W.partitionBy("perm").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("perm").cast("string"),
                                                         F.col("model"))), "model")))
    perms = perms.join(fam.select("pos", F.col("family").alias("pfam")), "pos").drop("pos")
    pa = perms.select("perm", F.col("model").alias("model_a"), F.col("pfam").alias("pa"))
    pb = perms.select("perm", F.col("model").alias("model_b"), F.col("pfam").alias("pb"))
    pl = long.select("model_a", "model_b", "metric", "value").join(pa, "model_a").join(pb, ["perm", "model_b"])
    same = F.coalesce(F.col("pa") == F.col("pb"), F.lit(False))
    pg = pl.groupBy("metric", "perm").agg(
        (F.median(F.when(same, F.col("value"))) - F.median(F.when(~same, F.col("value")))).alias("pgap"))
    pv = pg.join(obs.select("metric", "gap"), "metric").groupBy("metric").agg(
        F.avg(F.when(F.col("pgap").isNotNull(), (F.abs("pgap") >= F.abs("gap")).cast("double")))
        .alias("label_permutation_p_value"))
    boot = resampled_median_gap(long, ["metric"], "same_family", "value", n_boot, seed).filter("b > 0")
    ci = boot.groupBy("metric").agg(F.percentile("gap", 0.025).alias("pair_bootstrap_ci_lower"),
                                    F.percentile("gap", 0.975).alias("pair_bootstrap_ci_upper"))
    return (obs.join(pv, "metric", "left").join(ci, "metric", "left")
            .withColumnRenamed("gap", "median_gap_same_minus_cross"))


def leave_one_model_out(pairs: DataFrame, families: DataFrame, metrics: list[str]) -> DataFrame:
    """Family gap recomputed with each model's pairs removed (the model list is a scalar
    subquery expanded per pair)."""
    long = _long_metrics(family_pairs(pairs, families), metrics)
    models = families.select(F.sort_array(F.collect_set("model"))).scalar()
    d = long.select("*", F.explode(models).alias("dropped_model"))
    d = d.filter((F.col("dropped_model") != F.col("model_a")) & (F.col("dropped_model") != F.col("model_b")))
    return d.groupBy("dropped_model", "metric").agg(
        (F.median(F.when(F.col("same_family"), F.col("value")))
         - F.median(F.when(~F.col("same_family"), F.col("value")))).alias("median_gap_same_minus_cross"))
