"""Composition sensitivity: does the answer depend on which arguments are shown?

Pairwise statistics over compositions use closed forms instead of emitting
all pairs: flips = 1 - sum_l C(n_l, 2) / C(n, 2), max |dp| = max - min, and
sum_{i<j} |p_i - p_j| from the value distribution (distinct p values per
group are bounded by the trials per composition, so the window that ranks
them never sees a hot group's rows, only its distinct values).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

GROUP = ["model", "topic", "ecase", "paraphrase_idx"]


def composition_levels(preds: DataFrame) -> DataFrame:
    """Per composition: stance rates and the majority label (> 0.5, pro checked first)."""
    s = F.col("issue_stance")
    g = preds.groupBy(*GROUP, "composition_id").agg(
        F.avg((s == "pro").cast("double")).alias("p_pro"),
        F.avg((s == "con").cast("double")).alias("p_con"),
        F.avg((s == "other").cast("double")).alias("p_other"))
    label = (F.when(F.col("p_pro") > 0.5, "pro").when(F.col("p_con") > 0.5, "con").otherwise("other"))
    return g.withColumn("composition_label", label)


def flip_rates(levels: DataFrame) -> DataFrame:
    """Per (model, topic, ecase, paraphrase_idx): pairwise flip rate, mean/max |dp_pro|,
    sample variance of p_pro; NULL statistics when fewer than two compositions."""
    base = levels.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n_compositions"),
        (F.max("p_pro") - F.min("p_pro")).alias("max_abs"),
        F.var_samp("p_pro").alias("var_p"))
    same = (levels.groupBy(*GROUP, "composition_label").agg(F.count(F.lit(1)).alias("nl"))
            .groupBy(*GROUP).agg(F.sum(F.col("nl") * (F.col("nl") - 1) / 2).alias("same_pairs")))
    vals = levels.groupBy(*GROUP, "p_pro").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(*GROUP).orderBy("p_pro")
    below = F.coalesce(F.sum("c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    above = F.coalesce(F.sum("c").over(w.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    absdiff = (vals.withColumn("t", F.col("c") * F.col("p_pro") * (below - above))
               .groupBy(*GROUP).agg(F.sum("t").alias("sum_abs")))
    j = base.join(same, GROUP).join(absdiff, GROUP)
    n = F.col("n_compositions")
    pairs = n * (n - 1) / 2
    ok = n >= 2
    return j.select(
        *GROUP, "n_compositions",
        F.when(ok, 1 - F.col("same_pairs") / pairs).alias("pairwise_flip_rate"),
        F.when(ok, F.col("sum_abs") / pairs).alias("mean_abs_pairwise_delta_p_pro"),
        F.when(ok, F.col("max_abs")).alias("max_abs_pairwise_delta_p_pro"),
        F.when(ok, F.col("var_p")).alias("p_pro_variance_across_compositions"))


def sensitivity_summary(rates: DataFrame) -> DataFrame:
    """Per (model, ecase): distinct topics and the means of the per-group statistics."""
    return rates.groupBy("model", "ecase").agg(
        F.countDistinct("topic").alias("topics"),
        F.avg("pairwise_flip_rate").alias("mean_pairwise_flip_rate"),
        F.avg("mean_abs_pairwise_delta_p_pro").alias("mean_abs_pairwise_delta_p_pro"),
        F.avg("max_abs_pairwise_delta_p_pro").alias("max_abs_pairwise_delta_p_pro"),
        F.avg("p_pro_variance_across_compositions").alias("mean_p_pro_variance")).orderBy(
        F.col("ecase").asc(), F.col("mean_pairwise_flip_rate").desc())
