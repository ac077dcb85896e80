"""Paired pro-share shift against the no-evidence baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sway.functions.stats import paired_t_p, t_margin


def paired_diffs(shares: DataFrame, baseline: str = "neither") -> DataFrame:
    """Evidence case vs baseline trials of the same (model, issue, trial_num).

    The baseline share is attached with a window over the (at most six) case rows of
    each trial cell rather than a self-join, so the aggregate is computed from one scan
    (a self-join would push different case filters below the aggregation and read the
    fact table twice)."""
    w = Window.partitionBy("model", "issue", "trial_num")
    j = shares.withColumn("pro_share_neither",
                          F.max(F.when(F.col("ecase") == baseline, F.col("pro_share"))).over(w))
    j = j.filter((F.col("ecase") != baseline) & F.col("pro_share_neither").isNotNull())
    return j.withColumn("pro_shift", F.col("pro_share") - F.col("pro_share_neither"))


def paired_shift(shares: DataFrame, baseline: str = "neither") -> DataFrame:
    """Mean, sample sd and n of the paired shift per (model, ecase)."""
    d = paired_diffs(shares, baseline)
    return d.groupBy("model", "ecase").agg(
        F.avg("pro_shift").alias("mean_pro_shift"),
        F.stddev_samp("pro_shift").alias("sd_shift"),
        F.count(F.lit(1)).alias("n_trials"))


def shift_statistics(shares: DataFrame, baseline: str = "neither") -> DataFrame:
    """Shift table: mean, paired-t p, 95 % t interval and n per (model, ecase)."""
    s = paired_shift(shares, baseline)
    m, sd, n = F.col("mean_pro_shift"), F.col("sd_shift"), F.col("n_trials")
    margin = F.coalesce(t_margin(sd, n), F.lit(0.0))
    return s.select("model", "ecase", "mean_pro_shift",
                    paired_t_p(m, sd, n).alias("p_value"),
                    (m - margin).alias("ci_lower"), (m + margin).alias("ci_upper"), "n_trials")
