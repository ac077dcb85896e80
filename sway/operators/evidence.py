"""Per-argument (evidence item) effects and what distinguishes effective arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sway.functions.stats import pearson
from sway.operators.ranks import average_rank
from sway.session import materialize

MIN_MODELS = 3
#: Ids without an item that are sent to every task; more of them are joined by a shuffle.
BROADCAST_IDS = 100_000


def evidence_effect(trials: DataFrame, evidence: DataFrame) -> DataFrame:
    """Count-weighted mean pro-proportion shift per (model, evidence item).

    ``trials``: (model, issue, question, evidence_ids, issue_stance); a trial counts once for each
    of its evidence items, a trial without any is baseline.  ``evidence``: (evidence_id,
    evidence_hash).  The baseline proportion is over the trials a question really has.  A NULL
    shift (no baseline for the question) stays in the weight denominator, as in the study.

    The effect is linear in the trials: the sum of (pro - baseline proportion) over the item's trials that have a baseline,
    over all its trials.  So the baseline is found first, and trials are added up per (model, id) inside their map tasks;
    what is shuffled grows with models x items, not with their questions.  Proportions are added as decimals, so no sum
    depends on its order.
    """
    cell = ["model", "issue", "question"]
    t = trials.select(*cell, (F.coalesce(F.col("issue_stance") == "pro", F.lit(False))).cast("long").alias("pro"), F.explode_outer("evidence_ids").alias("evidence_id"))
    evidence = materialize(evidence.select("evidence_id", "evidence_hash"))
    none = F.col("evidence_id").isNull()
    # the trials without evidence per question, and the ids seen in the others, in one scan
    seen = materialize(t.groupBy(F.when(none, F.struct(*cell)).alias("cell"), "evidence_id").agg(F.sum("pro").alias("pro_n"), F.count(F.lit(1)).alias("n")))
    base = seen.filter(none).select("cell.*", "pro_n", "n")
    # ids without an item or of items without a text are baseline too
    blank = materialize(seen.filter(~none).select("evidence_id").join(evidence, "evidence_id", "left")
                        .filter(F.col("evidence_hash").isNull()).groupBy("evidence_id").agg(F.count(F.lit(1)).alias("copies")))
    blanks = blank.count()
    if blanks:
        found = t.filter(~none).join(F.broadcast(blank) if blanks <= BROADCAST_IDS else blank, "evidence_id")
        base = base.unionByName(found.groupBy(*cell).agg(F.sum(F.col("pro") * F.col("copies")).alias("pro_n"), F.sum("copies").alias("n")))
    # one row per (model, issue, question)
    base = materialize(base.groupBy(*cell).agg(F.sum("pro_n").alias("pro_n"), F.sum("n").alias("n")).select(
        *cell, (F.col("pro_n") / F.col("n")).cast("decimal(20,18)").alias("proportion")))
    d = t.filter(~none).join(F.broadcast(base), cell, "left").groupBy("model", "evidence_id").agg(
        F.sum(F.when(F.col("proportion").isNotNull(), F.col("pro"))).alias("pro_n"), F.sum("proportion").alias("expected"), F.count(F.lit(1)).alias("n"))
    d = d.join(evidence.filter(F.col("evidence_hash").isNotNull()), "evidence_id")
    # rounded to 12 decimals: a mathematically zero shift must not get a sign from float noise
    return d.groupBy("model", "evidence_hash").agg(
        F.round((F.sum("pro_n") - F.sum("expected").cast("double")) / F.sum("n"), 12).alias("average_proportion_shift"),
        F.sum("n").alias("n_trials"))


def evidence_summary(effects: DataFrame) -> DataFrame:
    """Cross-model effectiveness per item: n, median/mean shift, median/mean |shift|,
    sign agreement and between-model sd."""
    s = F.col("average_proportion_shift")
    valid = F.count(s)
    sign = F.greatest(F.count_if(s > 0), F.count_if(s < 0)) / valid
    return effects.groupBy("evidence_hash").agg(
        F.count(s).alias("n_models"), F.median(s).alias("median_shift"), F.avg(s).alias("mean_shift"),
        F.median(F.abs(s)).alias("median_abs_shift"), F.avg(F.abs(s)).alias("mean_abs_shift"),
        F.when(valid > 0, sign).alias("sign_agreement_rate"),
        # rounded so that equal spreads tie exactly at the median cut-off
        F.round(F.stddev_samp(s), 12).alias("between_model_std"))


def pattern_labels(summary: DataFrame, min_models: int = MIN_MODELS) -> DataFrame:
    """Items seen by >= ``min_models`` models, labelled by sign agreement and spread.

    The spread cut-off is the median between-model sd of those items, taken
    as a scalar subquery."""
    a = summary.filter(F.col("n_models") >= min_models)
    cut = a.select(F.median("between_model_std")).scalar()
    sd, agree = F.col("between_model_std"), F.col("sign_agreement_rate")
    label = (F.when(sd.isNull(), "insufficient-variance-info")
             .when((agree >= 0.9) & (sd <= cut), "consensus-effective")
             .when((agree < 0.9) & (sd > cut), "polarizing-effective")
             .when(agree >= 0.9, "agreement-with-variable-strength")
             .otherwise("mixed-direction-moderate-variance"))
    return a.withColumn("evidence_effect_pattern", label)


def spearman_by_feature(long: DataFrame, target: str) -> DataFrame:
    """Spearman rho of each feature with ``target``: Pearson correlation of average ranks.

    ``long``: (feature, value, <target>) - one row per item and feature."""
    # medians of values of 12 decimals have a 13th, so ties are taken at 10
    r = average_rank(long, ["feature"], "value", "rv", digits=10)
    r = average_rank(r, ["feature"], target, "rt", digits=10)
    return r.groupBy("feature").agg(pearson(F.col("rv"), F.col("rt")).alias("spearman_rho"), F.count(F.lit(1)).alias("n"))
