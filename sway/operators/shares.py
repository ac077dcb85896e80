"""Stance counts and shares (long format; pivot only at the edge)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sway.sources.fixtures import STANCES


def known_issues(trials: DataFrame) -> DataFrame:
    """Drop trials whose question did not map to a topic."""
    return trials.filter(F.col("issue") != "unknown")


def stance_counts(trials: DataFrame) -> DataFrame:
    """(issue, issue_stance, count, ecase, model), the per-model result table.

    Map-side partial aggregation collapses the fact table to the key domain
    before the shuffle, so a hot model or issue costs nothing extra.
    """
    return (known_issues(trials)
            .groupBy("issue", "issue_stance", "ecase", "model")
            .agg(F.count(F.lit(1)).alias("count"))
            .select("issue", "issue_stance", "count", "ecase", "model"))


def _stance_cols(stance_col: str = "issue_stance", weight: str | None = None):
    s = F.col(stance_col)
    if weight is None:
        return [F.count_if(s == "pro").alias("pro"), F.count_if(s == "con").alias("con"),
                F.count_if(~s.isin("pro", "con")).alias("other")]
    w = F.col(weight)
    return [F.coalesce(F.sum(F.when(s == "pro", w)), F.lit(0)).alias("pro"),
            F.coalesce(F.sum(F.when(s == "con", w)), F.lit(0)).alias("con"),
            F.coalesce(F.sum(F.when(~s.isin("pro", "con"), w)), F.lit(0)).alias("other")]


def trial_shares(trials: DataFrame, weight: str | None = None) -> DataFrame:
    """Per (model, ecase, issue, trial_num): counts of each stance, total and shares.
    ``weight`` names a count column when the rows are already pre-aggregated."""
    g = (known_issues(trials)
         .groupBy("model", "ecase", "issue", "trial_num")
         .agg(*_stance_cols(weight=weight)))
    total = F.col("pro") + F.col("con") + F.col("other")
    return g.select("model", "ecase", "issue", "trial_num", "pro", "con", "other",
                    total.alias("total"),
                    (F.col("pro") / total).alias("pro_share"),
                    (F.col("con") / total).alias("con_share"))


def share_pivot(trials: DataFrame) -> DataFrame:
    """Long -> wide on stance with zero fill and guaranteed columns (con, other, pro)."""
    t = known_issues(trials)
    wide = (t.groupBy("model", "ecase", "issue").pivot("issue_stance", list(STANCES))
            .agg(F.count(F.lit(1))).fillna(0, subset=list(STANCES)))
    total = F.col("con") + F.col("other") + F.col("pro")
    return wide.select("model", "ecase", "issue", "con", "other", "pro", total.alias("total"),
                       *[(F.col(s) / total).alias(f"{s}_share") for s in STANCES])


def stance_share_grid(counts: DataFrame, fill_models: bool = True) -> DataFrame:
    """Share per (issue, ecase, issue_stance, model) from stance counts.

    ``fill_models=True`` is the study's zero-filled pivot: rows are the
    observed (issue, ecase, issue_stance) keys, columns every model, a
    missing cell counts 0 and a 0/0 share is 0.  ``fill_models=False`` keeps
    the grid inside observed (model, issue, ecase) cells with all three
    stances, so a model that never ran an issue has no rows (NULL at the
    edge).  Both pivot the already-aggregated counts, whose size is bounded
    by the study design (models x issues x cases x stances), then unpivot.
    """
    c = counts.groupBy("issue", "ecase", "issue_stance", "model").agg(F.sum("count").alias("n"))
    if fill_models:
        wide = c.groupBy("issue", "ecase", "issue_stance").pivot("model").agg(F.first("n"))
        models = [m for m in wide.columns if m not in ("issue", "ecase", "issue_stance")]
        g = wide.fillna(0, subset=models).unpivot(
            ["issue", "ecase", "issue_stance"], models, "model", "n")
    else:
        wide = (c.groupBy("model", "issue", "ecase").pivot("issue_stance", list(STANCES))
                .agg(F.first("n")).fillna(0, subset=list(STANCES)))
        g = wide.unpivot(["model", "issue", "ecase"], list(STANCES), "issue_stance", "n")
    tot = F.sum("n").over(W.partitionBy("issue", "ecase", "model"))
    return g.select("issue", "ecase", "issue_stance", "model", F.col("n").cast("bigint").alias("n"),
                    F.coalesce(F.try_divide(F.col("n").cast("double"), tot), F.lit(0.0)).alias("share"))


def case_stack(counts: DataFrame) -> DataFrame:
    """Neither/pro/con/all sums per (issue, stance), stacked with the case tag."""
    return (counts.filter(F.col("ecase").isin("neither", "pro", "con", "all"))
            .groupBy("issue", "issue_stance", "ecase").agg(F.sum("count").alias("count")))
