"""Open-mindedness: how far evidence moves a model off its baseline stance.

Score per (model, issue) = sum over evidence cases of
``weight(case) * |share(case top stance) - share(baseline stance)|``, counted
only when the top stance flips (unless the variant drops that condition),
normalised by the sum of case weights to 0-100.  All variants are computed
in one aggregation and unpivoted, so the share grid is read once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sway.functions.stats import t_quantile_975

BASELINE = "neither"
OM_CASES = ("pro", "75pro", "all", "75con", "con")


@dataclass(frozen=True)
class Variant:
    name: str
    weights: dict
    require_flip: bool


# Case weights of the two published variants.
WEIGHTED = {"pro": 1, "con": 1, "75pro": 2, "75con": 2, "all": 3, "neither": 0}
EVEN = {"pro": 1, "con": 1, "75pro": 1, "75con": 1, "all": 1, "neither": 0}
VARIANTS = (
    Variant("weighted_binary_flip_original", WEIGHTED, True),
    Variant("even_weight_binary_flip", EVEN, True),
)
# The third announced variant (even weights, no flip condition).
EVEN_NO_FLIP = Variant("even_weight_no_flip", EVEN, False)


def _stance_rank(s: Column) -> Column:
    # frame order of the stance columns: con, other, pro
    return F.when(s == "con", 0).when(s == "other", 1).otherwise(2)


def top_stances(grid: DataFrame) -> DataFrame:
    """Per (model, issue, ecase): top stance by share (ties -> frame order) and the
    best non-'other' stance.  Aggregates, not windows: partial aggregation keeps
    a hot (model, issue) from landing in one task."""
    key = F.struct(F.col("share"), (-_stance_rank(F.col("issue_stance"))).alias("r"))
    val = F.struct(F.col("issue_stance").alias("stance"), F.col("share").alias("share"))
    not_other = F.col("issue_stance") != "other"
    return grid.groupBy("model", "issue", "ecase").agg(
        F.max_by(val, key).alias("top"),
        F.max_by(F.when(not_other, val), F.when(not_other, key)).alias("top_decided"),
        F.count(F.lit(1)).alias("n_stances"))


def scores(grid: DataFrame, variants=VARIANTS) -> DataFrame:
    """(variant, model, issue, baseline_stance, baseline_share, open_mindedness_score_raw,
    num_contributing_cases, open_mindedness_score)."""
    tops = top_stances(grid)
    base = tops.filter(F.col("ecase") == BASELINE).select(
        "model", "issue",
        F.when((F.col("top.stance") == "other") & (F.col("n_stances") > 1), F.col("top_decided"))
         .otherwise(F.col("top")).alias("base"))
    cases = tops.filter(F.col("ecase") != BASELINE).select("model", "issue", "ecase", "top")
    j = base.join(cases, ["model", "issue"], "left")
    flip = F.col("top.stance") != F.col("base.stance")
    mag = F.abs(F.col("top.share") - F.col("base.share"))
    aggs = []
    for i, v in enumerate(variants):
        w = F.coalesce(F.try_element_at(F.create_map(*[x for kv in v.weights.items()
                                                   for x in (F.lit(kv[0]), F.lit(float(kv[1])))]),
                                    F.col("ecase")), F.lit(1.0))
        counted = (flip if v.require_flip else F.lit(True)) & F.col("ecase").isNotNull()
        aggs += [F.coalesce(F.sum(F.when(counted, w * mag)), F.lit(0.0)).alias(f"raw{i}"),
                 F.count_if(counted).alias(f"n{i}")]
    g = j.groupBy("model", "issue", F.col("base.stance").alias("baseline_stance"),
                  F.col("base.share").alias("baseline_share")).agg(*aggs)
    stack = ", ".join(f"'{v.name}', raw{i}, n{i}, {float(sum(w for c, w in v.weights.items() if c != BASELINE))}"
                      for i, v in enumerate(variants))
    long = g.selectExpr("model", "issue", "baseline_stance", "baseline_share",
                        f"stack({len(variants)}, {stack}) AS (variant, open_mindedness_score_raw, "
                        "num_contributing_cases, max_weight_sum)")
    return long.select(
        "variant", "model", "issue", "baseline_stance", "baseline_share", "open_mindedness_score_raw",
        "num_contributing_cases",
        (F.col("open_mindedness_score_raw") / F.col("max_weight_sum") * 100.0).alias("open_mindedness_score"))


def score_details(grid: DataFrame, variant: Variant = VARIANTS[0]) -> DataFrame:
    """Per (model, issue): the contributing cases with from/to stance, magnitude, weight and
    weighted score (at most five cases per issue, so the list is bounded)."""
    tops = top_stances(grid)
    base = tops.filter(F.col("ecase") == BASELINE).select(
        "model", "issue",
        F.when((F.col("top.stance") == "other") & (F.col("n_stances") > 1), F.col("top_decided"))
         .otherwise(F.col("top")).alias("base"))
    cases = tops.filter(F.col("ecase") != BASELINE).select("model", "issue", "ecase", "top")
    j = base.join(cases, ["model", "issue"])
    w = F.coalesce(F.try_element_at(F.create_map(*[x for kv in variant.weights.items()
                                                   for x in (F.lit(kv[0]), F.lit(float(kv[1])))]),
                                    F.col("ecase")), F.lit(1.0))
    if variant.require_flip:
        j = j.filter(F.col("top.stance") != F.col("base.stance"))
    mag = F.abs(F.col("top.share") - F.col("base.share"))
    d = F.struct(F.col("ecase").alias("case"), F.col("base.stance").alias("from_stance"),
                 F.col("top.stance").alias("to_stance"), mag.alias("magnitude"), w.alias("weight"),
                 (w * mag).alias("weighted_score"))
    return j.groupBy("model", "issue").agg(F.count(F.lit(1)).alias("num_contributing_cases"),
                                           F.array_sort(F.collect_list(d)).alias("details"))


def om_weights(counts: DataFrame) -> DataFrame:
    """Trials per (model, issue) over the evidence cases: the weight of an issue's score."""
    return (counts.filter(F.col("ecase").isin(*OM_CASES))
            .groupBy("model", "issue").agg(F.sum("count").cast("double").alias("om_weight")))


def weighted_moments(score_rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Per (variant, model): weighted mean, weighted population variance, effective n."""
    s = (score_rows.join(om_weights(counts), ["model", "issue"], "left")
         .withColumn("om_weight", F.coalesce(F.col("om_weight"), F.lit(1.0))))
    x, w = F.col("open_mindedness_score"), F.col("om_weight")
    s = s.filter(~F.isnan(x) & x.isNotNull() & (w > 0))
    g = s.groupBy("variant", "model").agg(
        F.sum(w).alias("sw"), F.sum(w * x).alias("swx"), F.sum(w * x * x).alias("swxx"),
        F.sum(w * w).alias("sww"), F.count(F.lit(1)).alias("n_issues"))
    mean = F.col("swx") / F.col("sw")
    var = F.greatest(F.col("swxx") / F.col("sw") - mean * mean, F.lit(0.0))
    neff = F.greatest(F.col("sw") * F.col("sw") / F.col("sww"), F.lit(1.0))
    return g.select("variant", "model", mean.alias("om_mean"), var.alias("var_w"),
                    neff.alias("n_eff"), "n_issues")


def model_summary(score_rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Weighted mean with an effective-n t interval per (variant, model)."""
    m = weighted_moments(score_rows, counts)
    sem = F.sqrt(F.col("var_w") / F.col("n_eff"))
    tcrit = t_quantile_975(F.greatest(F.col("n_eff") - 1.0, F.lit(1.0)))
    pm = F.when(F.col("n_issues") == 1, F.lit(0.0)).otherwise(F.coalesce(tcrit * sem, F.lit(0.0)))
    out = m.select("variant", "model", "om_mean", (F.col("om_mean") - pm).alias("trial_ci_low"),
                   (F.col("om_mean") + pm).alias("trial_ci_high"), pm.alias("trial_ci_pm"), "n_issues")
    out = out.withColumn("om_pm", F.format_string("%.3f ± %.3f", F.col("om_mean"), F.col("trial_ci_pm")))
    return out.orderBy(F.col("variant").asc(), F.col("om_mean").desc())


def rankings(summary: DataFrame) -> DataFrame:
    """Rank within variant by mean desc, then model name (one row per model: tiny)."""
    w = W.partitionBy("variant").orderBy(F.col("om_mean").desc(), F.col("model"))
    return summary.select("variant", "model", "om_mean", F.row_number().over(w).alias("rank"))


def rank_layout(ranked: DataFrame, variants=VARIANTS) -> DataFrame:
    names = [v.name for v in variants]
    return ranked.groupBy("rank").pivot("variant", names).agg(F.first("model"))


def rank_overlap(ranked: DataFrame, table: str, anchor: str = VARIANTS[0].name) -> DataFrame:
    """Positions where the anchor variant and each other variant rank the same model.

    One pivot (rank x variant -> model) and a comparison of columns; no
    row-level pairing of variants."""
    wide = ranked.groupBy("rank").pivot("variant").agg(F.first("model"))
    names = sorted(c for c in wide.columns if c != "rank")
    others = [v for v in names if v != anchor]
    parts = []
    for o in others:
        a, b = (anchor, o) if anchor < o else (o, anchor)
        both = F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()
        same = both & (F.col(f"`{a}`") == F.col(f"`{b}`"))
        g = wide.agg(F.count_if(both).alias("positions_compared"), F.count_if(same).alias("same_position_count"),
                     F.sort_array(F.collect_list(F.when(same, F.struct("rank", F.col(f"`{a}`").alias("m")))))
                     .alias("_m"))
        parts.append(g.select(
            F.lit(table).alias("table"), F.lit(a).alias("variant_a"), F.lit(b).alias("variant_b"),
            "positions_compared", "same_position_count",
            (F.col("same_position_count") / F.col("positions_compared") * 100.0).alias("same_position_pct"),
            F.array_join(F.transform("_m", lambda s: s["rank"].cast("string")), ", ").alias("matching_ranks"),
            F.array_join(F.transform("_m", lambda s: s["m"]), ", ").alias("matching_models"),
            F.lit(o).alias("other_variant")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shared_topics(score_rows: DataFrame) -> DataFrame:
    """Issues scored for every model (relational division by distinct count)."""
    pairs = score_rows.select("model", "issue").distinct()
    per = pairs.groupBy("issue").agg(F.countDistinct("model").alias("models_with_issue"))
    return per.filter(F.col("models_with_issue") == pairs.select(F.countDistinct("model")).scalar())
