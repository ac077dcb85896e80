"""Issue-level shift analyses on per-(model, issue, case) stance shares.

Every input here is already aggregated to (model, issue, case) cells, whose
number is bounded by the study design; joins between cells are equi-joins
on (model, issue) or (issue, case).  Pairwise-over-models statistics use
closed forms (sums of squares, rank sums) instead of materialising pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sway.functions.stats import binom_p_half

from sway.functions.stats import pearson, wilson

PRO_SIDE = ("pro", "75pro")
CON_SIDE = ("con", "75con")


def shifts(cells: DataFrame, baseline: str = "neither") -> DataFrame:
    """Pro-share shift per (model, issue, ecase) with the baseline pro and con shares."""
    w = W.partitionBy("model", "issue")
    is_b = F.col("ecase") == baseline
    c = cells.select("*", F.max(F.when(is_b, F.col("pro_share"))).over(w).alias("base_pro"),
                     F.max(F.when(is_b, F.col("con_share"))).over(w).alias("base_con"))
    c = c.filter(~is_b & F.col("base_pro").isNotNull())
    return c.select("model", "issue", "ecase", "pro_share", "con_share", "other_share", "base_pro",
                    "base_con", (F.col("pro_share") - F.col("base_pro")).alias("shift"))


def mean_shift(sh: DataFrame) -> DataFrame:
    return sh.groupBy("model", "ecase").agg(F.coalesce(F.avg("shift"), F.lit(0.0)).alias("mean_shift"),
                                            F.count(F.lit(1)).alias("n_issues"))


def bucket_of(base_pro, base_con):
    return (F.when(base_pro > 0.75, "Positive (pro > 0.75)")
            .when(base_con > 0.75, "Negative (con > 0.75)").otherwise("Middle"))


def bucket_shift(sh: DataFrame) -> DataFrame:
    # rounded to 12 decimals, so that the order of a sum can't turn a later rounding of a tie
    return (sh.withColumn("bucket", bucket_of(F.col("base_pro"), F.col("base_con")))
            .groupBy("model", "bucket", "ecase")
            .agg(F.round(F.avg("shift"), 12).alias("mean_shift"), F.count(F.lit(1)).alias("n_issues")))


BUCKETS = ("Positive (pro > 0.75)", "Middle", "Negative (con > 0.75)")


def shift_summary(sh: DataFrame, models: DataFrame, cases: tuple[str, ...]) -> DataFrame:
    """Mean shift per (model, bucket, case), with the rows of all buckets (``all``) and of all models (``overall``).

    One aggregation over grouping sets; the grid of models, buckets and cases is complete, with a mean of 0
    of no issues where there are none."""
    b = sh.withColumn("bucket", bucket_of(F.col("base_pro"), F.col("base_con")))
    sets = b.groupingSets([[F.col("model"), F.col("bucket"), F.col("ecase")], [F.col("model"), F.col("ecase")], [F.col("bucket"), F.col("ecase")], [F.col("ecase")]],
                          F.col("model"), F.col("bucket"), F.col("ecase"))
    g = sets.agg(F.round(F.avg("shift"), 12).alias("mean"), F.count(F.lit(1)).alias("n"))
    g = g.select(F.coalesce("model", F.lit("overall")).alias("model"), F.coalesce("bucket", F.lit("all")).alias("bucket"), "ecase", "mean", "n")
    listed = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    grid = models.select(F.explode(F.array("model", F.lit("overall"))).alias("model")).distinct()
    grid = grid.select("model", listed((*BUCKETS, "all")).alias("bucket")).select("model", "bucket", listed(cases).alias("ecase"))
    return grid.join(g, ["model", "bucket", "ecase"], "left").select(
        "model", "bucket", "ecase", F.coalesce("mean", F.lit(0.0)).alias("mean_shift"), F.coalesce("n", F.lit(0)).cast("long").alias("n_issues"))


def contradiction_effect(sh: DataFrame) -> DataFrame:
    """Effect of one contradictory argument: 75 % case minus the one-sided case, per track."""
    g = sh.groupBy("model", "issue").agg(
        *[F.max(F.when(F.col("ecase") == c, F.col("shift"))).alias(f"s_{c}") for c in
          ("pro", "75pro", "con", "75con")])
    rows = g.selectExpr(
        "model", "issue",
        "stack(2, 'pro', s_pro, s_75pro, 'con', s_con, s_75con) AS (track, one_sided, mixed)")
    rows = rows.filter(F.col("one_sided").isNotNull() & F.col("mixed").isNotNull())
    return rows.groupBy("model", "track").agg(
        F.avg("one_sided").alias("mean_one_sided_shift"), F.avg("mixed").alias("mean_75_shift"),
        F.avg(F.col("mixed") - F.col("one_sided")).alias("contradiction_effect"),
        F.count(F.lit(1)).alias("n_issues"))


def counter_shift_rows(sh: DataFrame) -> DataFrame:
    """Shifts against the direction of the evidence shown."""
    against = ((F.col("ecase").isin(*PRO_SIDE) & (F.col("shift") < 0))
               | (F.col("ecase").isin(*CON_SIDE) & (F.col("shift") > 0)))
    return sh.filter(against)


def counter_shifts(sh: DataFrame) -> DataFrame:
    return counter_shift_rows(sh).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_counter"), F.avg(F.abs("shift")).alias("mean_abs_counter_shift"))


def top_n(df: DataFrame, part: list[str], order: list, n: int) -> DataFrame:
    """Top-n rows per group (the limit is the feature: a top-k report)."""
    w = W.partitionBy(*part).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def rigid_issues(sh: DataFrame, thr: float = 0.3) -> DataFrame:
    """Issues whose every shift (all models and cases) is below ``thr`` in absolute value."""
    g = sh.groupBy("issue").agg(F.max(F.abs("shift")).alias("max_abs_shift"))
    return g.filter(F.col("max_abs_shift") < thr)


def movable_issues(sh: DataFrame, n: int = 5) -> DataFrame:
    g = sh.groupBy("model", "issue").agg(F.avg(F.abs("shift")).alias("mean_abs_shift"))
    return top_n(g, ["model"], [F.col("mean_abs_shift").desc(), F.col("issue")], n)


def model_disagreement(cells: DataFrame) -> DataFrame:
    """Per (issue, ecase, stance) across models: range, arg-max/min model, and mean and
    population variance of the pairwise absolute share differences (closed form)."""
    long = cells.selectExpr("model", "issue", "ecase",
                            "stack(3, 'con', con_share, 'other', other_share, 'pro', pro_share) "
                            "AS (issue_stance, share)")
    key = ["issue", "ecase", "issue_stance"]
    vals = long.groupBy(*key, "share").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy(*key).orderBy("share")
    below = F.coalesce(F.sum("c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    above = F.coalesce(F.sum("c").over(w.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    absum = vals.withColumn("t", F.col("c") * F.col("share") * (below - above)).groupBy(*key).agg(
        F.sum("t").alias("sum_abs"))
    g = long.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_models"), F.max("share").alias("mx"), F.min("share").alias("mn"),
        F.min_by("model", F.struct((-F.col("share")).alias("s"), F.col("model"))).alias("diff_models_max"),
        F.min_by("model", F.struct(F.col("share"), F.col("model"))).alias("diff_models_min"),
        F.sum("share").alias("sx"), F.sum(F.col("share") * F.col("share")).alias("sxx"))
    j = g.join(absum, key)
    n = F.col("n_models")
    pairs = n * (n - 1) / 2
    mean_abs = F.col("sum_abs") / pairs
    mean_sq = (n * F.col("sxx") - F.col("sx") * F.col("sx")) / pairs
    ok = n >= 2
    # the pairwise mean/variance run over all listed models, so they are undefined when any
    # model lacks the cell (the study's rule); the range only needs two models
    every = (n == cells.select(F.countDistinct("model")).scalar()) & (n >= 3)
    return j.select(
        *key, "n_models",
        F.when(ok, F.col("mx") - F.col("mn")).alias("max_diff"),
        F.when(ok, F.col("diff_models_max")).alias("diff_models_max"),
        F.when(ok, F.col("diff_models_min")).alias("diff_models_min"),
        F.when(every, mean_abs).alias("average_model_diff"),
        F.when(every, F.greatest(F.lit(0.0), mean_sq - mean_abs * mean_abs)).alias("variance_model_diff"))


def pair_agreement(cells: DataFrame, case_sets: dict[str, tuple[str, ...]]) -> DataFrame:
    """Pearson correlation of pro shares between every two models over (case, issue) cells.

    Models become columns (one pivot of the cell table); the case sets are disjoint, so one
    aggregation grouped by case set computes every pair's correlation side by side; no
    row-level pairing of models."""
    cs = None
    for name, cases in case_sets.items():
        cs = F.when(F.col("ecase").isin(*cases), F.lit(name)) if cs is None else cs.when(
            F.col("ecase").isin(*cases), F.lit(name))
    c = cells.withColumn("case_set", cs).filter(F.col("case_set").isNotNull())
    wide = c.groupBy("case_set", "ecase", "issue").pivot("model").agg(F.first("pro_share"))
    models = sorted(x for x in wide.columns if x not in ("case_set", "ecase", "issue"))
    aggs, names = [], []
    for i, a in enumerate(models):
        for b in models[i + 1:]:
            aggs += [pearson(F.col(f"`{a}`"), F.col(f"`{b}`")), F.count(F.when(
                F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull(), 1))]
            names.append((a, b))
    row = wide.groupBy("case_set").agg(*[x.alias(f"c{k}") for k, x in enumerate(aggs)])
    stack = ", ".join(f"'{a}', '{b}', c{2 * k}, c{2 * k + 1}" for k, (a, b) in enumerate(names))
    return row.selectExpr("case_set", f"stack({len(names)}, {stack}) AS (model_a, model_b, pearson_r, n)")


def top_disagreement(disagreement: DataFrame, k: int = 25) -> DataFrame:
    """Issues among the ``k`` baseline rows (issue, stance) of largest range across models, with that range."""
    b = disagreement.filter((F.col("ecase") == "neither") & F.col("max_diff").isNotNull())
    top = b.select("issue", "issue_stance", F.round("max_diff", 12).alias("max_diff")).orderBy(
        F.desc("max_diff"), "issue", "issue_stance").limit(k)
    return top.groupBy("issue").agg(F.max("max_diff").alias("max_diff"), F.count(F.lit(1)).alias("n_rows"))


def issue_split(cells: DataFrame, models: list[str], ecase: str = "neither") -> DataFrame:
    """Issues in report order: those that all of ``models`` answered first, each group by name."""
    have = F.size(F.array_intersect(F.collect_set(F.when(F.col("ecase") == ecase, F.col("model"))), F.array(*[F.lit(m) for m in models])))
    g = cells.groupBy("issue").agg((have == len(models)).alias("has_all"))
    # one row per issue
    return g.withColumn("position", F.row_number().over(W.orderBy(F.desc("has_all"), "issue")))


def decided_summary(split: DataFrame) -> DataFrame:
    """Mean, median, maximum and minimum over issues of the decided and the other share."""
    long = split.selectExpr("stack(2, 'decided', decided_share, 'other', other_share) AS (share, value)")
    return long.groupBy("share").agg(F.avg("value").alias("mean"), F.median("value").alias("median"),
                                     F.max("value").alias("max"), F.min("value").alias("min"))


def low_disagreement(cells: DataFrame, thr: float = 0.1) -> DataFrame:
    b = cells.filter(F.col("ecase") == "neither")
    g = b.groupBy("issue").agg((F.max("pro_share") - F.min("pro_share")).alias("max_pairwise_diff"),
                               F.avg("pro_share").alias("mean_pro_share"),
                               F.avg("con_share").alias("mean_con_share"),
                               F.count(F.lit(1)).alias("n_models"))
    return g.filter((F.col("n_models") >= 2) & (F.col("max_pairwise_diff") < thr))


def decided_split(cells: DataFrame) -> DataFrame:
    """Decided (pro + con) vs other share per issue over all models and cases."""
    g = cells.groupBy("issue").agg(F.sum("pro").alias("pro"), F.sum("con").alias("con"),
                                   F.sum("other").alias("other"))
    tot = F.col("pro") + F.col("con") + F.col("other")
    return g.select("issue", ((F.col("pro") + F.col("con")) / tot).alias("decided_share"),
                    (F.col("other") / tot).alias("other_share"), tot.alias("n"))


def one_sided_gap(cells: DataFrame, n: int = 5) -> DataFrame:
    """One-sided minus 75 % share of the evidence side, top n issues per (model, track)."""
    g = cells.groupBy("model", "issue").agg(
        (F.max(F.when(F.col("ecase") == "pro", F.col("pro_share")))
         - F.max(F.when(F.col("ecase") == "75pro", F.col("pro_share")))).alias("pro_gap"),
        (F.max(F.when(F.col("ecase") == "con", F.col("con_share")))
         - F.max(F.when(F.col("ecase") == "75con", F.col("con_share")))).alias("con_gap"))
    long = g.selectExpr("model", "issue", "stack(2, 'pro', pro_gap, 'con', con_gap) AS (track, gap)")
    long = long.filter(F.col("gap").isNotNull())
    return top_n(long, ["model", "track"], [F.col("gap").desc(), F.col("issue")], n)


def near_even_flips(cells: DataFrame) -> DataFrame:
    """Issues near 50/50 at baseline that reach > 0.9 on both one-sided cases."""
    g = cells.groupBy("model", "issue").agg(
        F.max(F.when(F.col("ecase") == "neither", F.col("pro_share"))).alias("base_pro"),
        F.max(F.when(F.col("ecase") == "pro", F.col("pro_share"))).alias("pro_case_pro"),
        F.max(F.when(F.col("ecase") == "con", F.col("con_share"))).alias("con_case_con"))
    return g.filter(F.col("base_pro").between(0.45, 0.55) & (F.col("pro_case_pro") > 0.9)
                    & (F.col("con_case_con") > 0.9))


def undecided_issues(cells: DataFrame, thr: float = 0.3) -> DataFrame:
    """(model, issue) whose baseline 'other' share is the largest or above ``thr``."""
    b = cells.filter(F.col("ecase") == "neither")
    top_other = (F.col("other_share") >= F.col("pro_share")) & (F.col("other_share") >= F.col("con_share"))
    return b.filter(top_other | (F.col("other_share") > thr)).select(
        "model", "issue", "other_share", top_other.alias("other_is_top"))


def wilson_shares(cells: DataFrame) -> DataFrame:
    """Pooled pro share (of decided answers) and other share per (model, ecase), Wilson 95 %."""
    g = cells.groupBy("model", "ecase").agg(F.sum("pro").alias("pro"), F.sum("con").alias("con"),
                                            F.sum("other").alias("other"))
    dec = F.col("pro") + F.col("con")
    tot = dec + F.col("other")
    plo, phi = wilson(F.col("pro"), dec)
    olo, ohi = wilson(F.col("other"), tot)
    return g.select("model", "ecase", "pro", "con", "other",
                    F.try_divide(F.col("pro"), dec.cast("double")).alias("pro_share"),
                    plo.alias("pro_ci_low"), phi.alias("pro_ci_high"),
                    (F.col("other") / tot).alias("other_share"), olo.alias("other_ci_low"),
                    ohi.alias("other_ci_high"))


def baseline_pro_gt_con(cells: DataFrame) -> DataFrame:
    b = cells.filter(F.col("ecase") == "neither")
    return b.groupBy("model").agg(F.count(F.lit(1)).alias("n_issues"),
                                  F.count_if(F.col("pro_share") > F.col("con_share")).alias("n_pro_gt_con"),
                                  F.avg((F.col("pro_share") > F.col("con_share")).cast("double"))
                                  .alias("pro_gt_con_pct")).withColumn(
        "p_value", binom_p_half(F.col("n_pro_gt_con"), F.col("n_issues")))


def dispersion_categories(cells: DataFrame) -> DataFrame:
    """Issue dispersion at baseline: mean pro share and sample variance of pro counts across
    models; categories by the 0.2/0.8 quantiles over issues (the per-issue table has one
    row per issue, so the quantiles are taken over a bounded table)."""
    b = cells.filter(F.col("ecase") == "neither")
    # statistics rounded to 9 decimals so threshold comparisons do not hinge on summation order
    per = b.groupBy("issue").agg(
        F.round(F.avg("pro_share"), 9).alias("mean_pro"),
        F.round(F.coalesce(F.var_samp(F.col("pro").cast("double")), F.lit(0.0)), 9).alias("var_pro"))
    # global quantiles as scalar subqueries (no join, no single-partition window)
    j = per.select("*", *[per.select(F.percentile(c, q)).scalar().alias(a) for c, q, a in (
        ("var_pro", 0.2, "v20"), ("var_pro", 0.8, "v80"), ("mean_pro", 0.2, "m20"), ("mean_pro", 0.8, "m80"))])
    low = F.col("var_pro") < F.col("v20")
    consistent = low & ((F.col("mean_pro") > F.col("m80")) | (F.col("mean_pro") < F.col("m20")))
    return j.agg(F.count_if(low).alias("unanimous_low_variance"),
                 F.count_if(consistent).alias("unanimous_and_consistent"),
                 F.count_if(F.col("var_pro") > F.col("v80")).alias("strong_disagreement"))


def other_drop(cells: DataFrame) -> DataFrame:
    """'other' answers all-evidence vs baseline per (model, issue), ordered by |shift|."""
    g = cells.groupBy("model", "issue").agg(
        *[F.max(F.when(F.col("ecase") == c, F.col(k))).alias(f"{k}_{c}")
          for c in ("neither", "all") for k in ("other", "total")])
    g = g.filter(F.col("total_neither").isNotNull() & F.col("total_all").isNotNull())
    return g.select("model", "issue", "other_neither", "total_neither", "other_all", "total_all",
                    (F.col("other_all") / F.col("total_all") - F.col("other_neither") / F.col("total_neither"))
                    .alias("other_shift"))


# Issues the study leaves out of its all-vs-neither comparison.
REMOVED_ISSUES = ("corporal-punishment", "dare-drug-abuse-resistance-education", "tablets-vs-textbooks")


def without_issues(df: DataFrame, removed, col: str = "issue") -> DataFrame:
    """Drop rows whose issue is on an exclusion list (a short literal list)."""
    return df.filter(~F.col(col).isin(*removed))


def all_vs_neither(cells: DataFrame, slug_col: str = "slug", removed=REMOVED_ISSUES) -> DataFrame:
    """Pro share with all evidence vs without evidence per (model, issue), excluded issues removed."""
    c = without_issues(cells, removed, slug_col)
    g = c.groupBy("model", "issue", slug_col).agg(
        F.max(F.when(F.col("ecase") == "neither", F.col("pro_share"))).alias("neither_pro"),
        F.max(F.when(F.col("ecase") == "all", F.col("pro_share"))).alias("all_pro"))
    g = g.filter(F.col("neither_pro").isNotNull() & F.col("all_pro").isNotNull())
    return g.withColumn("shift", F.col("all_pro") - F.col("neither_pro"))


def pair_outliers(cells: DataFrame, case_sets: dict[str, tuple[str, ...]], n: int = 10) -> DataFrame:
    """Per model pair and case set, the ``n`` (case, issue) cells where the two models' pro
    shares differ most (a top-k report).  Models become columns of one pivot; pair
    differences are stacked from those columns, so no join pairs the rows."""
    cs = None
    for name, cases in case_sets.items():
        cs = F.when(F.col("ecase").isin(*cases), F.lit(name)) if cs is None else cs.when(
            F.col("ecase").isin(*cases), F.lit(name))
    c = cells.withColumn("case_set", cs).filter(F.col("case_set").isNotNull())
    wide = c.groupBy("case_set", "ecase", "issue").pivot("model").agg(F.first("pro_share"))
    models = sorted(x for x in wide.columns if x not in ("case_set", "ecase", "issue"))
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    stack = ", ".join(f"'{a}', '{b}', `{a}`, `{b}`" for a, b in pairs)
    long = wide.selectExpr("case_set", "ecase", "issue",
                           f"stack({len(pairs)}, {stack}) AS (model_a, model_b, share_a, share_b)")
    long = long.filter(F.col("share_a").isNotNull() & F.col("share_b").isNotNull()).withColumn(
        "diff", F.abs(F.col("share_a") - F.col("share_b")))
    return top_n(long, ["case_set", "model_a", "model_b"], [F.col("diff").desc(), F.col("ecase"), F.col("issue")], n)
