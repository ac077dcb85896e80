"""Queries: open-mindedness scores, variants, summaries and rank comparison (step 3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sway.operators import openmind as om
from sway.operators import shares
from sway.plans.catalog import query
from sway.plans.oracle import t_quantile_ctes
from sway.sources import fixtures as fx

_SCORES_CTE = """
WITH c AS (SELECT issue, ecase, issue_stance, model, sum("count") AS n
           FROM stance_counts GROUP BY issue, ecase, issue_stance, model),
keys AS (SELECT DISTINCT issue, ecase, issue_stance FROM c),
models AS (SELECT DISTINCT model FROM c),
g0 AS (SELECT k.issue, k.ecase, k.issue_stance, m.model, coalesce(c.n, 0) AS n
       FROM keys k CROSS JOIN models m
       LEFT JOIN c ON c.issue = k.issue AND c.ecase = k.ecase AND c.issue_stance = k.issue_stance
                   AND c.model = m.model),
grid AS (SELECT *, coalesce(n / nullif(sum(n) OVER (PARTITION BY issue, ecase, model), 0), 0) AS share,
           CASE issue_stance WHEN 'con' THEN 0 WHEN 'other' THEN 1 ELSE 2 END AS sr FROM g0),
rk AS (SELECT *,
         row_number() OVER (PARTITION BY model, issue, ecase ORDER BY share DESC, sr) AS rn,
         row_number() OVER (PARTITION BY model, issue, ecase
                            ORDER BY (issue_stance = 'other'), share DESC, sr) AS rn_dec,
         count(*) OVER (PARTITION BY model, issue, ecase) AS n_st
       FROM grid),
top1 AS (SELECT model, issue, ecase, issue_stance AS st, share, n_st FROM rk WHERE rn = 1),
dec1 AS (SELECT model, issue, ecase, issue_stance AS st, share FROM rk WHERE rn_dec = 1),
base AS (SELECT t.model, t.issue,
           CASE WHEN t.st = 'other' AND t.n_st > 1 THEN d.st ELSE t.st END AS bst,
           CASE WHEN t.st = 'other' AND t.n_st > 1 THEN d.share ELSE t.share END AS bsh
         FROM top1 t JOIN dec1 d ON d.model = t.model AND d.issue = t.issue AND d.ecase = t.ecase
         WHERE t.ecase = 'neither'),
cs AS (SELECT model, issue, ecase, st, share FROM top1 WHERE ecase <> 'neither'),
j AS (SELECT b.model, b.issue, b.bst, b.bsh, cs.ecase, cs.st <> b.bst AS flip, abs(cs.share - b.bsh) AS mag
      FROM base b LEFT JOIN cs ON cs.model = b.model AND cs.issue = b.issue),
wt AS (SELECT * FROM (VALUES
         ('weighted_binary_flip_original', 'pro', 1.0), ('weighted_binary_flip_original', 'con', 1.0),
         ('weighted_binary_flip_original', '75pro', 2.0), ('weighted_binary_flip_original', '75con', 2.0),
         ('weighted_binary_flip_original', 'all', 3.0),
         ('even_weight_binary_flip', 'pro', 1.0), ('even_weight_binary_flip', 'con', 1.0),
         ('even_weight_binary_flip', '75pro', 1.0), ('even_weight_binary_flip', '75con', 1.0),
         ('even_weight_binary_flip', 'all', 1.0)) v(variant, ecase, w)),
vs AS (SELECT * FROM (VALUES ('weighted_binary_flip_original', 9.0), ('even_weight_binary_flip', 5.0)) v(variant, wsum)),
scores AS (
  SELECT vs.variant, j.model, j.issue, j.bst AS baseline_stance, j.bsh AS baseline_share,
    coalesce(sum(CASE WHEN j.flip AND j.ecase IS NOT NULL THEN coalesce(wt.w, 1.0) * j.mag END), 0.0)
      AS open_mindedness_score_raw,
    count(*) FILTER (WHERE j.flip AND j.ecase IS NOT NULL) AS num_contributing_cases,
    coalesce(sum(CASE WHEN j.flip AND j.ecase IS NOT NULL THEN coalesce(wt.w, 1.0) * j.mag END), 0.0)
      / vs.wsum * 100.0 AS open_mindedness_score
  FROM j CROSS JOIN vs LEFT JOIN wt ON wt.variant = vs.variant AND wt.ecase = j.ecase
  GROUP BY vs.variant, vs.wsum, j.model, j.issue, j.bst, j.bsh),
omw AS (SELECT model, issue, CAST(sum("count") AS DOUBLE) AS om_weight FROM stance_counts
        WHERE ecase IN ('pro', '75pro', 'all', '75con', 'con') GROUP BY model, issue),
mom AS (SELECT s.variant, s.model, sum(coalesce(w.om_weight, 1.0)) AS sw,
          sum(coalesce(w.om_weight, 1.0) * s.open_mindedness_score) AS swx,
          sum(coalesce(w.om_weight, 1.0) * s.open_mindedness_score * s.open_mindedness_score) AS swxx,
          sum(coalesce(w.om_weight, 1.0) * coalesce(w.om_weight, 1.0)) AS sww, count(*) AS n_issues
        FROM scores s LEFT JOIN omw w ON w.model = s.model AND w.issue = s.issue
        GROUP BY s.variant, s.model),
moments AS (SELECT variant, model, swx / sw AS om_mean,
              greatest(swxx / sw - (swx / sw) * (swx / sw), 0.0) AS var_w,
              greatest(sw * sw / sww, 1.0) AS n_eff, n_issues FROM mom),
ranked AS (SELECT variant, model, om_mean,
             row_number() OVER (PARTITION BY variant ORDER BY om_mean DESC, model) AS rank FROM moments)
"""


def _counts(spark, sf_dir):
    """Stance counts (bounded by models x issues x cases x stances), materialised once:
    the share grid and the issue weights both read them."""
    from sway.session import materialize
    return materialize(shares.stance_counts(fx.trials(spark, sf_dir)))


def _scores(spark, sf_dir):
    from sway.session import materialize
    counts = _counts(spark, sf_dir)
    return counts, materialize(om.scores(shares.stance_share_grid(counts, fill_models=True)))


@query("open_mindedness", _SCORES_CTE + """
SELECT variant, model, issue, baseline_stance, round(baseline_share, 6) AS baseline_share,
  round(open_mindedness_score_raw, 6) AS open_mindedness_score_raw, num_contributing_cases,
  round(open_mindedness_score, 6) AS open_mindedness_score
FROM scores
""")
def q_open_mindedness(spark, sf_dir):
    return _scores(spark, sf_dir)[1]


@query("om_moments", _SCORES_CTE + """
SELECT variant, model, round(om_mean, 6) AS om_mean, round(var_w, 6) AS var_w, round(n_eff, 6) AS n_eff,
  n_issues FROM moments
""")
def q_om_moments(spark, sf_dir):
    counts, s = _scores(spark, sf_dir)
    return om.weighted_moments(s, counts)


@query("om_model_summary", _SCORES_CTE + f"""
, {t_quantile_ctes("SELECT DISTINCT greatest(n_eff - 1, 1) AS v FROM moments").strip()},
o AS (SELECT *, CASE WHEN n_issues = 1 THEN 0 ELSE coalesce(q * sqrt(var_w / n_eff), 0) END AS pm
      FROM moments LEFT JOIN tq ON tq.v = greatest(n_eff - 1, 1))
SELECT variant, model, round(om_mean, 6) AS om_mean, round(om_mean - pm, 6) AS trial_ci_low, round(om_mean + pm, 6) AS trial_ci_high,
  round(pm, 6) AS trial_ci_pm, n_issues, printf('%.3f ± %.3f', om_mean, pm) AS om_pm FROM o
""")
def q_om_model_summary(spark, sf_dir):
    """Weighted mean and effective-n t interval."""
    counts, s = _scores(spark, sf_dir)
    return om.model_summary(s, counts)


@query("rank_layout", _SCORES_CTE + """
SELECT CAST(rank AS INTEGER) AS rank,
  max(model) FILTER (WHERE variant = 'weighted_binary_flip_original') AS weighted_binary_flip_original,
  max(model) FILTER (WHERE variant = 'even_weight_binary_flip') AS even_weight_binary_flip
FROM ranked GROUP BY rank
""")
def q_rank_layout(spark, sf_dir):
    counts, s = _scores(spark, sf_dir)
    return om.rank_layout(om.rankings(om.weighted_moments(s, counts)))


@query("rank_overlap", _SCORES_CTE + """
, pairs AS (SELECT a.rank, a.variant AS variant_a, b.variant AS variant_b, a.model AS model_a,
              a.model = b.model AS same
            FROM ranked a JOIN ranked b ON a.rank = b.rank AND a.variant < b.variant
            WHERE a.variant = 'weighted_binary_flip_original' OR b.variant = 'weighted_binary_flip_original')
SELECT 'fixture_models' AS "table", variant_a, variant_b, count(*) AS positions_compared,
  count(*) FILTER (WHERE same) AS same_position_count,
  round(count(*) FILTER (WHERE same) / count(*) * 100.0, 6) AS same_position_pct,
  coalesce(string_agg(CAST(rank AS VARCHAR), ', ' ORDER BY rank) FILTER (WHERE same), '') AS matching_ranks,
  coalesce(string_agg(model_a, ', ' ORDER BY rank) FILTER (WHERE same), '') AS matching_models,
  CASE WHEN variant_a = 'weighted_binary_flip_original' THEN variant_b ELSE variant_a END AS other_variant
FROM pairs GROUP BY variant_a, variant_b
""")
def q_rank_overlap(spark, sf_dir):
    counts, s = _scores(spark, sf_dir)
    return om.rank_overlap(om.rankings(om.weighted_moments(s, counts)), "fixture_models")


@query("shared_topics", _SCORES_CTE + """
, p AS (SELECT DISTINCT model, issue FROM scores)
SELECT issue, count(DISTINCT model) AS models_with_issue FROM p GROUP BY issue
HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM p)
""")
def q_shared_topics(spark, sf_dir):
    return om.shared_topics(_scores(spark, sf_dir)[1])


# ---- themes (T16, A32, A53) ----

from sway.operators import resample as RS  # noqa: E402
from sway.operators.evstats import family_of  # noqa: E402
from sway.sources import themes as TH  # noqa: E402


def _fixture_slug(issue):
    """Fixture issue-N stands for the study topic at position 5N (mod table size) of the theme
    table, so the lookup covers every theme."""
    slugs = [s for s, _ in TH.theme_pairs()]
    n = F.regexp_extract(issue, r"(\d+)$", 1).try_cast("int")
    return F.element_at(F.array(*[F.lit(s) for s in slugs]), (n * 5) % len(slugs) + 1)


def _themed_scores(spark, sf_dir):
    counts, s = _scores(spark, sf_dir)
    s = s.withColumn("slug", _fixture_slug(F.col("issue")))
    s = TH.with_theme(s, TH.theme_table(spark), "slug")
    w = om.om_weights(counts)
    s = s.join(w, ["model", "issue"], "left").withColumn("om_weight", F.coalesce("om_weight", F.lit(1.0)))
    return s


def _theme_sql() -> str:
    pairs = TH.theme_pairs()
    slugs = ", ".join("'" + s + "'" for s, _ in pairs)
    vals = ", ".join("('" + s + "', '" + t.replace("'", "''") + "')" for s, t in pairs)
    return _SCORES_CTE + f"""
, th AS (SELECT * FROM (VALUES {vals}) v(slug, theme)),
ts AS (SELECT s.*, coalesce(th.theme, 'Other') AS theme,
         coalesce(w.om_weight, 1.0) AS om_weight
       FROM (SELECT *, [{slugs}][(CAST(regexp_extract(issue, '(\\d+)$', 1) AS INTEGER) * 5) % {len(pairs)} + 1] AS slug
             FROM scores) s
       LEFT JOIN th USING (slug) LEFT JOIN omw w ON w.model = s.model AND w.issue = s.issue)
"""


@query("om_by_theme", _theme_sql() + """
SELECT variant, theme, count(*) AS n_issues, round(avg(open_mindedness_score), 6) AS mean_score
FROM ts GROUP BY variant, theme
""")
def q_om_by_theme(spark, sf_dir):
    """Open-mindedness mean and count per high-level theme."""
    s = _themed_scores(spark, sf_dir)
    return s.groupBy("variant", "theme").agg(F.count(F.lit(1)).alias("n_issues"),
                                             F.avg("open_mindedness_score").alias("mean_score"))


@query("om_by_theme_model", _theme_sql() + """
, g AS (SELECT variant, theme, model, count(*) AS n_issues, avg(open_mindedness_score) AS mean_score FROM ts
        GROUP BY variant, theme, model),
o AS (SELECT variant, theme, max(mean_score) AS mx FROM g GROUP BY variant, theme)
SELECT g.variant, g.theme, g.model, g.n_issues, round(g.mean_score, 6) AS mean_score,
  CAST(dense_rank() OVER (PARTITION BY g.variant ORDER BY o.mx DESC, g.theme) AS INTEGER) AS theme_order
FROM g JOIN o USING (variant, theme)
""")
def q_om_by_theme_model(spark, sf_dir):
    """Theme x model means with the theme order (by the largest model mean)."""
    from pyspark.sql.window import Window as W
    s = _themed_scores(spark, sf_dir)
    g = s.groupBy("variant", "theme", "model").agg(F.count(F.lit(1)).alias("n_issues"),
                                                  F.avg("open_mindedness_score").alias("mean_score"))
    mx = F.max("mean_score").over(W.partitionBy("variant", "theme"))
    g = g.withColumn("_mx", mx)
    return g.withColumn("theme_order", F.dense_rank().over(
        W.partitionBy("variant").orderBy(F.col("_mx").desc(), F.col("theme")))).drop("_mx")


@query("om_theme_sets", _theme_sql() + """
, tf AS (SELECT ts.*, 'f' || CAST(floor(CAST(regexp_extract(model, '(\\d+)$', 1) AS INTEGER) / 3) AS BIGINT) AS family FROM ts)
SELECT variant, theme, model, family, count(*) AS n_issues, round(round(avg(open_mindedness_score), 12), 6) AS mean_score,
  CASE WHEN grouping(theme) = 1 THEN 'overall' ELSE 'theme' END || CASE WHEN grouping(model) = 0 THEN ' x model' WHEN grouping(family) = 0 THEN ' x family' ELSE '' END AS level
FROM tf GROUP BY GROUPING SETS ((variant, theme), (variant, theme, model), (variant, theme, family), (variant, model), (variant, family), (variant))
""")
def q_om_theme_sets(spark, sf_dir):
    """Mean scores by theme, theme x model and theme x family, and the same over all themes, in one aggregation."""
    s = _themed_scores(spark, sf_dir).join(fx.model_families(spark, sf_dir), "model")
    v, t, m, f = (F.col(c) for c in ("variant", "theme", "model", "family"))
    g = s.groupingSets([[v, t], [v, t, m], [v, t, f], [v, m], [v, f], [v]], v, t, m, f).agg(
        F.count(F.lit(1)).alias("n_issues"), F.round(F.avg("open_mindedness_score"), 12).alias("mean_score"),
        F.grouping("theme").alias("_t"), F.grouping("model").alias("_m"), F.grouping("family").alias("_f"))
    level = F.concat(F.when(F.col("_t") == 1, "overall").otherwise("theme"), F.when(F.col("_m") == 0, " x model").when(F.col("_f") == 0, " x family").otherwise(""))
    return g.select("variant", "theme", "model", "family", "n_issues", "mean_score", level.alias("level"))


@query("theme_bootstrap", _theme_sql() + """
, it AS (SELECT variant, theme, model, open_mindedness_score AS x, om_weight AS w,
           row_number() OVER (PARTITION BY variant, theme, model ORDER BY issue) - 1 AS idx
         FROM ts WHERE theme <> 'Other' AND om_weight > 0),
g AS (SELECT variant, theme, model, count(*) AS n, sum(w * x) / sum(w) AS mean FROM it GROUP BY 1, 2, 3),
dr AS (SELECT g.variant, g.theme, g.model, g.n, b.b, i.i FROM g, range(1, 1201) b(b), range(0, g.n) i(i)),
dx AS (SELECT variant, theme, model, b,
         ('0x' || substr(md5(concat_ws(':', '42', variant, theme, model, CAST(b AS VARCHAR), CAST(i AS VARCHAR))), 1, 8))::BIGINT
           % n AS idx FROM dr),
reps AS (SELECT dx.variant, dx.theme, dx.model, dx.b, sum(it.w * it.x) / sum(it.w) AS m
         FROM dx JOIN it USING (variant, theme, model, idx) GROUP BY 1, 2, 3, 4),
bd AS (SELECT variant, theme, model, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM reps
       GROUP BY 1, 2, 3)
SELECT g.variant, g.theme, g.model, g.n, round(g.mean, 6) AS mean,
  round(CASE WHEN g.n = 1 THEN g.mean ELSE lo END, 6) AS issue_ci_low,
  round(CASE WHEN g.n = 1 THEN g.mean ELSE hi END, 6) AS issue_ci_high
FROM g LEFT JOIN bd USING (variant, theme, model)
""")
def q_theme_bootstrap(spark, sf_dir):
    """Trial-weighted theme x model mean with a 1 200-draw issue bootstrap interval ('Other' left out)."""
    s = _themed_scores(spark, sf_dir).filter(F.col("theme") != "Other")
    return RS.bootstrap_weighted_mean_ci(s, ["variant", "theme", "model"], "open_mindedness_score", "om_weight",
                                         "issue", 1200)


@query("theme_dual_ci")
def q_theme_dual_ci(spark, sf_dir):
    """Theme x model: weighted mean with the effective-n t interval and the issue bootstrap
    interval, plus the model family (rows-only: t quantile)."""
    s = _themed_scores(spark, sf_dir).filter(F.col("theme") != "Other")
    boot = RS.bootstrap_weighted_mean_ci(s, ["variant", "theme", "model"], "open_mindedness_score", "om_weight",
                                         "issue", 1200)
    x, w = F.col("open_mindedness_score"), F.col("om_weight")
    g = s.groupBy("variant", "theme", "model").agg(F.sum(w).alias("sw"), F.sum(w * x).alias("swx"),
                                                  F.sum(w * x * x).alias("swxx"), F.sum(w * w).alias("sww"))
    mean = F.col("swx") / F.col("sw")
    var = F.greatest(F.col("swxx") / F.col("sw") - mean * mean, F.lit(0.0))
    neff = F.greatest(F.col("sw") * F.col("sw") / F.col("sww"), F.lit(1.0))
    from sway.functions.stats import t_quantile_975
    half = F.coalesce(t_quantile_975(F.greatest(neff - 1.0, F.lit(1.0))) * F.sqrt(var / neff), F.lit(0.0))
    t = g.select("variant", "theme", "model", (mean - half).alias("trial_ci_low"), (mean + half).alias("trial_ci_high"))
    out = boot.join(t, ["variant", "theme", "model"])
    one = F.col("n") == 1
    return out.select("variant", "theme", "model", family_of(F.col("model")).alias("family"), "n", "mean",
                      F.when(one, F.col("mean")).otherwise(F.col("trial_ci_low")).alias("trial_ci_low"),
                      F.when(one, F.col("mean")).otherwise(F.col("trial_ci_high")).alias("trial_ci_high"),
                      "issue_ci_low", "issue_ci_high")


@query("om_variants", _SCORES_CTE.replace(
    "vs AS (SELECT * FROM (VALUES ('weighted_binary_flip_original', 9.0), ('even_weight_binary_flip', 5.0)) v(variant, wsum)),",
    "vs AS (SELECT * FROM (VALUES ('weighted_binary_flip_original', 9.0, true), ('even_weight_binary_flip', 5.0, true), "
    "('even_weight_no_flip', 5.0, false)) v(variant, wsum, need_flip)),").replace(
    "('even_weight_binary_flip', 'all', 1.0)) v(variant, ecase, w)),",
    "('even_weight_binary_flip', 'all', 1.0), ('even_weight_no_flip', 'pro', 1.0), ('even_weight_no_flip', 'con', 1.0), "
    "('even_weight_no_flip', '75pro', 1.0), ('even_weight_no_flip', '75con', 1.0), ('even_weight_no_flip', 'all', 1.0)) "
    "v(variant, ecase, w)),").replace(
    "CASE WHEN j.flip AND j.ecase IS NOT NULL", "CASE WHEN (j.flip OR NOT vs.need_flip) AND j.ecase IS NOT NULL").replace(
    "count(*) FILTER (WHERE j.flip AND j.ecase IS NOT NULL)",
    "count(*) FILTER (WHERE (j.flip OR NOT vs.need_flip) AND j.ecase IS NOT NULL)").replace(
    "GROUP BY vs.variant, vs.wsum, j.model", "GROUP BY vs.variant, vs.wsum, vs.need_flip, j.model") + """
SELECT variant, model, issue, baseline_stance, round(baseline_share, 6) AS baseline_share,
  round(open_mindedness_score_raw, 6) AS open_mindedness_score_raw, num_contributing_cases,
  round(open_mindedness_score, 6) AS open_mindedness_score
FROM scores
""")
def q_om_variants(spark, sf_dir):
    """All three announced variants in one pass, including even weights without the flip
    condition."""
    return om.scores(shares.stance_share_grid(_counts(spark, sf_dir), fill_models=True),
                     variants=om.VARIANTS + (om.EVEN_NO_FLIP,))


@query("om_details")
def q_om_details(spark, sf_dir):
    """Contributing cases per (model, issue) for the weighted variant: from/to stance,
    magnitude, weight, weighted score (nested list; rows-only)."""
    return om.score_details(shares.stance_share_grid(_counts(spark, sf_dir), fill_models=True))
