"""Queries: paired shift against the baseline and the shift family (steps 1 and 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sway.operators import shares, shift
from sway.plans.catalog import query
from sway.plans.oracle import binomial_half_sql, hypergeometric_less_sql, marker_sql, paired_t_sql, t_quantile_ctes
from sway.sources import fixtures as fx


def _shares(spark, sf_dir):
    """Per-trial-cell shares (bounded by the design), materialised once per query."""
    from sway.session import materialize
    return materialize(shares.trial_shares(fx.trials(spark, sf_dir)))


@query("paired_shift", """
, d AS (
  SELECT c.model, c.ecase, c.pro_share - b.pro_share AS pro_shift
  FROM trial_shares c JOIN trial_shares b
    ON c.model = b.model AND c.issue = b.issue AND c.trial_num = b.trial_num
  WHERE c.ecase <> 'neither' AND b.ecase = 'neither')
SELECT model, ecase, round(avg(pro_shift), 6) AS mean_pro_shift,
       round(stddev_samp(pro_shift), 6) AS sd_shift, count(*) AS n_trials
FROM d GROUP BY model, ecase
""".replace("\n, d AS", "WITH d AS", 1))
def q_paired_shift(spark, sf_dir):
    return shift.paired_shift(_shares(spark, sf_dir))


SHIFT_TESTS = f"""
WITH d AS (
  SELECT c.model, c.ecase, c.pro_share - b.pro_share AS x
  FROM trial_shares c JOIN trial_shares b ON c.model = b.model AND c.issue = b.issue AND c.trial_num = b.trial_num
  WHERE c.ecase <> 'neither' AND b.ecase = 'neither'),
st AS (SELECT model, ecase, avg(x) AS m, stddev_samp(x) AS sd, count(*) AS n FROM d GROUP BY model, ecase),
{t_quantile_ctes("SELECT DISTINCT (n - 1)::DOUBLE AS v FROM st WHERE n > 1")},
tests AS (SELECT model, ecase, m AS mean_pro_shift, {paired_t_sql("m", "sd", "n")} AS p_value,
            m - coalesce(q * sd / sqrt(n), 0) AS ci_lower, m + coalesce(q * sd / sqrt(n), 0) AS ci_upper, n AS n_trials
          FROM st LEFT JOIN tq ON tq.v = st.n - 1)
"""
_TEST_COLUMNS = """model, ecase, round(mean_pro_shift, 6) AS mean_pro_shift, round(p_value, 6) AS p_value,
  round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper, n_trials"""


@query("shift_statistics", SHIFT_TESTS + f"SELECT {_TEST_COLUMNS} FROM tests")
def q_shift_statistics(spark, sf_dir):
    """Paired t p-value and t interval of the shift."""
    return shift.shift_statistics(_shares(spark, sf_dir))


# ---- shift family (step 4) over per-(model, issue, case) cells ----

from sway.operators import shiftfam as SF  # noqa: E402

_CELLS = """
WITH cells AS (
  SELECT model, issue, ecase, count(*) FILTER (WHERE issue_stance = 'pro') AS pro,
    count(*) FILTER (WHERE issue_stance = 'con') AS con,
    count(*) FILTER (WHERE issue_stance NOT IN ('pro', 'con')) AS other, count(*) AS total,
    count(*) FILTER (WHERE issue_stance = 'pro') / count(*) AS pro_share,
    count(*) FILTER (WHERE issue_stance = 'con') / count(*) AS con_share,
    count(*) FILTER (WHERE issue_stance NOT IN ('pro', 'con')) / count(*) AS other_share
  FROM trials WHERE issue <> 'unknown' GROUP BY model, issue, ecase),
sh AS (
  SELECT c.model, c.issue, c.ecase, c.pro_share, c.con_share, c.other_share, b.pro_share AS base_pro,
    b.con_share AS base_con, c.pro_share - b.pro_share AS shift
  FROM cells c JOIN cells b ON c.model = b.model AND c.issue = b.issue AND b.ecase = 'neither'
  WHERE c.ecase <> 'neither')
"""


def _cells(spark, sf_dir):
    """Per-(model, issue, case) stance cells, materialised once per query."""
    from sway.session import materialize
    return materialize(shares.share_pivot(fx.trials(spark, sf_dir)))


def _sh(spark, sf_dir):
    return SF.shifts(_cells(spark, sf_dir))


@query("pro_shift", _CELLS + """
SELECT model, issue, ecase, round(pro_share, 6) AS pro_share, round(con_share, 6) AS con_share,
  round(other_share, 6) AS other_share, round(base_pro, 6) AS base_pro, round(base_con, 6) AS base_con,
  round(shift, 6) AS shift FROM sh
""")
def q_pro_shift(spark, sf_dir):
    return _sh(spark, sf_dir)


@query("mean_shift", _CELLS + """
SELECT model, ecase, round(coalesce(avg(shift), 0.0), 6) AS mean_shift, count(*) AS n_issues FROM sh
GROUP BY model, ecase
""")
def q_mean_shift(spark, sf_dir):
    return SF.mean_shift(_sh(spark, sf_dir))


@query("bucket_shift", _CELLS + """
SELECT model, CASE WHEN base_pro > 0.75 THEN 'Positive (pro > 0.75)' WHEN base_con > 0.75
  THEN 'Negative (con > 0.75)' ELSE 'Middle' END AS bucket, ecase, round(round(avg(shift), 12), 6) AS mean_shift,
  count(*) AS n_issues FROM sh GROUP BY 1, 2, 3
""")
def q_bucket_shift(spark, sf_dir):
    return SF.bucket_shift(_sh(spark, sf_dir))


@query("shift_summary", _CELLS + """
, sb AS (SELECT model, CASE WHEN base_pro > 0.75 THEN 'Positive (pro > 0.75)' WHEN base_con > 0.75 THEN 'Negative (con > 0.75)' ELSE 'Middle' END AS bucket, ecase, shift FROM sh),
sg AS (SELECT coalesce(model, 'overall') AS model, coalesce(bucket, 'all') AS bucket, ecase, round(avg(shift), 12) AS mean, count(*) AS n FROM sb
       GROUP BY GROUPING SETS ((model, bucket, ecase), (model, ecase), (bucket, ecase), (ecase))),
grid AS (SELECT m.model, k.bucket, e.ecase FROM (SELECT model FROM models_dim UNION ALL SELECT 'overall') m,
         (VALUES ('Positive (pro > 0.75)'), ('Middle'), ('Negative (con > 0.75)'), ('all')) k(bucket), (VALUES ('pro'), ('75pro'), ('all'), ('75con'), ('con')) e(ecase))
SELECT model, bucket, ecase, round(coalesce(mean, 0.0), 6) AS mean_shift, coalesce(n, 0) AS n_issues FROM grid LEFT JOIN sg USING (model, bucket, ecase)
""")
def q_shift_summary(spark, sf_dir):
    """Mean shifts by model, bucket and case with overall rows, over the complete grid."""
    return SF.shift_summary(_sh(spark, sf_dir), fx.models_dim(spark, sf_dir), fx.EVIDENCE_CASES)


@query("contradiction_effect", _CELLS + """
, g AS (SELECT model, issue, max(shift) FILTER (WHERE ecase = 'pro') AS s_pro,
          max(shift) FILTER (WHERE ecase = '75pro') AS s_75pro, max(shift) FILTER (WHERE ecase = 'con') AS s_con,
          max(shift) FILTER (WHERE ecase = '75con') AS s_75con FROM sh GROUP BY model, issue),
r AS (SELECT model, issue, 'pro' AS track, s_pro AS one_sided, s_75pro AS mixed FROM g
      UNION ALL SELECT model, issue, 'con', s_con, s_75con FROM g)
SELECT model, track, round(avg(one_sided), 6) AS mean_one_sided_shift, round(avg(mixed), 6) AS mean_75_shift,
  round(avg(mixed - one_sided), 6) AS contradiction_effect, count(*) AS n_issues
FROM r WHERE one_sided IS NOT NULL AND mixed IS NOT NULL GROUP BY model, track
""")
def q_contradiction_effect(spark, sf_dir):
    return SF.contradiction_effect(_sh(spark, sf_dir))


_COUNTER = """
, ctr AS (SELECT * FROM sh WHERE (ecase IN ('pro', '75pro') AND shift < 0) OR (ecase IN ('con', '75con') AND shift > 0))
"""


@query("counter_shifts", _CELLS + _COUNTER + """
SELECT model, count(*) AS n_counter, round(avg(abs(shift)), 6) AS mean_abs_counter_shift FROM ctr GROUP BY model
""")
def q_counter_shifts(spark, sf_dir):
    return SF.counter_shifts(_sh(spark, sf_dir))


@query("top_counter_shifts", _CELLS + _COUNTER + """
, r AS (SELECT model, issue, ecase, shift, row_number() OVER (PARTITION BY model ORDER BY abs(shift) DESC, issue, ecase)
          AS rank FROM ctr)
SELECT model, issue, ecase, round(shift, 6) AS shift, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2
""")
def q_top_counter_shifts(spark, sf_dir):
    """Two largest counter-directional shifts per model (top-k report)."""
    rows = SF.counter_shift_rows(_sh(spark, sf_dir)).select("model", "issue", "ecase", "shift")
    return SF.top_n(rows, ["model"], [F.abs("shift").desc(), F.col("issue"), F.col("ecase")], 2)


@query("rigid_issues", _CELLS + """
SELECT issue, round(max(abs(shift)), 6) AS max_abs_shift FROM sh GROUP BY issue HAVING max(abs(shift)) < 0.3
""")
def q_rigid_issues(spark, sf_dir):
    return SF.rigid_issues(_sh(spark, sf_dir))


@query("movable_issues", _CELLS + """
, g AS (SELECT model, issue, avg(abs(shift)) AS mean_abs_shift FROM sh GROUP BY model, issue),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mean_abs_shift DESC, issue) AS rank FROM g)
SELECT model, issue, round(mean_abs_shift, 6) AS mean_abs_shift, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")
def q_movable_issues(spark, sf_dir):
    """Five issues with the largest mean absolute shift per model (top-k report)."""
    return SF.movable_issues(_sh(spark, sf_dir), 5)


@query("model_disagreement", _CELLS + """
, long AS (SELECT model, issue, ecase, 'con' AS issue_stance, con_share AS share FROM cells
           UNION ALL SELECT model, issue, ecase, 'other', other_share FROM cells
           UNION ALL SELECT model, issue, ecase, 'pro', pro_share FROM cells),
pr AS (SELECT a.issue, a.ecase, a.issue_stance, avg(abs(a.share - b.share)) AS avg_d,
         var_pop(abs(a.share - b.share)) AS var_d
       FROM long a JOIN long b ON a.issue = b.issue AND a.ecase = b.ecase AND a.issue_stance = b.issue_stance
         AND a.model < b.model GROUP BY 1, 2, 3),
g AS (SELECT issue, ecase, issue_stance, count(*) AS n_models, max(share) - min(share) AS rng,
        arg_min(model, (-share, model)) AS amax, arg_min(model, (share, model)) AS amin
      FROM long GROUP BY 1, 2, 3)
SELECT g.issue, g.ecase, g.issue_stance, g.n_models,
  round(CASE WHEN n_models >= 2 THEN rng END, 6) AS max_diff,
  CASE WHEN n_models >= 2 THEN amax END AS diff_models_max, CASE WHEN n_models >= 2 THEN amin END AS diff_models_min,
  round(CASE WHEN n_models >= 3 AND n_models = (SELECT count(DISTINCT model) FROM cells) THEN avg_d END, 6)
    AS average_model_diff,
  round(CASE WHEN n_models >= 3 AND n_models = (SELECT count(DISTINCT model) FROM cells) THEN var_d END, 6)
    AS variance_model_diff
FROM g LEFT JOIN pr USING (issue, ecase, issue_stance)
""")
def q_model_disagreement(spark, sf_dir):
    """Closed-form pairwise statistics; the oracle enumerates model pairs."""
    return SF.model_disagreement(_cells(spark, sf_dir))


# The study's three case sets for model-pair comparisons.
_CASE_SETS = {"neither_all": ("neither", "all"), "mixed": ("75pro", "75con"), "one_sided": ("pro", "con")}


@query("pair_agreement", _CELLS + """
, sets AS (SELECT * FROM (VALUES ('neither_all', 'neither'), ('neither_all', 'all'), ('one_sided', 'pro'),
             ('one_sided', 'con'), ('mixed', '75pro'), ('mixed', '75con')) v(case_set, ecase)),
x AS (SELECT s.case_set, c.ecase, c.issue, c.model, c.pro_share FROM cells c JOIN sets s USING (ecase))
SELECT a.case_set, a.model AS model_a, b.model AS model_b, round(corr(a.pro_share, b.pro_share), 6) AS pearson_r,
  count(*) AS n
FROM x a JOIN x b ON a.case_set = b.case_set AND a.ecase = b.ecase AND a.issue = b.issue AND a.model < b.model
GROUP BY 1, 2, 3
""")
def q_pair_agreement(spark, sf_dir):
    """Model-pair pro-share correlation on three case sets."""
    return SF.pair_agreement(_cells(spark, sf_dir), _CASE_SETS)


@query("low_disagreement", _CELLS + """
SELECT issue, round(max(pro_share) - min(pro_share), 6) AS max_pairwise_diff, round(avg(pro_share), 6) AS mean_pro_share,
  round(avg(con_share), 6) AS mean_con_share, count(*) AS n_models
FROM cells WHERE ecase = 'neither' GROUP BY issue
HAVING count(*) >= 2 AND max(pro_share) - min(pro_share) < 0.1
""")
def q_low_disagreement(spark, sf_dir):
    return SF.low_disagreement(_cells(spark, sf_dir))


@query("decided_split", _CELLS + """
SELECT issue, round((sum(pro) + sum(con)) / (sum(pro) + sum(con) + sum(other)), 6) AS decided_share,
  round(sum(other) / (sum(pro) + sum(con) + sum(other)), 6) AS other_share,
  CAST(sum(pro) + sum(con) + sum(other) AS BIGINT) AS n
FROM cells GROUP BY issue
""")
def q_decided_split(spark, sf_dir):
    return SF.decided_split(_cells(spark, sf_dir))


@query("decided_summary", _CELLS + """
, d AS (SELECT (sum(pro) + sum(con)) / (sum(pro) + sum(con) + sum(other)) AS decided, sum(other) / (sum(pro) + sum(con) + sum(other)) AS other
        FROM cells GROUP BY issue),
l AS (SELECT 'decided' AS share, decided AS value FROM d UNION ALL SELECT 'other', other FROM d)
SELECT share, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(max(value), 6) AS max, round(min(value), 6) AS min
FROM l GROUP BY share
""")
def q_decided_summary(spark, sf_dir):
    return SF.decided_summary(SF.decided_split(_cells(spark, sf_dir)))


@query("top_disagreement", _CELLS + """
, long AS (SELECT model, issue, 'con' AS issue_stance, con_share AS share FROM cells WHERE ecase = 'neither'
           UNION ALL SELECT model, issue, 'other', other_share FROM cells WHERE ecase = 'neither'
           UNION ALL SELECT model, issue, 'pro', pro_share FROM cells WHERE ecase = 'neither'),
g AS (SELECT issue, issue_stance, round(max(share) - min(share), 12) AS rng FROM long GROUP BY 1, 2 HAVING count(*) >= 2),
t AS (SELECT * FROM g ORDER BY rng DESC, issue, issue_stance LIMIT 25)
SELECT issue, round(max(rng), 6) AS max_diff, count(*) AS n_rows FROM t GROUP BY issue
""")
def q_top_disagreement(spark, sf_dir):
    """Issues of the 25 largest baseline ranges across models."""
    return SF.top_disagreement(SF.model_disagreement(_cells(spark, sf_dir)))


@query("issue_split", _CELLS + """
, h AS (SELECT issue, count(DISTINCT model) FILTER (WHERE ecase = 'neither' AND model IN ('m0', 'm1', 'm2', 'm3')) = 4 AS has_all FROM cells GROUP BY issue)
SELECT issue, has_all, CAST(row_number() OVER (ORDER BY has_all DESC, issue) AS INTEGER) AS position FROM h
""")
def q_issue_split(spark, sf_dir):
    """Issues that all of four models answered at baseline come first."""
    return SF.issue_split(_cells(spark, sf_dir), ["m0", "m1", "m2", "m3"])


@query("one_sided_gap", _CELLS + """
, g AS (SELECT model, issue,
          max(pro_share) FILTER (WHERE ecase = 'pro') - max(pro_share) FILTER (WHERE ecase = '75pro') AS pro_gap,
          max(con_share) FILTER (WHERE ecase = 'con') - max(con_share) FILTER (WHERE ecase = '75con') AS con_gap
        FROM cells GROUP BY model, issue),
l AS (SELECT model, issue, 'pro' AS track, pro_gap AS gap FROM g UNION ALL SELECT model, issue, 'con', con_gap FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY model, track ORDER BY gap DESC, issue) AS rank FROM l
      WHERE gap IS NOT NULL)
SELECT model, issue, track, round(gap, 6) AS gap, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""")
def q_one_sided_gap(spark, sf_dir):
    """Top five one-sided minus 75 % gaps per model and track (top-k report)."""
    return SF.one_sided_gap(_cells(spark, sf_dir), 5)


@query("near_even_flips", _CELLS + """
, g AS (SELECT model, issue, max(pro_share) FILTER (WHERE ecase = 'neither') AS base_pro,
          max(pro_share) FILTER (WHERE ecase = 'pro') AS pro_case_pro,
          max(con_share) FILTER (WHERE ecase = 'con') AS con_case_con FROM cells GROUP BY model, issue)
SELECT model, issue, round(base_pro, 6) AS base_pro, round(pro_case_pro, 6) AS pro_case_pro,
  round(con_case_con, 6) AS con_case_con FROM g
WHERE base_pro BETWEEN 0.45 AND 0.55 AND pro_case_pro > 0.9 AND con_case_con > 0.9
""")
def q_near_even_flips(spark, sf_dir):
    return SF.near_even_flips(_cells(spark, sf_dir))


@query("undecided_issues", _CELLS + """
SELECT model, issue, round(other_share, 6) AS other_share,
  other_share >= pro_share AND other_share >= con_share AS other_is_top
FROM cells WHERE ecase = 'neither' AND ((other_share >= pro_share AND other_share >= con_share) OR other_share > 0.3)
""")
def q_undecided_issues(spark, sf_dir):
    return SF.undecided_issues(_cells(spark, sf_dir))


@query("wilson_shares", _CELLS + """
, g AS (SELECT model, ecase, CAST(sum(pro) AS BIGINT) AS pro, CAST(sum(con) AS BIGINT) AS con,
          CAST(sum(other) AS BIGINT) AS other FROM cells GROUP BY model, ecase),
w AS (SELECT *, pro + con AS dec, pro + con + other AS tot, 1.959963984540054 AS z FROM g)
SELECT model, ecase, pro, con, other, round(pro / dec, 6) AS pro_share,
  round(((pro / dec) + z * z / (2 * dec)) / (1 + z * z / dec)
        - z * sqrt((pro / dec) * (1 - pro / dec) / dec + z * z / (4 * dec * dec)) / (1 + z * z / dec), 6) AS pro_ci_low,
  round(((pro / dec) + z * z / (2 * dec)) / (1 + z * z / dec)
        + z * sqrt((pro / dec) * (1 - pro / dec) / dec + z * z / (4 * dec * dec)) / (1 + z * z / dec), 6) AS pro_ci_high,
  round(other / tot, 6) AS other_share,
  round(((other / tot) + z * z / (2 * tot)) / (1 + z * z / tot)
        - z * sqrt((other / tot) * (1 - other / tot) / tot + z * z / (4 * tot * tot)) / (1 + z * z / tot), 6) AS other_ci_low,
  round(((other / tot) + z * z / (2 * tot)) / (1 + z * z / tot)
        + z * sqrt((other / tot) * (1 - other / tot) / tot + z * z / (4 * tot * tot)) / (1 + z * z / tot), 6) AS other_ci_high
FROM w
""")
def q_wilson_shares(spark, sf_dir):
    return SF.wilson_shares(_cells(spark, sf_dir))


@query("baseline_pro_gt_con", _CELLS + """
, g AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE pro_share > con_share) AS k FROM cells WHERE ecase = 'neither' GROUP BY model)
SELECT model, n AS n_issues, k AS n_pro_gt_con, round(k / n, 6) AS pro_gt_con_pct, round(""" + binomial_half_sql("k", "n") + """, 6) AS p_value
FROM g
""")
def q_baseline_pro_gt_con(spark, sf_dir):
    return SF.baseline_pro_gt_con(_cells(spark, sf_dir))


@query("dispersion_categories", _CELLS + """
, per AS (SELECT issue, round(avg(pro_share), 9) AS mean_pro, round(coalesce(var_samp(CAST(pro AS DOUBLE)), 0.0), 9) AS var_pro
          FROM cells WHERE ecase = 'neither' GROUP BY issue),
q AS (SELECT quantile_cont(var_pro, 0.2) AS v20, quantile_cont(var_pro, 0.8) AS v80,
        quantile_cont(mean_pro, 0.2) AS m20, quantile_cont(mean_pro, 0.8) AS m80 FROM per)
SELECT count(*) FILTER (WHERE var_pro < v20) AS unanimous_low_variance,
  count(*) FILTER (WHERE var_pro < v20 AND (mean_pro > m80 OR mean_pro < m20)) AS unanimous_and_consistent,
  count(*) FILTER (WHERE var_pro > v80) AS strong_disagreement
FROM per CROSS JOIN q
""")
def q_dispersion_categories(spark, sf_dir):
    return SF.dispersion_categories(_cells(spark, sf_dir))


@query("other_drop", _CELLS + """
, g AS (SELECT model, issue, max(other) FILTER (WHERE ecase = 'neither') AS other_neither,
          max(total) FILTER (WHERE ecase = 'neither') AS total_neither,
          max(other) FILTER (WHERE ecase = 'all') AS other_all, max(total) FILTER (WHERE ecase = 'all') AS total_all
        FROM cells GROUP BY model, issue)
SELECT model, issue, other_neither, total_neither, other_all, total_all,
  round(other_all / total_all - other_neither / total_neither, 6) AS other_shift
FROM g WHERE total_neither IS NOT NULL AND total_all IS NOT NULL
""")
def q_other_drop(spark, sf_dir):
    return SF.other_drop(_cells(spark, sf_dir))


@query("fisher_drop", _CELLS + f"""
, g AS (SELECT model, issue, max(other) FILTER (WHERE ecase = 'neither') AS other_neither,
          max(total) FILTER (WHERE ecase = 'neither') AS total_neither,
          max(other) FILTER (WHERE ecase = 'all') AS other_all, max(total) FILTER (WHERE ecase = 'all') AS total_all
        FROM cells GROUP BY model, issue)
SELECT model, issue, other_neither, total_neither, other_all, total_all,
  round(other_all / total_all - other_neither / total_neither, 6) AS other_shift,
  round({hypergeometric_less_sql("other_all", "(total_all - other_all)", "other_neither", "(total_neither - other_neither)")}, 6) AS p_value
FROM g WHERE total_neither IS NOT NULL AND total_all IS NOT NULL
""")
def q_fisher_drop(spark, sf_dir):
    """One-sided Fisher test that 'other' drops from baseline to all-evidence, per (model, issue)."""
    from sway.functions.stats import fisher_less
    d = SF.other_drop(_cells(spark, sf_dir))
    a, b = F.col("other_all"), F.col("total_all") - F.col("other_all")
    c, e = F.col("other_neither"), F.col("total_neither") - F.col("other_neither")
    return d.withColumn("p_value", fisher_less(a, b, c, e))


# ---- smaller shift-family items ----

@query("balanced_baseline", _CELLS + """
SELECT issue, count(DISTINCT model) AS n_models, min(pro_share) AS _mn FROM cells WHERE ecase = 'neither'
GROUP BY issue HAVING bool_and(pro_share BETWEEN 0.3 AND 0.7)
""".replace(", min(pro_share) AS _mn", ""))
def q_balanced_baseline(spark, sf_dir):
    """Issues where every model's baseline pro share lies in [0.3, 0.7]."""
    b = _cells(spark, sf_dir).filter(F.col("ecase") == "neither")
    g = b.groupBy("issue").agg(F.countDistinct("model").alias("n_models"),
                               F.bool_and(F.col("pro_share").between(0.3, 0.7)).alias("_all"))
    return g.filter("_all").drop("_all")


@query("nonsignificant_shifts", SHIFT_TESTS + f"""
SELECT {_TEST_COLUMNS}, p_value < 0.05 AS significant, {marker_sql("p_value")} AS sig FROM tests
WHERE p_value >= 0.05 OR p_value IS NULL
""")
def q_nonsignificant_shifts(spark, sf_dir):
    """Shift tests with p >= 0.05, with star markers."""
    from sway.functions.stats import p_marker
    st = shift.shift_statistics(_shares(spark, sf_dir))
    st = st.withColumn("significant", F.col("p_value") < 0.05).withColumn("sig", p_marker(F.col("p_value")))
    return st.filter(~F.col("significant") | F.col("p_value").isNull())


@query("shift_vs_recency", """
WITH d AS (
  SELECT c.model, c.ecase, c.pro_share - b.pro_share AS pro_shift
  FROM trial_shares c JOIN trial_shares b
    ON c.model = b.model AND c.issue = b.issue AND c.trial_num = b.trial_num
  WHERE c.ecase <> 'neither' AND b.ecase = 'neither'),
s AS (SELECT model, ecase, avg(pro_shift) AS mean_pro_shift, count(*) AS n_trials FROM d GROUP BY model, ecase),
oc AS (SELECT model, ecase, count(*) AS n, count(*) FILTER (WHERE issue_stance = last_argument) AS agreed
       FROM trials WHERE ecase IN ('all', '75/25', '75pro', '75con', 'con', 'pro') AND last_argument IS NOT NULL
         AND issue <> 'unknown' GROUP BY model, ecase)
SELECT s.model, s.ecase, round(mean_pro_shift, 6) AS mean_pro_shift, n_trials, round(agreed / n, 6) AS recency_rate
FROM s JOIN oc USING (model, ecase)
""")
def q_shift_vs_recency(spark, sf_dir):
    """Paired shift statistics joined with the recency rate on (model, case)."""
    from sway.operators import order
    from sway.session import materialize
    t = fx.trials(spark, sf_dir)
    # one scan: counts at the finest grain both statistics need, then two roll-ups
    base = materialize(t.groupBy("model", "ecase", "issue", "trial_num", "last_argument", "issue_stance")
                       .agg(F.count(F.lit(1)).alias("n")))
    s = shift.paired_shift(shares.trial_shares(base, weight="n")).select("model", "ecase", "mean_pro_shift", "n_trials")
    r = order.recency_rate(order.order_counts(base, weight="n")).select("model", "ecase", "recency_rate")
    return s.join(r, ["model", "ecase"])


@query("other_shift_summary", _CELLS + """
, p AS (SELECT a.model, a.other_share - n.other_share AS d FROM cells a JOIN cells n
        ON a.model = n.model AND a.issue = n.issue AND a.ecase = 'all' AND n.ecase = 'neither')
SELECT model, round(avg(d), 6) AS mean_other_shift, round(stddev_samp(d), 6) AS sd_other_shift, count(*) AS n_issues
FROM p GROUP BY model
""")
def q_other_shift_summary(spark, sf_dir):
    """Per model, over issues: mean and sd of the 'other' share change all-evidence vs baseline."""
    c = _cells(spark, sf_dir)
    a = c.filter(F.col("ecase") == "all").select("model", "issue", F.col("other_share").alias("oa"))
    n = c.filter(F.col("ecase") == "neither").select("model", "issue", F.col("other_share").alias("on"))
    d = a.join(n, ["model", "issue"]).withColumn("d", F.col("oa") - F.col("on"))
    return d.groupBy("model").agg(F.avg("d").alias("mean_other_shift"), F.stddev_samp("d").alias("sd_other_shift"),
                                  F.count(F.lit(1)).alias("n_issues"))


@query("other_shift_ttest", _CELLS + f"""
, p AS (SELECT a.model, a.other_share - n.other_share AS d FROM cells a JOIN cells n
        ON a.model = n.model AND a.issue = n.issue AND a.ecase = 'all' AND n.ecase = 'neither'),
st AS (SELECT model, avg(d) AS m, stddev_samp(d) AS sd, count(*) AS n FROM p GROUP BY model),
{t_quantile_ctes("SELECT DISTINCT (n - 1)::DOUBLE AS v FROM st WHERE n > 1")},
o AS (SELECT *, {paired_t_sql("m", "sd", "n")} AS p_value, coalesce(q * sd / sqrt(n), 0) AS half FROM st LEFT JOIN tq ON tq.v = st.n - 1)
SELECT model, round(m, 6) AS mean_other_shift, n AS n_issues, round(p_value, 6) AS p_value, round(m - half, 6) AS ci_low,
  round(m + half, 6) AS ci_high, {marker_sql("p_value")} AS marker FROM o
""")
def q_other_shift_ttest(spark, sf_dir):
    """Paired t test over issues of the 'other' share, all vs neither, with the 95 % interval
    and marker."""
    from sway.functions.stats import p_marker, paired_t_p, t_margin
    s = q_other_shift_summary(spark, sf_dir)
    m, sd, n = F.col("mean_other_shift"), F.col("sd_other_shift"), F.col("n_issues")
    half = F.coalesce(t_margin(sd, n), F.lit(0.0))
    p = paired_t_p(m, sd, n)
    return s.select("model", "mean_other_shift", "n_issues", p.alias("p_value"), (m - half).alias("ci_low"),
                    (m + half).alias("ci_high"), p_marker(p).alias("marker"))


@query("contradiction_tracks", SHIFT_TESTS + """
SELECT a.model, t.track, round(a.mean_pro_shift, 6) AS "start", round(b.mean_pro_shift, 6) AS "end",
  round(a.ci_lower, 6) AS start_low, round(a.ci_upper, 6) AS start_high, round(b.ci_lower, 6) AS end_low, round(b.ci_upper, 6) AS end_high
FROM (VALUES ('pro', 'pro', '75pro'), ('con', 'con', '75con')) t(track, s, e)
JOIN tests a ON a.ecase = t.s JOIN tests b ON b.ecase = t.e AND b.model = a.model
""")
def q_contradiction_tracks(spark, sf_dir):
    """Start (one-sided case) and end (75 % case) of the mean shift with their 95 % intervals
    per model and track: a multi-value pivot of the shift statistics by case."""
    st = shift.shift_statistics(_shares(spark, sf_dir))
    vals = ("mean_pro_shift", "ci_lower", "ci_upper")
    wide = st.groupBy("model").agg(*[F.max(F.when(F.col("ecase") == c, F.col(v))).alias(f"{v}@{c}")
                                     for c in ("pro", "75pro", "con", "75con") for v in vals])
    rows = []
    for track, start, end in (("pro", "pro", "75pro"), ("con", "con", "75con")):
        rows.append(wide.select(
            "model", F.lit(track).alias("track"), F.col(f"`mean_pro_shift@{start}`").alias("start"),
            F.col(f"`mean_pro_shift@{end}`").alias("end"), F.col(f"`ci_lower@{start}`").alias("start_low"),
            F.col(f"`ci_upper@{start}`").alias("start_high"), F.col(f"`ci_lower@{end}`").alias("end_low"),
            F.col(f"`ci_upper@{end}`").alias("end_high")))
    out = rows[0].unionByName(rows[1])
    return out.filter(F.col("start").isNotNull() & F.col("end").isNotNull())



def _all_vs_neither_sql() -> str:
    from sway.sources.themes import theme_pairs
    slugs = ", ".join("'" + x + "'" for x, _ in theme_pairs())
    n = len(theme_pairs())
    removed = ", ".join("'" + x + "'" for x in SF.REMOVED_ISSUES)
    return _CELLS + f"""
, sl AS (SELECT *, [{slugs}][(CAST(regexp_extract(issue, '(\\d+)$', 1) AS INTEGER) * 5) % {n} + 1] AS slug FROM cells),
g AS (SELECT model, issue, slug, max(pro_share) FILTER (WHERE ecase = 'neither') AS neither_pro,
        max(pro_share) FILTER (WHERE ecase = 'all') AS all_pro FROM sl WHERE slug NOT IN ({removed})
      GROUP BY model, issue, slug)
SELECT model, issue, slug, round(neither_pro, 6) AS neither_pro, round(all_pro, 6) AS all_pro,
  round(all_pro - neither_pro, 6) AS shift FROM g WHERE neither_pro IS NOT NULL AND all_pro IS NOT NULL
"""


@query("all_vs_neither", _all_vs_neither_sql())
def q_all_vs_neither(spark, sf_dir):
    """All-evidence vs no-evidence pro share per (model, issue), leaving out the study's
    excluded issues (fixture issue-N carries the study topic slug of the theme table)."""
    from sway.plans.q_omind import _fixture_slug
    c = _cells(spark, sf_dir).withColumn("slug", _fixture_slug(F.col("issue")))
    return SF.all_vs_neither(c)



@query("pair_outliers", _CELLS + """
, sets AS (SELECT * FROM (VALUES ('neither_all', 'neither'), ('neither_all', 'all'), ('one_sided', 'pro'),
             ('one_sided', 'con'), ('mixed', '75pro'), ('mixed', '75con')) v(case_set, ecase)),
x AS (SELECT s.case_set, c.ecase, c.issue, c.model, c.pro_share FROM cells c JOIN sets s USING (ecase)),
p AS (SELECT a.case_set, a.ecase, a.issue, a.model AS model_a, b.model AS model_b, a.pro_share AS share_a,
        b.pro_share AS share_b, abs(a.pro_share - b.pro_share) AS diff
      FROM x a JOIN x b ON a.case_set = b.case_set AND a.ecase = b.ecase AND a.issue = b.issue AND a.model < b.model),
r AS (SELECT *, row_number() OVER (PARTITION BY case_set, model_a, model_b ORDER BY diff DESC, ecase, issue) AS rank FROM p)
SELECT case_set, ecase, issue, model_a, model_b, round(share_a, 6) AS share_a, round(share_b, 6) AS share_b,
  round(diff, 6) AS diff, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
""")
def q_pair_outliers(spark, sf_dir):
    """Ten cells of largest pro-share disagreement per model pair and case set (top-k report)."""
    return SF.pair_outliers(_cells(spark, sf_dir), _CASE_SETS, 10)
