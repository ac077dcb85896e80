"""Queries: stance counts, trial shares, share grids (build step 1)."""

from __future__ import annotations


from sway.operators import shares
from sway.plans.catalog import query
from sway.sources import fixtures as fx


@query("stance_counts", """
SELECT issue, issue_stance, "count", ecase, model FROM stance_counts
""")
def q_stance_counts(spark, sf_dir):
    return shares.stance_counts(fx.trials(spark, sf_dir))


@query("trial_shares", """
SELECT model, ecase, issue, trial_num, pro, con, other, total,
       round(pro_share, 6) AS pro_share, round(con_share, 6) AS con_share
FROM trial_shares
""")
def q_trial_shares(spark, sf_dir):
    return shares.trial_shares(fx.trials(spark, sf_dir))


@query("share_pivot", """
SELECT model, ecase, issue,
  count(*) FILTER (WHERE issue_stance = 'con') AS con,
  count(*) FILTER (WHERE issue_stance = 'other') AS other,
  count(*) FILTER (WHERE issue_stance = 'pro') AS pro,
  count(*) AS total,
  round(count(*) FILTER (WHERE issue_stance = 'con') / count(*), 6) AS con_share,
  round(count(*) FILTER (WHERE issue_stance = 'other') / count(*), 6) AS other_share,
  round(count(*) FILTER (WHERE issue_stance = 'pro') / count(*), 6) AS pro_share
FROM trials WHERE issue <> 'unknown' GROUP BY model, ecase, issue
""")
def q_share_pivot(spark, sf_dir):
    return shares.share_pivot(fx.trials(spark, sf_dir))


_GRID_SQL = """
WITH c AS (SELECT issue, ecase, issue_stance, model, CAST(sum("count") AS BIGINT) AS n
           FROM stance_counts GROUP BY issue, ecase, issue_stance, model),
keys AS (SELECT DISTINCT issue, ecase, issue_stance FROM c),
models AS (SELECT DISTINCT model FROM c),
g AS (SELECT k.issue, k.ecase, k.issue_stance, m.model, coalesce(c.n, 0) AS n
      FROM keys k CROSS JOIN models m
      LEFT JOIN c ON c.issue = k.issue AND c.ecase = k.ecase AND c.issue_stance = k.issue_stance
                  AND c.model = m.model)
SELECT issue, ecase, issue_stance, model, n,
  round(coalesce(n / nullif(sum(n) OVER (PARTITION BY issue, ecase, model), 0), 0), 6) AS share
FROM g
"""


@query("stance_share_grid", _GRID_SQL)
def q_stance_share_grid(spark, sf_dir):
    return shares.stance_share_grid(shares.stance_counts(fx.trials(spark, sf_dir)), fill_models=True)


@query("observed_share_grid", """
WITH c AS (SELECT issue, ecase, issue_stance, model, CAST(sum("count") AS BIGINT) AS n
           FROM stance_counts GROUP BY issue, ecase, issue_stance, model),
cells AS (SELECT DISTINCT model, issue, ecase FROM c),
st AS (SELECT * FROM (VALUES ('con'), ('other'), ('pro')) v(issue_stance)),
g AS (SELECT x.issue, x.ecase, st.issue_stance, x.model, coalesce(c.n, 0) AS n
      FROM cells x CROSS JOIN st
      LEFT JOIN c ON c.issue = x.issue AND c.ecase = x.ecase AND c.issue_stance = st.issue_stance
                  AND c.model = x.model)
SELECT issue, ecase, issue_stance, model, n,
  round(coalesce(n / nullif(sum(n) OVER (PARTITION BY issue, ecase, model), 0), 0), 6) AS share
FROM g
""")
def q_observed_share_grid(spark, sf_dir):
    return shares.stance_share_grid(shares.stance_counts(fx.trials(spark, sf_dir)), fill_models=False)


@query("case_stack", """
SELECT issue, issue_stance, ecase, CAST(sum("count") AS BIGINT) AS "count" FROM stance_counts
WHERE ecase IN ('neither', 'pro', 'con', 'all') GROUP BY issue, issue_stance, ecase
""")
def q_case_stack(spark, sf_dir):
    return shares.case_stack(shares.stance_counts(fx.trials(spark, sf_dir)))
