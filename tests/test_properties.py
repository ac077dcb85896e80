"""Properties: shares sum to one, counts add up to the rows, BH is monotone, intervals ordered."""

import math

from pyspark.sql import functions as F

from sway.operators import resample as RS
from sway.operators import shares, shift
from sway.plans.catalog import load_all
from sway.sources import fixtures as fx

REG = load_all()


def test_counts_add_up_and_shares_sum_to_one(spark, sf_dir):
    t = fx.trials(spark, sf_dir)
    assert shares.stance_counts(t).agg(F.sum("count")).first()[0] == t.count()
    s = shares.trial_shares(t).select(
        F.max(F.abs(F.col("pro_share") + F.col("con_share") + F.col("other") / F.col("total") - 1))).first()[0]
    assert s < 1e-12
    g = REG["stance_share_grid"].build(spark, sf_dir).groupBy("issue", "ecase", "model").agg(F.sum("share").alias("s"))
    assert g.filter((F.abs(F.col("s") - 1) > 1e-5) & (F.col("s") != 0)).count() == 0


def test_bh_monotone_and_not_below_p(spark, sf_dir):
    st = shift.shift_statistics(shares.trial_shares(fx.trials(spark, sf_dir)))
    rows = sorted((r["p_value"], r["p_adjusted"]) for r in RS.bh_adjust(st, "p_value", ["model", "ecase"]).collect())
    assert rows
    for (p1, a1), (p2, a2) in zip(rows, rows[1:]):
        assert a1 <= a2 + 1e-15
    assert all(a >= p - 1e-15 and a <= 1.0 for p, a in rows)


def test_bootstrap_bounds_ordered(spark, sf_dir):
    for r in REG["bootstrap_mean_ci"].build(spark, sf_dir).collect():
        assert r["ci_low"] <= r["ci_high"]
    for r in REG["theme_bootstrap"].build(spark, sf_dir).collect():
        assert r["issue_ci_low"] <= r["issue_ci_high"]
        assert not math.isnan(r["mean"])
