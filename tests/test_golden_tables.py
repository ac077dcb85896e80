"""Study result tables (read as data) reproduced by the corresponding operators."""

import math
import os  # noqa: F401
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sway.functions import dist
from sway.operators import openmind as om
from sway.operators import sensitivity as S

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import golden  # noqa: E402

pytestmark = pytest.mark.skipif(not golden.available(), reason="set SWAY_STUDY_RESULTS to the study's result tables")


def test_composition_summary_from_topic_table(spark):
    by_topic = golden.one("pairwise_flip_rate", "paraphrase_idx").rename(columns={"case": "ecase"})
    got = S.sensitivity_summary(spark.createDataFrame(by_topic)).toPandas().set_index(["model", "ecase"])
    exp = golden.one("mean_pairwise_flip_rate", "topics").rename(columns={"case": "ecase"}).set_index(["model", "ecase"])
    assert len(got) == len(exp)
    for k, r in exp.iterrows():
        g = got.loc[k]
        assert g["topics"] == r["topics"]
        for c in ("mean_pairwise_flip_rate", "mean_abs_pairwise_delta_p_pro", "max_abs_pairwise_delta_p_pro",
                  "mean_p_pro_variance"):
            assert math.isclose(g[c], r[c], rel_tol=1e-9), (k, c)


def test_rank_layout_and_overlap(spark):
    sets = golden.averages_and_layouts()
    assert len(sets) == 2
    for label, avg, exp, eo in sets:
        _check_ranks(spark, label, avg, exp, eo)


def _check_ranks(spark, suffix, avg, exp, eo):
    avg = avg[["variant", "model", "om_mean"]]
    ranked = om.rankings(spark.createDataFrame(avg))
    layout = om.rank_layout(ranked, sorted(om.VARIANTS, key=lambda v: v.name)).toPandas().sort_values("rank")
    assert [tuple(map(str, r)) for r in layout[exp.columns].itertuples(index=False)] == \
        [tuple(map(str, r)) for r in exp.itertuples(index=False)]
    ov = om.rank_overlap(ranked, suffix).toPandas()
    for c in eo.columns:
        if c == "same_position_pct":
            assert math.isclose(ov[c].iloc[0], eo[c].iloc[0], rel_tol=1e-12)
        else:
            assert str(ov[c].iloc[0]) == str(eo[c].iloc[0]), c


def test_all_order_effect_p_values():
    t = golden.one("agreed_with_last_count", "p_value_vs_50pct")
    got = dist.binom_two_sided_half(t["agreed_with_last_count"].to_numpy(), t["total_trials"].to_numpy())
    for g, e in zip(got, t["p_value_vs_50pct"]):
        assert (e == 0.0 and g < 1e-300) or math.isclose(g, e, rel_tol=1e-6)


def test_all_shift_summary_rows_consistent():
    t = golden.one("mean_pro_shift", "ci_upper", "n_trials")
    n = t["n_trials"].to_numpy(float)
    q = dist.t_quantile(np.full(len(t), 0.975), n - 1)
    se = (t["ci_upper"].to_numpy() - t["mean_pro_shift"].to_numpy()) / q
    p = dist.t_two_sided_p(t["mean_pro_shift"].to_numpy() / se, n - 1)
    for g, e in zip(p, t["p_value"]):
        assert (e == 0.0 and g < 1e-290) or math.isclose(g, e, rel_tol=1e-4)


def test_review_row_ids(spark):
    from sway.operators.judge import row_id
    t = golden.one("row_id", "auto_label", "manual_label")[["row_id", "topic", "paraphrase_idx", "judge_model",
                                                          "auto_label"]]
    df = spark.createDataFrame(t.astype({"paraphrase_idx": "int64"}))
    got = df.select("row_id", row_id(F.col("topic"), F.col("paraphrase_idx"), F.col("judge_model"),
                                     F.col("auto_label")).alias("mine")).toPandas()
    assert len(got) > 0 and (got["row_id"] == got["mine"]).all()
