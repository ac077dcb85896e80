"""Open-mindedness scoring rules on a hand-built stance table (ties, 'other', weights)."""

import math

from sway.operators import openmind as om
from sway.operators import shares


def _counts(spark, rows):
    return spark.createDataFrame(rows, "issue string, issue_stance string, count long, ecase string, model string")


def test_scores_weights_ties_and_flips(spark):
    rows = []
    for case, (p, c, o) in {"neither": (6, 3, 1), "pro": (9, 1, 0), "con": (2, 8, 0), "75pro": (5, 5, 0),
                            "75con": (0, 3, 7), "all": (4, 4, 2)}.items():
        rows += [("i", "pro", p, case, "m"), ("i", "con", c, case, "m"), ("i", "other", o, case, "m")]
    s = om.scores(shares.stance_share_grid(_counts(spark, rows)))
    got = {r["variant"]: r for r in s.collect()}
    w = got["weighted_binary_flip_original"]
    e = got["even_weight_binary_flip"]
    assert w["baseline_stance"] == "pro" and math.isclose(w["baseline_share"], 0.6)
    # con flips by .2 (w1), 75pro ties -> con by .1 (w2), 75con -> other by .1 (w2), all ties -> con by .2 (w3)
    assert math.isclose(w["open_mindedness_score"], 1.2 / 9 * 100)
    assert math.isclose(e["open_mindedness_score"], 0.6 / 5 * 100)
    assert w["num_contributing_cases"] == 4


def test_baseline_skips_other(spark):
    rows = [("i", "other", 5, "neither", "m"), ("i", "pro", 3, "neither", "m"), ("i", "con", 2, "neither", "m"),
            ("i", "con", 9, "pro", "m"), ("i", "pro", 1, "pro", "m")]
    s = om.scores(shares.stance_share_grid(_counts(spark, rows))).filter("variant = 'even_weight_binary_flip'")
    r = s.first()
    assert r["baseline_stance"] == "pro" and math.isclose(r["baseline_share"], 0.3)
    assert math.isclose(r["open_mindedness_score"], abs(0.9 - 0.3) / 5 * 100)


def test_zero_filled_model_scores_zero(spark):
    rows = [("i", "pro", 6, "neither", "a"), ("i", "con", 4, "con", "a"), ("j", "pro", 1, "neither", "b")]
    s = om.scores(shares.stance_share_grid(_counts(spark, rows))).filter("model = 'b' AND issue = 'i'")
    assert s.count() == 2 and all(r["open_mindedness_score"] == 0.0 for r in s.collect())


def test_details_sum_to_weighted_score(spark, sf_dir):
    from pyspark.sql import functions as F
    from sway.sources import fixtures as fx
    counts = shares.stance_counts(fx.trials(spark, sf_dir))
    grid = shares.stance_share_grid(counts)
    d = om.score_details(grid).select("model", "issue", F.aggregate(
        "details", F.lit(0.0), lambda acc, x: acc + x["weighted_score"]).alias("raw"), "num_contributing_cases")
    s = om.scores(grid).filter("variant = 'weighted_binary_flip_original'")
    j = s.join(d, ["model", "issue"], "left").collect()
    assert j
    for r in j:
        raw = r["raw"] or 0.0
        assert math.isclose(raw / 9 * 100, r["open_mindedness_score"], rel_tol=1e-9, abs_tol=1e-12)
