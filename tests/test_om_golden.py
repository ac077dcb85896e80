"""Open-mindedness means against the study's published model averages.

The study's four smaller models (ten topics each) were averaged over 104 topics, 94 of them
zero-filled with weight 1 (its pivot quirk).  Their stance-count tables are read as data; the
scores and weighted means must reproduce the published values.
"""

import math
import os
import sys

import pytest
from pyspark.sql import functions as F

from sway.operators import openmind as om
from sway.operators import shares
from sway.sources.study_files import COUNTS_SCHEMA

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import golden  # noqa: E402
# Published om_mean per (variant, model) for these four models.
PUBLISHED = {
    ("even_weight_binary_flip", "grok-3"): 10.941279964811963,
    ("even_weight_binary_flip", "gpt-4o-mini"): 9.30287921005035,
    ("even_weight_binary_flip", "gpt-4o"): 8.214207169562348,
    ("even_weight_binary_flip", "grok-3-mini"): 5.333186716516384,
    ("weighted_binary_flip_original", "grok-3"): 10.470884343767564,
    ("weighted_binary_flip_original", "gpt-4o-mini"): 9.303342240906401,
    ("weighted_binary_flip_original", "gpt-4o"): 7.679055787698848,
    ("weighted_binary_flip_original", "grok-3-mini"): 5.614202282335117,
}


@pytest.mark.skipif(not golden.available(), reason="set SWAY_STUDY_RESULTS to the study's result tables")
def test_published_means(spark):
    paths = golden.stance_count_paths()
    assert len(paths) == 4
    counts = (spark.read.option("header", True).schema(COUNTS_SCHEMA).csv(paths)
              .withColumnRenamed("case", "ecase"))
    s = om.scores(shares.stance_share_grid(counts, fill_models=True))
    n_real = s.select("issue").distinct().count()
    pad = (spark.range(104 - n_real).select(F.concat(F.lit("pad-"), F.col("id").cast("string")).alias("issue"))
           .join(s.select("variant", "model").distinct()))
    pad = pad.select("variant", "model", "issue", F.lit(0.0).alias("open_mindedness_score"))
    rows = s.select("variant", "model", "issue", "open_mindedness_score").unionByName(pad)
    got = {(r["variant"], r["model"]): (r["om_mean"], r["n_issues"])
           for r in om.weighted_moments(rows, counts).collect()}
    for k, v in PUBLISHED.items():
        assert got[k][1] == 104
        assert math.isclose(got[k][0], v, rel_tol=1e-9), (k, got[k][0], v)
