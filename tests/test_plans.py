"""Plan properties of every registered query: one fact-table scan, no cartesian products."""

import re

import pytest

from sway.plans.catalog import load_all

REG = load_all()
EAGER = {"stream_stance_counts", "stream_retry_counts", "batch_ingest", "ridge_cv", "csv_results", "sorted_results", "prompt_lookup"}  # run jobs while building
TWO_PASSES = {"unparsed_sample"}  # total count and top-100 listing


@pytest.mark.parametrize("name", sorted(n for n in REG if n not in EAGER))
def test_plan(name, spark, sf_dir):
    plan = REG[name].build(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    scans = len(re.findall(r"FileScan parquet [^\n]*lineitem\.parquet", plan))
    assert scans <= (2 if name in TWO_PASSES else 1), scans
