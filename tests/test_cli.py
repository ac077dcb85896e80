"""Command-line runner: list queries, run one and write it as CSV."""

import glob
import os
import tempfile

import pandas as pd

from sway.__main__ import main


def test_list_and_run(spark, sf_dir, capsys):
    assert main(["list"]) == 0
    out = capsys.readouterr().out
    assert "paired_shift\toracle" in out and "page_sections\trows-only" in out
    d = tempfile.mkdtemp(prefix="sway-cli-")
    assert main(["run", "paired_shift", "page_topics", "--sf", sf_dir, "--out", d, "--format", "csv"]) == 0
    t = pd.concat(pd.read_csv(p) for p in glob.glob(os.path.join(d, "paired_shift", "*.csv")))
    assert {"model", "ecase", "mean_pro_shift", "sd_shift", "n_trials"} <= set(t.columns) and len(t) > 0
    assert glob.glob(os.path.join(d, "page_topics", "*.csv"))
    assert main(["run", "no_such_query", "--sf", sf_dir, "--out", d]) == 2
