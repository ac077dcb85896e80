"""Locate the study's published result tables (read as data) by their column headers.

Set ``SWAY_STUDY_RESULTS`` to a folder holding them; the golden tests are skipped otherwise.
Tables are recognised by the columns they carry, not by file name.
"""

from __future__ import annotations

import glob
import os

import pandas as pd

FOLDER = os.environ.get("SWAY_STUDY_RESULTS", "")


def available() -> bool:
    return bool(FOLDER) and os.path.isdir(FOLDER)


def _all():
    out = []
    for p in sorted(glob.glob(os.path.join(FOLDER, "*.csv"))):
        try:
            out.append((p, pd.read_csv(p)))
        except Exception:  # noqa: BLE001
            continue
    return out


def find(*columns: str) -> list[tuple[str, pd.DataFrame]]:
    """Every table carrying all ``columns``."""
    return [(p, t) for p, t in _all() if set(columns) <= set(t.columns)]


def one(*columns: str, exclude: tuple[str, ...] = ()) -> pd.DataFrame:
    hits = [t for _, t in find(*columns) if not set(exclude) & set(t.columns)]
    assert len(hits) == 1, (columns, len(hits))
    return hits[0]


def stance_count_paths() -> list[str]:
    """Per-model stance-count tables (issue, issue_stance, count, case, model)."""
    return [p for p, _ in find("issue", "issue_stance", "count", "case", "model")]


def averages_and_layouts():
    """(model averages, rank layout, rank overlap) per model set, matched by the overlap's table label."""
    avgs = [t for _, t in find("variant", "model", "om_mean", "n_issues")]
    layouts = [t for _, t in find("rank")]
    overlaps = [t for _, t in find("same_position_count", "matching_models")]
    out = []
    for ov in overlaps:
        n = int(ov["positions_compared"].iloc[0])
        avg = [a for a in avgs if a["model"].nunique() == n]
        lay = [l for l in layouts if len(l) == n]
        if len(avg) == 1 and len(lay) == 1:
            out.append((str(ov["table"].iloc[0]), avg[0], lay[0], ov))
    return out
