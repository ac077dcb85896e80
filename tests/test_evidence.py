"""Evidence effects against a direct computation, and the size of what they shuffle and keep."""

import random
from collections import defaultdict

from sway.operators import evidence as EV

ITEMS = [(1, "h1"), (2, "h2"), (2, "h2"), (3, "h1"), (4, None), (4, "h4"), (6, "h6"), (None, "h7")]


def _trials(n: int, questions: int) -> list[tuple]:
    rng = random.Random(5)
    rows = [(f"m{rng.randrange(2)}", "i", rng.randrange(questions), rng.choice(["pro", "con", None]),
             rng.choice([[], None, [1], [2, 3], [4], [5, 1], [6, None]])) for _ in range(n)]
    return rows + [("m0", "lonely", 0, "pro", [1, 2]), (None, "i", 0, "pro", [1]), (None, "i", 0, "con", [])]


def _frames(spark, rows):
    return (spark.createDataFrame(rows, "model string, issue string, question long, issue_stance string, evidence_ids array<long>"),
            spark.createDataFrame(ITEMS, "evidence_id long, evidence_hash string"))


def test_effects_match_a_direct_computation(spark):
    rows = _trials(400, 3)
    shown = defaultdict(lambda: [0, 0])
    for model, issue, q, stance, ids in rows:
        for e in ids or [None]:
            for h in [x for i, x in ITEMS if e is not None and i == e] or [None]:
                cell = shown[model, issue, q, h]
                cell[0] += stance == "pro"
                cell[1] += 1
    want = {}
    for model, h in {(k[0], k[3]) for k in shown if k[3] is not None}:
        cells = [(v, shown.get((*k[:3], None)) if None not in k[:3] else None) for k, v in shown.items() if k[0] == model and k[3] == h]
        known = [v[0] - v[1] * b[0] / b[1] for v, b in cells if b]
        n = sum(v[1] for v, _ in cells)
        want[model, h] = (round(sum(known) / n, 12) if known else None, n)
    got = {(r["model"], r["evidence_hash"]): (r["average_proportion_shift"], r["n_trials"]) for r in EV.evidence_effect(*_frames(spark, rows)).collect()}
    assert got.keys() == want.keys() and (None, "h1") in got
    for k, (shift, n) in want.items():
        assert got[k][1] == n and (got[k][0] is None if shift is None else abs(got[k][0] - shift) < 2e-12), k


def test_nothing_kept_grows_with_the_questions_of_an_item(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(EV, "materialize", lambda df: kept.append(df.cache()) or kept[-1])
    EV.evidence_effect(*_frames(spark, _trials(3000, 200))).collect()
    cells = 2 * 200 + 2  # of the baseline
    assert max(df.count() for df in kept) <= cells + 2 * 7
    for df in kept:
        df.unpersist()
