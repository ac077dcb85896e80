"""Mixing against a plain Python version: recursive budgets, sorted epochs."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sway.llm import mixing


def share(nodes, total):
    """nodes: {name: (weight, most)} -> what each gets."""
    out, left, open_ = {}, total, dict(nodes)
    while open_:
        rate = left / sum(w for w, _ in open_.values())
        full = [n for n, (w, m) in open_.items() if m <= rate * w]
        if not full:
            return out | {n: rate * w for n, (w, _) in open_.items()}
        for n in full:
            out[n] = open_[n][1]
            left -= open_.pop(n)[1]
    return out


def brute_budgets(leaves, weights, total, epochs, level=0):
    """leaves: {(domain, lang, source): tokens}."""
    if level == 3:
        return {k: min(total, v * epochs) for k, v in leaves.items()}
    groups = defaultdict(dict)
    for k, v in leaves.items():
        groups[k[level]][k] = v
    nodes = {n: (weights.get(mixing.LEVELS[level], {}).get(n, 1.0), sum(g.values()) * epochs) for n, g in groups.items() if sum(g.values())}
    got = share(nodes, total)
    out = {}
    for n, g in groups.items():
        out |= brute_budgets(g, weights, got.get(n, 0.0), epochs, level + 1)
    return out


def place(key, epoch, seed):
    return int(hashlib.md5(f"{seed}:{epoch}:{'null' if key is None else key}".encode()).hexdigest()[:13], 16)


def brute(rows, weights, total_share, epochs, seed):
    leaves = defaultdict(int)
    for d, t, lang, src in rows:
        leaves[("d" + (src or "-")[0], lang, src)] += len((t or "").split())
    total = total_share * sum(leaves.values())
    out = Counter()
    for leaf, budget in brute_budgets(leaves, weights, total, epochs).items():
        budget = int(budget + 1e-6)
        mine = [(d, len((t or "").split())) for d, t, lang, src in rows if ("d" + (src or "-")[0], lang, src) == leaf]
        whole = budget // max(1, leaves[leaf])
        left = budget - whole * leaves[leaf]
        for d, _ in mine:
            for e in range(whole):
                out[(d, e)] += 1
        seen = 0
        for d, n in sorted(mine, key=lambda x: (place(x[0], whole, seed), -1 if x[0] is None else x[0])):
            if seen < left:
                out[(d, whole)] += 1
            seen += n
    return out


WEIGHTS = {"domain": {"da": 5.0, "db": 1.0}, "lang": {"en": 3.0}, "source": {"a1": 2.0}}


def made():
    rng = random.Random(0)
    return [(i, "w " * rng.randrange(0, 30) + "\n\t é", rng.choice(["en", "en", "de", None]), rng.choice(["a1", "a1", "a1", "a2", "b1", "b2", "c1", None])) for i in range(400)]


def run(df, total_share=1.0, epochs=2):
    domain = F.concat(F.lit("d"), F.substring(F.coalesce("source", F.lit("-")), 1, 1))
    return mixing.mix(df, domain, WEIGHTS, total_share, epochs, 5)


def test_matches_brute_force(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 8)
    rows = made() + [(900, None, "en", "a1"), (901, "", "de", "b1"), (902, "x " * 50_000, "en", "b2"), (None, "a b c", "en", "a1")]
    for total_share, epochs in [(1.0, 2), (.3, 1), (5.0, 3), (0.0, 2)]:
        df = docs(rows, domain="clash", tokens=7, key=1, whole=2)
        got = Counter((r["row"]["doc_id"], r["epoch"]) for r in run(df, total_share, epochs).collect())
        assert got == brute(rows, WEIGHTS, total_share, epochs, 5)
    assert run(docs([])).count() == 0


def test_budgets_fill_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("x", "en", "s1", 10), ("x", "en", "s2", 1000), ("x", "de", "s3", 1000), ("y", "en", "s4", 1000)],
                                   "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, {}, 400.0, 1.0).collect()}
    assert got == {"s1": 10, "s2": 90, "s3": 100, "s4": 200}
    got = {r["source"]: r["budget"] for r in mixing.budgets(leaves, {}, 2900.0, 1.0).collect()}
    assert got == {"s1": 10, "s2": 940, "s3": 950, "s4": 1000}


def test_repeated_keys_are_taken_together(docs):
    rows = made() + [(3, "w w", "en", "a1")] * 4
    taken = Counter((r["row"]["doc_id"], r["epoch"]) for r in run(docs(rows), .5, 1).where("row.doc_id = 3 and row.source = 'a1'").collect())
    assert all(n in (4, 5) for n in taken.values())


def test_weight_zero_leaves_out(docs, spark):
    weights = {"domain": {"y": 0}, "lang": {"de": 0.0}, "source": {"s1": 0, "s2": 3.0}}
    leaves = [("x", "en", "s1", 100), ("x", "en", "s2", 100), ("x", "en", "s3", 100), ("x", "de", "s4", 100), ("y", "en", "s5", 100), ("z", None, None, 100)]
    table = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(table, weights, 300.0, 2).collect()}
    assert got == {"s1": 0, "s2": 112, "s3": 37, "s4": 0, "s5": 0, None: 150}
    got = {r["source"]: r["budget"] for r in mixing.budgets(table, weights, 600.0, 2).collect()}
    assert got == {"s1": 0, "s2": 200, "s3": 200, "s4": 0, "s5": 0, None: 200}
    df = docs([(i, "a b c", "en", s) for i, s in enumerate(["s1", "s2", "s3"] * 5)] + [(99, "", "en", "s1")])
    out = mixing.mix(df, F.lit("x"), weights).collect()
    assert {r["row"]["source"] for r in out} == {"s2", "s3"}
    for wrong in (-1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            mixing.budgets(table, {"source": {"s1": wrong}}, 1.0, 1)
