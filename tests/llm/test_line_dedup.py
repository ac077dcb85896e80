"""Line dedup against brute force; deletion gives the former state back."""

import random
from collections import Counter

import numpy as np

from sway.llm import line_dedup
from sway.llm.line_dedup import CuckooFilter, LineIndex, dedup_lines

WS = "\x20\x09\x0a\x0b\x0c\x0d"


def norm(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(rows, min_docs=5):
    n, top = Counter(), {}
    for d, t in rows:
        for k in {norm(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                n[k] += 1
                top[k] = max([x for x in (top.get(k), d) if x is not None], default=None)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[norm(x)] < min_docs or top[norm(x)] == d]
        out.append((-1 if d is None else d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def made(seed=0):
    rng = random.Random(seed)
    common = ["Shared line number %d with É and enough characters in it" % i for i in range(12)]
    rows = []
    for d in range(80):
        lines = [rng.choice(common) if rng.random() < .4 else f"own {d} {rng.random()} {'x' * rng.randrange(60)}" for _ in range(rng.randrange(0, 9))]
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < .2 else x) + rng.choice(["", "\r", " \x0b"]) for x in lines]
        rows.append((d * 2, "\n".join(lines)))
    return rows + [(900, None), (901, ""), (None, "\n".join(common[:3])), (5, common[4]), (5, common[4]), (902, "\n" * 5), (903, "z" * 100_000)]


def tuples(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"], r["__n_lines"], r["__n_dropped"]) for r in df.collect())


def test_matches_brute_force_with_and_without_sent_filters(docs, monkeypatch):
    rows = made()
    df = docs(rows, keys=1, hi="x", shard=2)
    assert tuples(dedup_lines(df)) == brute(rows)
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", -1)
    assert tuples(dedup_lines(df)) == brute(rows)
    assert dedup_lines(docs([])).count() == 0
    only = [(None, "q" * 50)] * 6
    assert tuples(dedup_lines(docs(only))) == brute(only)


def state(index):
    refs = sorted((r["hi"], r["lo"], r["n_docs"], r["top_id"] if r["top_id"] is not None else -1) for r in index.refs.collect())
    tags = {r["shard"]: sorted(np.frombuffer(r["slots"], np.uint16)[np.frombuffer(r["slots"], np.uint16) > 0].tolist()) for r in index.filters.collect()}
    return refs, {s: t for s, t in tags.items() if t}


def test_delete_reverses_insert(spark, docs):
    rows = made(1)
    a, b = docs(rows[::2]), docs(rows[1::2])
    one = LineIndex.empty(spark, shards=3).insert(a)
    two = one.insert(b)
    assert tuples(two.rewrite(docs(rows))) == brute(rows)
    back = two.delete(b, a)
    assert state(back) == state(one)
    assert tuples(back.rewrite(a)) == brute(rows[::2])


def test_cuckoo_filter_holds_what_it_got():
    rng = np.random.default_rng(0)
    hi, lo = rng.integers(0, 2 ** 64, (2, 5000), np.uint64)
    f = CuckooFilter.sized(5000)
    assert f.insert(hi, lo) and f.holds(hi, lo).all()
    f.delete(hi[:2500], lo[:2500])
    assert f.holds(hi[2500:], lo[2500:]).all() and f.holds(hi[:2500], lo[:2500]).mean() < .02
    tiny = CuckooFilter(np.zeros((2, 4), np.uint16))
    assert not tiny.insert(hi[:50], lo[:50])


def test_keys_go_to_large_filters(docs, monkeypatch):
    """Where the filters are too large to send, they still decide which keys are joined."""
    rows = made(2)
    df = docs(rows)
    index = LineIndex.empty(df.sparkSession, shards=3).insert(df)
    small = sorted(map(tuple, index._passing(df, "doc_id", "text").collect()), key=repr)
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", -1)
    large = sorted(map(tuple, index._passing(df.repartition(5), "doc_id", "text").collect()), key=repr)
    assert large == small and 0 < len(large) < index._postings(df, "doc_id", "text").count()


def test_index_outgrows_its_shards(spark, docs, monkeypatch):
    """An index begun with few lines gets more shards and the state of one that was filled at once."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    rows = made(3)
    grown = LineIndex.empty(spark).insert(docs(rows[:12])).insert(docs(rows[12:]))
    whole = LineIndex.empty(spark).insert(docs(rows))
    assert grown.shards == whole.shards > 2 and state(grown) == state(whole)
    assert tuples(grown.rewrite(docs(rows))) == brute(rows)
