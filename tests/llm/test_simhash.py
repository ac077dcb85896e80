"""SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import xxhash

from sway.llm import simhash
from sway.llm.components import components


def brute_fp(text, k=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids_fps, radius=4):
    ids = list(ids_fps)
    comp = {i: i for i in range(len(ids))}

    def find(n):
        while comp[n] != n:
            n = comp[n]
        return n
    for i in range(len(ids)):
        for j in range(i):
            if (ids[i][1] ^ ids[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    small = {}
    for i, (d, _) in enumerate(ids):
        if d is not None:
            small[find(i)] = min(small.get(find(i), d), d)
    return sorted((-1 if d is None else d, f, small.get(find(i), -1)) for i, (d, f) in enumerate(ids))


def test_fingerprint_is_the_contract():
    rng = random.Random(0)
    for n in (0, 1, 2, 3, 4, 5, 9, 400):
        t = " ".join(rng.choice(["The", "über", "É", "of\n", "\x1c", "a b", "IN\t"]) for _ in range(n))
        assert simhash.fingerprint(t) == brute_fp(t)
    assert simhash.fingerprint(None) == 0 and simhash.fingerprint(" \n\x0b") == 0


def test_tiles_lose_no_link(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 64, 150, np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    got = {(int(a), int(b)) for x, y in simhash.links(fps, fps, 4) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4}
    assert got == want


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 5)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(n):
        root.setdefault(n, n)
        while root[n] != n:
            n = root[n]
        return n
    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_match_brute_force(docs, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 5)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = []
    for i in range(60):
        t = [word() for _ in range(rng.randrange(0, 90))]
        rows.append((i * 3, " ".join(t)))
        for _ in range(rng.randrange(0, 3)):
            u = list(t)
            if u:
                u[rng.randrange(len(u))] = word()
            rows.append((1000 + len(rows), " ".join(u)))
    rows += [(5000, None), (5001, ""), (None, "a b c d e"), (5002, "a b c d e"), (None, "only null key " * 3), (9, rows[0][1]), (9, rows[0][1])]
    rows.append((5003, "long text here " * 20000))
    out = simhash.near_duplicates(docs(rows, fp=1, root="x", component_id=0)).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["fp"] % 2 ** 64, -1 if r["component_id"] is None else r["component_id"]) for r in out)
    assert got == brute_components([(d, brute_fp(t)) for d, t in rows])
    assert simhash.near_duplicates(docs([])).count() == 0
