"""Sharding against a plain Python permutation and the laws of the result."""

import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from sway.llm import sharding


def py_rounds(x, a, b, seed):
    def h(v, key):
        first = xxhash.xxh64_intdigest(struct.pack("<q", v), 42)
        out = xxhash.xxh64_intdigest(struct.pack("<q", key), first)
        return out - 2 ** 64 if out >= 2 ** 63 else out
    left, right = divmod(x, b)
    for i in range(sharding.ROUNDS):
        key = seed * sharding.ROUNDS + i
        if i % 2 == 0:
            left = (left + h(right, key)) % a
        else:
            right = (right + h(left, key)) % b
    return left * b + right


def py_place(x, n, seed=0):
    a, b = sharding.domain(n)
    x = py_rounds(x, a, b, seed)
    while x >= n:
        x = py_rounds(x, a, b, seed)
    return x


def test_permutation_matches_plain_python(spark):
    for n in (1, 2, 7, 23, 1009):
        got = [r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 3)).collect()]
        assert got == [py_place(x, n, 3) for x in range(n)]
        assert sorted(got) == list(range(n))


def test_cycle_walk_is_used(monkeypatch, spark):
    monkeypatch.setattr(sharding, "domain", lambda n: (11, 13))
    got = [r[0] for r in spark.range(100).select(sharding.permuted(F.col("id"), 100, 0)).collect()]
    assert sorted(got) == list(range(100))
    assert got == [py_place(x, 100) for x in range(100)]


def test_shard_laws_and_edges(docs):
    rows = [(i * 7, f"text {i % 5} é") for i in range(50)] + [(None, "x"), (7, None), (7, None), (3, ""), (14, "y" * 50000)]
    out = sharding.shard(docs(rows, shard=1, slot="s", row_no=5), shards=16).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    order = sorted(out, key=lambda r: r["row_no"])
    ids = [r["doc_id"] for r in order]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    for r in order:
        assert r["position"] == py_place(r["row_no"], len(rows)) and r["position"] == r["slot"] * 16 + r["shard"]
    want = sorted((0 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in out) == want


def test_fewer_rows_than_shards_and_empty(docs):
    assert sharding.shard(docs([])).count() == 0
    out = sharding.shard(docs([(1, "a"), (2, "a")])).collect()
    assert sorted(r["slot"] for r in out) == [0, 0] and len({r["shard"] for r in out}) == 2
