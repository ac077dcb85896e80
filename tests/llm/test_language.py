"""Language ID: held-out accuracy, calibration, and subwords against a plain loop."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sway.llm import language


def brute(text):
    found, run = [], ""
    runs = []
    for c in (text or "").lower() + " ":
        if c.isalpha():
            run += c
        elif run:
            runs.append(run)
            run = ""

    def bucket(points):
        v = len(points)
        for p in points:
            v = (v * 0x01000193 + p) % 2 ** 32
        return (v * 0x9E3779B1 % 2 ** 32) >> (32 - language.BITS)
    for r in runs:
        marked = [0, *map(ord, r), 0]
        for n in language.ORDERS:
            for i in range(len(marked) - n + 1):
                g = marked[i:i + n]
                if n > 1 or g[0]:
                    found.append(bucket(g))
    return sorted(found)


def test_subwords():
    for t in ["Hello", "a", "ab, cd!", "Ünïcödé ß 漢字 x1y2", "", None, "  ", "123 !", "q" * 50, "İ ﬁ"]:
        assert sorted(language.subwords(t).tolist()) == brute(t), t


@pytest.fixture(scope="module")
def made():
    rng = random.Random(1)
    words = {"xx": ["bala", "koru", "miti", "zelda"], "yy": ["schtrum", "vorgel", "dachtig"], "zz": ["éloi", "queux", "aimant"]}
    return [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randrange(1, 40))), k) for i in range(600) for k in [rng.choice(sorted(words))]]


def test_learns_rejects_and_calibrates(docs, made):
    df = docs(made + [(9000, None, "xx"), (9001, "", "yy"), (9002, "12 !?", "zz"), (None, "bala koru", None), (9003, "miti " * 300_000, None)], score=1, rejected="no")
    model = language.fit(df, ~language.held_out(F.col("doc_id")))
    assert model.languages == ["xx", "yy", "zz"]
    out = {r["doc_id"]: r for r in language.predict(df, model).collect()}
    truth = {d: k for d, _, k in made}
    held = [r[0] for r in df.where(language.held_out(F.col("doc_id"))).select("doc_id").collect() if r[0] in truth]
    assert len(held) > 90 and np.mean([out[d]["lang_pred"] == truth[d] for d in held]) > .98
    for d in (9000, 9001, 9002):
        assert (out[d]["lang_pred"], out[d]["score"], out[d]["rejected"]) == ("und", 0.0, True)
    assert out[9003]["lang_pred"] == "xx" and out[None]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert not any(out[d]["rejected"] for d in truth)
    strange = language.predict(docs([(1, "Ωμέγα άλφα βήτα")]), model).collect()[0]
    assert strange["rejected"] and strange["lang_pred"] in model.languages


def test_no_rows_or_labels(docs):
    empty = language.fit(docs([]), F.lit(True))
    assert language.predict(docs([]), empty).count() == 0
    r = language.predict(docs([(1, "abc")]), language.fit(docs([(1, "abc")]), F.lit(True))).collect()[0]
    assert (r["lang_pred"], r["rejected"]) == ("und", True)


def test_held_out_rule(spark):
    import zlib
    rows = spark.range(200).select("id", language.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_threshold_rejects_at_most_its_share():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 4000)
    logits = rng.normal(0, 1, (4000, 3)) + 3 * np.eye(3)[labels]
    t, bar = language.calibrate(logits, labels, .01)
    p = language.softmax(logits / t)
    assert (p.max(axis=1) < bar).mean() <= .01
    assert abs(p.max(axis=1).mean() - (p.argmax(axis=1) == labels).mean()) < .03


def test_even_scores_go_at_any_number_of_rows():
    for classes in (2, 4):
        for n in (1, 100, 750):
            labels = np.arange(n) % classes
            logits = 3 * np.eye(classes)[labels]
            logits[n // 2:n // 2 + (n > 10)] = 0  # a labelled text that says nothing
            _, bar = language.calibrate(logits, labels, language.REJECT)
            assert 1 / classes < bar <= language.softmax(logits).max()
    assert language.calibrate(np.zeros((5, 1)), np.zeros(5, int), language.REJECT)[1] == 1.0


def test_shares():
    s = language.shares({"a": 10 ** 6, "b": 600, "c": 5}, 3000, 8000)
    assert s["c"] == (1.0, 0.0) and s["b"] == (.75, .25)
    assert round(s["a"][0] * 10 ** 6) == 1000 and round(s["a"][1] * 10 ** 6) == 7850


def test_production_defaults_reject(docs):
    """With two languages, labelled one-word texts of letters that no other text has are rejected, and nothing else is."""
    rng = random.Random(2)
    words = {"xx": ["bala", "koru", "miti", "zelda"], "yy": ["schtrum", "vorgel", "dachtig", "wurf"]}
    made = [(i, chr(0x4E00 + i) + "." if i % 500 == 7 else " ".join(rng.choice(words[k]) for _ in range(rng.randrange(8, 14))), k)
            for i in range(17000) for k in [("xx", "yy")[i // 500 % 2]]]
    df = docs(made)
    model = language.fit(df, ~language.held_out(F.col("doc_id")))
    assert model.threshold > .5
    gone = [r["doc_id"] for r in language.predict(df, model).where("rejected").collect()]
    assert 17 <= len(gone) <= 34 and all(d % 500 == 7 for d in gone)
    assert language.predict(docs([(1, "Ωμέγα")]), model).collect()[0]["rejected"]


def test_long_texts_are_not_cut():
    """Pieces change nothing: not at a cut within a word, a surrogate, or a character whose lower case is longer."""
    rng = np.random.default_rng(7)
    text = "".join(rng.choice(list("abcdé ñ\n1\u0130\U0001f600ß"), 400))
    whole = sorted(language.subwords(text).tolist())
    for piece in (1, 2, 3, 7, 64, 399, 402, 403):
        assert sorted(language.subwords(text, piece).tolist()) == whole, piece
    long = "abcdefghij " * 100_000
    assert np.array_equal(np.sort(language.subwords(long)), np.sort(language.subwords(long, len(long) + 2)))
