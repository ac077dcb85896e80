"""Base counts against plain Python, binomial tails against exact fractions, and what the cutoffs promise."""

import math
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sway.llm import queries
from sway.llm import quality_rules as rules

TEXTS = [None, "", " \t\n", "one", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x " * 9, "x " * 8, "x " * 500, "w1 w2 w3 w4 w5 w6 w7 w8 w9 " * 3 + "tail of it",
         "line\nline\n\n\nLine\n line\nline", "a\x0bb\x0cc\rd\te", "# * $ % & | < > #*$%&|<>", "é ü \U0001f600  x", "AB c\nAB c\nAB c",
         " ".join(f"v{i}" for i in range(5000)), " ".join(f"v{i % 700}" for i in range(5000)), "p q r s t u v w x p q r s t u v w y q r s t u v w x",
         "".join(chr(97 + i % 26) for i in range(100_000)), "\n".join(["same line of words"] * 40)]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    out = rules.base_counts(docs(rows, n_words=7, base_failed="x", __text="clash", lines=1), ["doc_id"])
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in out.collect()} == {i: brute(t) for i, t in rows}


def test_query_counts(spark, sf_dir):
    out = queries.op13_quality(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(out) == len(texts)
    for r in out:
        assert tuple(r[c] for c in COLUMNS) == brute(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"]) and r["kept"] == (r["rejected_by"] is None)


@pytest.mark.parametrize("rate", [0.02, 0.3])
def test_binomial_tail(spark, rate):
    cases = [(k, n) for n in (1, 2, 7, 20, 21, 64, 300, 2000) for k in sorted({0, 1, 2, 5, 19, 20, 21, int(n * rate) - 1, int(n * rate), n}) if 0 <= k <= n]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", rules.binomial_tail(F.col("k"), F.col("n"), rate).alias("p")).collect()
    assert len(got) == len(cases)
    for k, n, p in got:
        a = Fraction(rate)
        want = float(sum(math.comb(n, i) * a ** i * (1 - a) ** (n - i) for i in range(k + 1))) if k < n * rate else 1.0
        assert math.isclose(p, want, rel_tol=1e-9), (k, n, p, want)


def test_binomial_tail_of_many(spark):
    """A billion trials: the sum is bounded and agrees with the first Edgeworth expansion."""
    n, rate = 10 ** 9, 0.02
    sd = math.sqrt(n * rate * (1 - rate))
    cases = [(int(n * rate - z * sd), n) for z in (1, 2, 4)] + [(0, 0), (5, 0), (0, n)]
    got = [r[0] for r in spark.createDataFrame(cases, "k long, n long").select(rules.binomial_tail(F.col("k"), F.col("n"), rate)).collect()]
    for p, (k, _) in zip(got, cases[:3]):
        x = (k + 0.5 - n * rate) / sd
        skew = (1 - 2 * rate) / (6 * sd) * (x * x - 1) * math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        assert math.isclose(p, math.erfc(-x / math.sqrt(2)) / 2 - skew, rel_tol=1e-4)
    assert got[3:] == [1.0, 1.0, 0.0]


def corpus(n, junk_every=5):
    """Good texts of plain words, and bad ones whose words end in symbols; labels of nine in ten."""
    rows, labels = [], []
    for i in range(n):
        bad = i % junk_every == 0
        words = [f"word{(i * 31 + j * j) % 997}" + ("###" if bad else "") for j in range(30)]
        rows.append((i, " ".join(words), "en"))
        if i % 10:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_rules_catch_junk_and_keep_good(spark, docs):
    rows, labels = corpus(1500)
    rows += [(9000 + i, r[1], "xx") for i, r in enumerate(rows[:60])]  # a stratum that nobody labelled
    rows += [(None, rows[1][1], "en"), (None, rows[0][1], "en"), (1, rows[1][1], "en"), (8000, rows[5][1], None), (8001, None, None)]
    labels += [(3, 0, 0), (None, 0, 0), (123456, 0, 0), (4, None, 1)]  # disagreeing, unknown and null labels
    out = rules.quality(docs(rows, kept="clash", level=3, stratum=None, good=1), spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["lang"] == "en":
            assert r["kept"] == (r["n_symbols"] == 0)
        else:
            assert r["kept"] == (not r["base_failed"])
    assert {r["rejected_by"] for r in out} == {None, "symbols", "base"}


def test_few_labels_certify_nothing(spark, docs):
    rows, labels = corpus(200)
    out = rules.quality(docs(rows), spark.createDataFrame(labels, LABELS))
    assert out.where("not kept").count() == 0
    assert rules.quality(docs(rows), spark.createDataFrame([], LABELS)).where("kept").count() == 200
    assert rules.quality(docs([]), spark.createDataFrame(labels, LABELS)).count() == 0


def test_copies_vote_once(spark, docs):
    """Three hundred copies of twenty labelled texts are twenty votes: too few."""
    rows, labels = corpus(25)
    many = [(i * 100 + k, t, lang) for i, t, lang in rows for k in range(15)]
    marked = [(i * 100 + k, q, 0) for i, q, _ in labels for k in range(15)]
    assert rules.quality(docs(many), spark.createDataFrame(marked, LABELS)).where("not kept").count() == 0


def test_promise_holds_on_random_strata(spark):
    """Scores that say nothing about quality: over 40 strata with 400 good texts each, hardly any stratum's certified
    level may reject more than the risk of the good texts it didn't see."""
    import numpy as np
    rng = np.random.default_rng(4)
    frame = [(s * 10_000 + i, str(s), int(rng.integers(1 << 60)), 100, int(rng.integers(300, 700)), int(rng.integers(0, 40)), 10, 10, 0, 0, False)
             for s in range(40) for i in range(1200)]
    counted = spark.createDataFrame(frame, "doc_id long, lang string, text_hash long, n_words long, word_chars long, n_symbols long, n_capitals long, n_lines long, n_dup_lines long, n_repeat_words long, base_failed boolean")
    labels = spark.createDataFrame([(f[0], int(rng.random() < 0.8), 0) for f in frame if f[0] % 10_000 < 800], LABELS)
    model = rules.fit(counted, labels, risk=0.05)
    unseen = rules.judge(counted.where("doc_id % 10000 >= 800"), model).groupBy("lang").agg(F.avg(F.when(F.col("kept"), 0.0).otherwise(1.0)).alias("rate")).collect()
    assert sum(r["rate"] > 0.05 + 0.04 for r in unseen) <= 2
    for r in model.where("level > 0").collect():
        assert r["p_value"] <= r["limit"] and math.isclose(r["limit"], 0.05 / 40)


def test_native(spark, sf_dir):
    plan = queries.op13_quality(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
