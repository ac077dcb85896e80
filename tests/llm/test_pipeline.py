"""The pipeline against brute force, stage by stage, and its edge cases."""

import random
from collections import Counter

from pyspark.sql import functions as F
from test_line_dedup import brute as brute_lines
from test_mixing import brute_budgets, place
from test_simhash import brute_components, brute_fp

import corpus_pipeline
from sway.llm import bpe, language
from sway.llm.queries import MIX_EPOCHS, MIX_SEED, MIX_WEIGHTS


def made():
    rng = random.Random(8)
    words = {"en": ["the", "water", "house", "under", "light"], "de": ["schloss", "dachte", "über", "nicht", "zwölf"], "fr": ["éloi", "queux", "aimant", "sœur", "tant"]}
    shared = ["This line is shared by very many of the documents, number %d" % i for i in range(3)]
    rows = []
    for i in range(220):
        lang = rng.choice(["en", "en", "de", "fr"])
        body = " ".join(rng.choice(words[lang]) + str(rng.randrange(400)) for _ in range(rng.randrange(4, 60)))
        rows.append((i, body + ("\n" + rng.choice(shared) if rng.random() < .3 else ""), lang, rng.choice(["src0", "src0", "src1", "src2", "src5"])))
    rows += [(300 + i, rows[5][1], "en", "src0") for i in range(6)] + [(400 + i, rows[9][1] + " x", "de", "src1") for i in range(3)]
    return rows + [(500, None, "en", "src0"), (501, "", None, None), (502, "12 34 !!", "de", "src2"), (503, "light " * 40_000, "en", None)]


def domain(source):
    if source == "src0":
        return "web"
    return f"group{int(source[3:]) % 3}" if source and source[3:].isdigit() else "other"


def test_run_matches_brute_force(docs, spark, tmp_path):
    rows = made()
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = language.fit(df, ~language.held_out(F.col("doc_id")))
    rest = [r for r in rows if not model.predict(r[1])[2]]
    assert {r[0] for r in rows} - {r[0] for r in rest} == {500, 501, 502}
    texts = {d: t for d, t, *_ in brute_lines([(r[0], r[1]) for r in rest])}
    rest = [(d, texts[d], lang, src) for d, _, lang, src in rest]
    near = {d: c for d, _, c in brute_components([(r[0], brute_fp(r[1])) for r in rest])}
    rest = [r for r in rest if near[r[0]] == r[0]]
    leaves = Counter()
    for _, t, lang, src in rest:
        leaves[domain(src), lang, src] += len(t.split())
    want = Counter()
    for leaf, budget in brute_budgets(leaves, MIX_WEIGHTS, float(sum(leaves.values())), MIX_EPOCHS).items():
        budget, mine, seen = int(budget + 1e-6), [r for r in rest if (domain(r[3]), r[2], r[3]) == leaf], 0
        whole, left = divmod(budget, max(1, leaves[leaf]))
        for r in sorted(mine, key=lambda r: place(r[0], whole, MIX_SEED)):
            times = whole + (left > 0 and seen < left)
            seen += len(r[1].split())
            ids = bpe.encoder(bpe.default_path()).encode([r[1]])[0].tolist()
            want[r[0], r[2], r[3], tuple(ids), True] += int(times)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["lang"], r["source"], tuple(r["token_ids"]), r["round_trip"]) for r in out) == +want
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in out)


def test_stages_keep_columns_and_survive_odd_tables(docs, spark):
    odd = docs([(None, "just some english words here", "en", "src1"), (1, "the same row", "en", None), (1, "the same row", "en", None), (2, None, None, None)],
               rejected="no", keys=1, row=2, domain="d", tokens=3, token_ids=1, component_id=9)
    for df in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, "")
            assert out.columns == df.columns
            out.collect()
        assert corpus_pipeline.encode(spark, df, "").count() == df.count()
    near = corpus_pipeline.dedup_near(spark, odd, "")
    assert sorted(r["doc_id"] or 0 for r in near.collect()) == [0, 1, 2]


def test_near_dedup_keeps_one_row_of_each_group(docs, spark):
    """Repeated and null ids: no group loses all its rows, none keeps two."""
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"w{rng.randrange(9999)}" for _ in range(80)) for _ in range(4))
    rows = [(5, a), (6, a), (3, b), (5, b),  # 5 is first of a, but not of b
            (7, c), (7, "  " + c), (7, c), (None, c), (None, c),  # one id, near and equal texts
            (None, d), (None, d), (None, d.upper())]
    out = corpus_pipeline.dedup_near(spark, docs([(i, t, "en", "src1") for i, t in rows]), "").collect()
    assert Counter((r["doc_id"], r["text"].strip().lower()) for r in out) == Counter([(5, a), (3, b), (7, c), (None, d)])


def test_near_dedup_leaves_clashing_columns_alone(docs):
    """Columns with the names that the stage uses keep their values."""
    rows = [(i, f"some words of document number {i} that nobody else has", "en", "src0") for i in range(20)] + [(50, "some words of document number 3 that nobody else has", "en", "src0")]
    df = docs(rows, __row_hash=7, __row="r", root=5, fp=1, __id=2)
    out = corpus_pipeline.dedup_near(df.sparkSession, df, "")
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(r["doc_id"] for r in got) == list(range(20))
    assert {(r["__row_hash"], r["__row"], r["root"], r["fp"], r["__id"]) for r in got} == {(7, "r", 5, 1, 2)}
