"""Text features against a direct Python ``re`` computation on the sf0.001 documents."""

import math
import random
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from sway.functions import features as FT
from sway.plans import q_evidence as QE
from sway.sources.tables import read_table


def _py_features(text: str) -> dict:
    words = len(text.split())
    w1 = max(words, 1)
    sent = max(len(re.findall(r"[.!?]+", text)), 1)
    digits = len(re.findall(r"\d", text))
    alpha = re.sub(r"[^a-z\s]", " ", text.lower())
    syll = max(len(re.findall(r"[aeiouy]+", alpha)), 1)
    out = {
        "char_count": len(text), "word_count": words, "sentence_count": sent, "digit_count": digits,
        "avg_word_length": len(re.sub(r"\s+", "", text)) / w1,
        "flesch_kincaid_grade_est": 0.39 * (words / sent) + 11.8 * (syll / w1) - 15.59,
        "percent_count": len(re.findall(f"({FT.PERCENT})", text)),
        "source_cue_count": len(re.findall(rf"\b({FT.SOURCE_CUES})\b", text)),
        "normative_cue_count": len(re.findall(rf"\b({FT.NORMATIVE})\b", text)),
        "stats_term_count": len(re.findall(rf"\b(?:{FT.STATS_TERMS})\b", text)),
        "citation_count": len(re.findall(r"\[\d+\]", text)),
    }
    for k, (alts, bounded) in FT.FLAGS.items():
        pat = rf"\b(?:{alts})\b" if bounded else f"(?:{alts})"
        out[k] = bool(re.search(pat, text, re.IGNORECASE))
    return out


def test_features_match_python_re(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    got = d.select("doc_id", "text", *FT.text_features(F.col("text"))).toPandas()
    bad = []
    for _, r in got.iterrows():
        exp = _py_features(r["text"] or "")
        for k, v in exp.items():
            g = r[k]
            if isinstance(v, float):
                ok = math.isclose(float(g), v, rel_tol=1e-9, abs_tol=1e-9)
            else:
                ok = (bool(g) == v) if isinstance(v, bool) else int(g) == v
            if not ok:
                bad.append((r["doc_id"], k, g, v))
    assert not bad, bad[:10]


def test_quote_folding():
    s = "“Hi” — it’s… ok​"
    expect = s
    for k, v in {**FT.QUOTE_MAP, **FT.QUOTE_EXPAND}.items():
        expect = expect.replace(k, v)
    assert expect == '"Hi" - it\'s... ok'


def test_quote_folding_spark(spark):
    s = "“Hi” — it’s… ok​ "
    df = spark.createDataFrame(pd.DataFrame({"t": [s]}))
    assert df.select(FT.normalize_quotes(F.col("t"))).first()[0] == '"Hi" - it\'s... ok '


def test_issue_titles_match_python(spark, sf_dir):
    from sway.plans.q_pages import q_issue_titles
    rows = q_issue_titles(spark, sf_dir).collect()
    assert rows
    for r in rows:
        slug = r["title"].lower().replace("&", "and").replace(" ", "-").replace("--", "-")
        assert r["slug"] == slug
        assert r["display_title"] == slug.replace("-", " ").title()


def test_page_topic_record(spark):
    from sway.operators.pages import page_topics
    html = ('<html><head><title>T</title></head><body><h1>Should X?</h1>'
            '<section class="pro"><h3>Pro 1: Good thing</h3><p>Because [1].</p><blockquote>"Yes" said A</blockquote></section>'
            '<section class="con"><h3>### Con 2: Bad thing</h3></section>'
            '<ol><li id="fn-2">Second source</li><li id="fn-1">First source</li></ol></body></html>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    r = page_topics(df).first()
    assert r["question"] == "Should X?"
    assert r["pros"] == ["Good thing", "Because [1].", '"Yes" said A'] and r["cons"] == ["Bad thing"]
    assert r["sources"] == {"[1]": "First source", "[2]": "Second source"}


def test_cumulative_citations_mode(spark):
    from sway.functions import prompts as PR
    rows = [("p", 1, "A cites [1]", [("[1]", "one")]), ("p", 2, "B cites [1] and [2]", [("[1]", "one"), ("[2]", "two")]),
            ("p", 3, "C cites nothing", [])]
    df = spark.createDataFrame(rows, "pid string, pos int, text string, "
                                     "citations array<struct<marker:string,citation:string>>")
    clean = [r[0] for r in df.orderBy("pos").select(PR.evidence_block(F.col("text"), F.col("citations"))).collect()]
    assert clean[2] == "C cites nothing---\n"
    cum = PR.cumulative_citations(df, ["pid"], "pos").orderBy("pos").select(
        PR.evidence_block(F.col("text"), F.col("citations"))).collect()
    assert cum[1][0] == "B cites [1] and [2]\nCitations:\n[1] one\n[1] one\n[2] two\n---\n"
    assert cum[2][0] == "C cites nothing\nCitations:\n[1] one\n[1] one\n[2] two\n---\n"


def test_page_quotes(spark):
    from sway.operators.pages import page_quotes
    html = ('<html><body><section class="pro"><h2>Pro 1</h2><p>Dr. A said:</p>'
            '<blockquote><p>First line <a href="#pcref-7-3">[3]</a></p><p>Second line</p></blockquote>'
            '<div>x</div><blockquote><p>No context here</p></blockquote></section>'
            '<section class="con"><h3>Opposing view</h3><blockquote><p>Con quote <a href="/s#pcref-1-12">[12]</a>'
            '<a href="#pcref-1-2">[2]</a></p></blockquote></section></body></html>')
    rows = page_quotes(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()
    got = [(r["side"], r["context"], r["text"], r["footnotes"]) for r in rows]
    assert got == [("pro", "Dr. A said:", "Dr. A said:\n\nFirst line [3]\nSecond line", ["3"]),
                   ("pro", "", "No context here", []),
                   ("con", "Opposing view", "Opposing view\n\nCon quote [12] [2]", ["12", "2"])]


def test_rendered_evidence_moves_no_rendered_text(spark):
    from sway.functions import prompts as PR
    from sway.operators import grid as G
    args = spark.createDataFrame([(1, "one", ["[1]"]), (2, "two", []), (2, "two", []), (3, None, ["[2]"])], "doc_id long, text string, m array<string>")
    args = args.select("doc_id", "text", F.transform("m", lambda m: F.struct(m.alias("marker"), F.lit("src").alias("citation"))).alias("citations"))
    shown = spark.createDataFrame([("t", "pro", 1, 1, "b"), ("t", "pro", 1, 2, "a"), ("t", "pro", 2, 3, "a"), ("t", "pro", 2, 1, "b")], "topic string, ecase string, draw int, doc_id long, order_key string")
    one, three = "one\nCitations:\n[1] src\n---\n", "\nCitations:\n[2] src\n---\n"
    out = G.rendered_evidence(shown, args)
    assert {r["draw"]: r["evidence"] for r in out.collect()} == {1: "two---\n" * 4 + one, 2: three + one}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Citations:") < plan.index("Exchange")
    cum = {r["draw"]: r["evidence"] for r in G.rendered_evidence(shown, args, True).collect()}
    assert cum[2] == three + "one\nCitations:\n[2] src\n[1] src\n---\n"
    assert spark.range(1).select(PR.evidence_items(F.lit("a [1]\nCitations:\n[1] x\n[2] y\n---\n b\t---\nrest")).alias("v")).first()["v"] == ["a [1]\nCitations:\n[1] x", "b"]


def test_citations_accumulate_in_place(spark):
    from sway.functions import prompts as PR
    c = lambda *names: [(f"[{n}]", n) for n in names]
    rows = [("p", "b", c("x")), ("p", "c", None), ("p", "a", c("y", "z")), ("p", "d", c("x")), ("q", "a", [])]
    df = spark.createDataFrame(rows, "pid string, pos string, citations array<struct<marker:string,citation:string>>")
    want = {(r["pid"], r["pos"]): r["citations"] for r in PR.cumulative_citations(df, ["pid"], "pos").collect()}
    held = df.groupBy("pid").agg(F.collect_list(F.struct("pos", "citations")).alias("each"))
    got = {(r["pid"], x["pos"]): x["citations"] for r in PR.cumulative_citations(held, None, "pos", "each").collect() for x in r["each"]}
    assert got == want and [x["marker"] for x in got["p", "d"]] == ["[y]", "[z]", "[x]", "[x]"]


def test_draws_of_evidence_are_not_moved(spark):
    """Ids, texts and citations move by argument; rows of draws, many times as many, stay where they were selected."""
    import re

    from sway.functions import prompts as PR
    from sway.operators import grid as G
    args = spark.createDataFrame([(f"t{i % 3}", "pro" if i % 2 else "con", i, f"text {i} [{i % 2}]") for i in range(24)], "topic string, side string, doc_id long, text string")
    cited = PR.attach_citations(args, spark.createDataFrame([("[1]", "one")], "marker string, citation string"))
    shown = G.evidence_selection(args.select("topic", "side", "doc_id"), 2, by_topic=True)
    assert sorted(shown.collect()) == sorted(G.evidence_selection(args.select("topic", "side", "doc_id"), 2).collect())
    for cumulative in (False, True):
        out = G.rendered_evidence(shown, cited, cumulative)
        plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
        assert any("text" in x or "rows" in x for x in moved) and not any("order_key" in x or "draw" in x or "shown" in x for x in moved), moved


def _odd_texts() -> list[str | None]:
    """Cues between characters that only Unicode classes and case folding tell apart."""
    rng = random.Random(7)
    pieces = ["percent", "PERCENT", "%", "pct.", "study", "\u017ftudy", "STUDY", "ri\u017fk ratio", "risk ratio", "Ris\u212a RATIO", "mu\u017ft", "must", "r\u0131ght", "R\u0130GHTS",
              "rights", "findings", "meta-analysis", "p-value", "P-VALUE", "median", "rate", "do\u0131", "DO\u0130", "http\u017f://", "[12]", "[\u0661\u0662]", "(\u0967\u0968\u0969\u096a)",
              "(1999)", "\u0665", "7", "\u00e9", "e\u0301", "\u0301", "\u0130a", "\u0131o", "ae", "AEIOU", "y", "_", "\u203f", "\u200d", "\u200c", "\u00ad", "\u201c", "\u2019", "\u00df", "\U0001d54f",
              "\U0001f600", "\U00010400", "\u4e2d", ".", "!?", "\u3002", "-", "'", "\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\u00a0", "\u2003", "\u3000", "\u180e", "\u2028", " ", " ", " ", "\x00"]
    return [None, "", " ", "e", "%", *["".join(rng.choices(pieces, k=rng.randrange(1, 30))) for _ in range(3000)], *pieces]


def test_pattern_features_equal_text_features(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(_odd_texts())], "i long, text string").repartition(5)
    kept = [c for c in d.select(*FT.pattern_features(F.col("text"))).columns if c != "avg_sentence_length_words"]
    want = d.select("i", *FT.text_features(F.col("text"))).select("i", *kept)
    got = d.select("i", *FT.pattern_features(F.col("text"))).select("i", *kept)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_class_counts_of_small_pieces_and_slices(monkeypatch):
    texts = ["a b", "", None, "e", "ee.!x. 12", " ", "e" * 50]
    whole = FT.ascii_counts.func(pa.array(["skipped", *texts])[1:].fill_null(""))
    monkeypatch.setattr(FT, "CLASSED", 3)
    assert FT.ascii_counts.func(pa.array([t or "" for t in texts])).equals(whole)
    assert [tuple(r[k] for k in ("words", "sentences", "digits", "syllables", "solid")) for r in whole.to_pylist()] == [
        (2, 0, 0, 1, 2), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (1, 0, 0, 1, 1), (2, 2, 2, 1, 8), (0, 0, 0, 0, 0), (1, 0, 0, 1, 50)]
    assert len(FT.ascii_counts.func(pa.array([], pa.string()))) == 0


def test_item_features_run_no_pattern_per_feature(spark, sf_dir):
    """Patterns of the JVM only fold texts that aren't ASCII and count their vowels."""
    plan = QE._item_features(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "percent" not in plan.replace("has_percent", "").replace("percent_count", "")
    assert plan.count("ascii_counts(") == 1
