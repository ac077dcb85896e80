"""Study relations derived from the driver tables.

The study's own inputs (trials, parsed answers, raw replies, judge labels,
composition runs) are derived from ``lineitem`` by a fixed rule, so every
query grows with the fact table.  The same rule is written in SQL in
``sway.plans.oracle`` for the DuckDB cross-check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sway.sources.tables import read_table

CASES = ("neither", "pro", "75pro", "all", "75con", "con")
EVIDENCE_CASES = ("pro", "75pro", "all", "75con", "con")
TRIALS = 15  # trials of a question and case in the study's design
STANCES = ("con", "other", "pro")


def _case_of(orderkey: Column) -> Column:
    m = orderkey % 6
    return (F.when(m == 0, "neither").when(m == 1, "pro").when(m == 2, "75pro")
            .when(m == 3, "all").when(m == 4, "75con").otherwise("con"))


def _pro_threshold(orderkey: Column) -> Column:
    m = orderkey % 6
    return (F.when(m == 0, 25).when(m == 1, 40).when(m == 2, 33)
            .when(m == 3, 26).when(m == 4, 16).otherwise(8))


def _stance_of(issue: Column, orderkey: Column, quantity: Column) -> Column:
    """Stance by quantity and case; three issues are special, so that the reports on them have rows:
    19 never moves, 18 is mostly undecided, 17 is even at baseline and follows one-sided evidence."""
    m = orderkey % 6
    return (F.when(issue == 19, "pro").when((issue == 18) & (quantity > 20), "other")
            .when((issue == 17) & (m == 1), "pro").when((issue == 17) & (m == 5), "con")
            .when((issue == 17) & (m == 0), F.when(quantity <= 25, "pro").otherwise("con"))
            .when(quantity > 47, "other").when(quantity <= _pro_threshold(orderkey), "pro").otherwise("con"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per model answer: (model, issue, ecase, trial_num, paraphrase, stances)."""
    li = read_table(spark, sf_dir, "lineitem")
    ok, pk = F.col("l_orderkey"), F.col("l_partkey")
    return li.select(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 9).cast("string")).alias("model"),
        F.concat(F.lit("issue-"), (pk % 20).cast("string")).alias("issue"),
        _case_of(ok).alias("ecase"),
        F.col("l_linenumber").alias("trial_num"),
        (pk % 6).alias("paraphrase_idx"),
        F.when(pk % 6 < 4, "pro").otherwise("con").alias("question_stance"),
        _stance_of(pk % 20, ok, F.col("l_quantity")).alias("issue_stance"),
        F.when(F.col("l_returnflag") == "A", "pro")
         .when(F.col("l_returnflag") == "R", "con").alias("last_argument"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    )


def evidence_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials with the ids of the documents shown as evidence: none in the baseline, else one, and a
    second one in trials of even number.  All documents serve as evidence."""
    n = read_table(spark, sf_dir, "documents").select(F.max("doc_id") + 1).scalar()
    ok, pk = F.col("l_orderkey"), F.col("l_partkey")
    first, second = pk * 7 + ok, pk + ok * 13
    ids = (F.when(F.col("ecase") == "neither", F.array().cast("array<bigint>"))
           .when(F.col("trial_num") % 2 == 0, F.array(first % n, second % n)).otherwise(F.array(first % n)))
    return trials(spark, sf_dir).withColumn("evidence_ids", ids)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir)
    return t.withColumn(
        "llm_answer",
        F.when(F.col("issue_stance") == "other", "Other")
         .when(F.col("issue_stance") == F.col("question_stance"), "A").otherwise("B"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reply text in four phrasings plus the packed request id."""
    a = answers(spark, sf_dir)
    tn = F.col("trial_num") % 4
    ans = F.col("llm_answer")
    text = (F.when(ans == "Other", F.lit("I cannot choose."))
            .when(tn == 0, F.concat(F.lit("position <<"), ans, F.lit(">>")))
            .when(tn == 1, F.concat(F.lit("My answer: position "), ans))
            .when(tn == 2, F.concat(F.lit("<<"), F.lower(ans), F.lit(">>")))
            .otherwise(F.concat(F.lit(" "), ans, F.lit(" "))))
    cid = F.concat(
        F.lit("request-"), F.replace(F.replace(F.col("issue"), F.lit("-"), F.lit(" ")), F.lit(" "), F.lit("_")),
        F.lit("-"), F.col("trial_num").cast("string"), F.lit("-framing-"), F.col("question_stance"),
        F.lit("-evidence-"), F.col("ecase"))
    return a.withColumn("response_text", text).withColumn("custom_id", cid)


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge labels per (topic, paraphrase, judge), aggregated from lineitem."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    g = li.groupBy(
        F.concat(F.lit("issue-"), (F.col("l_partkey") % 20).cast("string")).alias("topic"),
        (F.col("l_partkey") % 6).alias("paraphrase_idx"),
        F.concat(F.lit("j"), (F.col("l_suppkey") % 3).cast("string")).alias("judge_model"),
    ).agg(F.sum("l_orderkey").alias("_s"))
    m10 = F.col("_s") % 10
    return g.select(
        "topic", "paraphrase_idx", "judge_model",
        F.when(m10 == 0, "leans_pro").when(m10 == 1, "leans_con").when(m10 == 2, "unknown")
         .otherwise("neutral").alias("label"),
        F.when(F.col("_s") % 17 == 0, "timeout").otherwise("").alias("error"),
    )


def compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trials(spark, sf_dir).filter(F.col("ecase").isin("75pro", "75con"))
    return t.select(
        "model", F.col("issue").alias("topic"), "ecase", "paraphrase_idx",
        F.concat(F.col("ecase"), F.lit("-"), F.col("trial_num").cast("string")).alias("composition_id"),
        "issue_stance")


def prediction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw prediction JSON lines in the four reply dialects (by ``trial_num % 4``).

    0: flat string ``response``; 1: ``response.content[0].text``;
    2: ``response.candidates[0].content.parts[0].text`` with the id under
    ``request.labels``; 3: ``response.choices[0].message.content``.
    """
    r = responses(spark, sf_dir)
    txt, cid = F.col("response_text"), F.col("custom_id")
    d = F.col("trial_num") % 4
    line = (
        F.when(d == 0, F.to_json(F.struct(cid.alias("custom_id"), txt.alias("response"))))
        .when(d == 1, F.to_json(F.struct(
            cid.alias("custom_id"),
            F.struct(F.array(F.struct(txt.alias("text"))).alias("content")).alias("response"))))
        .when(d == 2, F.to_json(F.struct(
            F.struct(F.struct(cid.alias("custom_id")).alias("labels")).alias("request"),
            F.struct(F.array(F.struct(F.struct(F.array(F.struct(txt.alias("text"))).alias("parts"))
                                      .alias("content"))).alias("candidates")).alias("response"))))
        .otherwise(F.to_json(F.struct(
            cid.alias("custom_id"),
            F.struct(F.array(F.struct(F.struct(txt.alias("content")).alias("message")))
                     .alias("choices")).alias("response"))))
    )
    return r.select("model", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "trial_num", "question_stance",
                    "issue", "ecase", line.alias("value"))


def arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of a topic: topic = ``source``; side by the first hex digit of md5(doc_id)
    (< 8 pro, else con), which splits every topic into both sides (the document
    generator assigns sources by doc_id residue, so a parity rule would make each
    topic one-sided).  Topic src3 has no con argument, so that the report on thin topics has rows."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return d.select(
        F.col("source").alias("topic"),
        F.when((F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8") | (F.col("source") == "src3"), "pro")
         .otherwise("con").alias("side"),
        "doc_id", "text")


def topic_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages of topics, four to each row of ``pages``: a hub, its pro and con arguments and its sources.

    A topic's arguments are the documents whose id is its number modulo the number of topics; every third is a quote
    with a footnote.  Hubs write their links in every way a URL can be written; every seventh topic's con page isn't
    stored, and its hub holds the con arguments itself."""
    numbers = read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("topic"))
    n = read_table(spark, sf_dir, "pages").select(F.count(F.lit(1))).scalar()
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id is not null and text is not null")
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    note = (F.col("doc_id") % 6 + 1).cast("string")
    topic, doc = F.col("topic").cast("string"), F.col("doc_id").cast("string")
    side = F.when(F.substring(F.md5(doc), 1, 1) < "8", "pro").otherwise("con")
    quote = F.concat(F.lit("<h3>On document "), doc, F.lit("</h3><blockquote><p>"), escaped, F.lit('</p><a href="#pcref-'), topic, F.lit("-"), note, F.lit('">'), note, F.lit("</a></blockquote>"))
    plain = F.concat(F.lit("<p>"), F.initcap("side"), F.lit(" 1: "), escaped, F.lit("</p>"))
    pieces = d.withColumns({"topic": F.col("doc_id") % n, "side": side}).withColumn("piece", F.when(F.col("doc_id") % 3 == 0, quote).otherwise(plain))
    listed = pieces.groupBy("topic").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("doc_id", "piece")))), lambda x: x["piece"]), "").alias(s)
                                           for s in ("pro", "con")])
    body = {s: F.concat(F.lit(f'<section class="args {s}">'), F.coalesce(s, F.lit("")), F.lit("</section>")) for s in ("pro", "con")}
    way = F.col("topic") % 4
    pick = lambda *forms: F.when(way == 0, forms[0]).when(way == 1, forms[1]).when(way == 2, forms[2]).otherwise(forms[3])
    hrefs = {"pro": pick(F.lit("pro"), F.lit("./pro#first"), F.concat(F.lit("../"), topic, F.lit("/pro/")), F.concat(F.lit("//TOPICS.example.org/t/"), topic, F.lit("/pro"))),
             "con": pick(F.concat(F.lit("/t/"), topic, F.lit("/con")), F.concat(F.lit("https://topics.example.org:443/t/"), topic, F.lit("/con")), F.lit("con?"), F.lit("x/../con")),
             "sources": pick(*[F.concat(F.lit(p), topic) for p in ("/sources?topic=", "../../sources?topic=", "HTTPS://topics.example.org/sources?topic=", "/t/../sources?topic=")])}
    links = [x for r, h in hrefs.items() for x in (F.lit(f'<li><a rel="{r}" href="'), h, F.lit(f'">{r}</a></li>'))]
    gone = F.col("topic") % 7 == 3
    hub = F.concat(F.lit("<html><body><h1>Topic "), topic, F.lit(': for &amp; against</h1><ul><li><a rel="pro" href="mailto:editor@example.org">write</a></li>'), *links, F.lit("</ul>"),
                   F.when(gone, body["con"]).otherwise(F.lit("")), F.lit("</body></html>"))
    notes = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.concat(
        F.lit('<li id="pcref-'), topic, F.lit("-"), k.cast("string"), F.lit('">Source '), k.cast("string"), F.lit(" of topic "), topic, F.lit("</li>"))), "")
    site = F.concat(F.lit("https://topics.example.org/t/"), topic)
    page = lambda k, url, html: F.struct((F.col("topic") * 4 + k).alias("page_id"), url.alias("url"), html.alias("html"))
    rows = F.array(page(0, F.concat(site, F.lit("/")), hub), page(1, F.concat(site, F.lit("/pro")), body["pro"]),
                   F.when(~gone, page(2, F.concat(site, F.lit("/con")), body["con"])), page(3, F.concat(F.lit("https://topics.example.org/sources?topic="), topic), F.concat(F.lit("<ol>"), notes, F.lit("</ol>"))))
    return numbers.join(listed, "topic", "left").select(F.inline(F.filter(rows, lambda r: r.isNotNull())))


def model_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model -> family: the name-prefix rule, else (fixture models m0..m8) three families of
    three models each by model number."""
    from sway.operators.evstats import family_of
    m = models_dim(spark, sf_dir)
    num = F.regexp_extract("model", r"(\d+)$", 1).try_cast("int")
    return m.select("model", F.coalesce(family_of(F.col("model")),
                                        F.concat(F.lit("f"), F.floor(num / 3).cast("string"))).alias("family"))


# ---- dimensions (from the dimension tables, never a distinct over the fact table) ----

def issues_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every topic of the fixture with its question text (from ``part``)."""
    p = read_table(spark, sf_dir, "part").select("p_partkey")
    i = p.select(F.concat(F.lit("issue-"), (F.col("p_partkey") % 20).cast("string")).alias("issue")).distinct()
    return i.select("issue", F.lower(F.replace("issue", F.lit("-"), F.lit(" "))).alias("question"))


def paraphrases_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, paraphrase_idx, orientation, question) for every paraphrase (from ``part``)."""
    pk = F.col("p_partkey")
    p = read_table(spark, sf_dir, "part").select("p_partkey")
    d = p.select(F.concat(F.lit("issue-"), (pk % 20).cast("string")).alias("topic"), (pk % 6).alias("paraphrase_idx"),
                 F.when(pk % 6 < 4, "pro").otherwise("con").alias("orientation")).distinct()
    return d.withColumn("question", F.concat(F.replace("topic", F.lit("-"), F.lit(" ")), F.lit(" v"),
                                             F.col("paraphrase_idx").cast("string")))


def models_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model of the fixture (from ``supplier``)."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    return s.select(F.concat(F.lit("m"), (F.col("s_suppkey") % 9).cast("string")).alias("model")).distinct()
