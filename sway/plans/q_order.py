"""Queries: order (recency) effects and the last-argument locator (build step 5)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sway.operators import order
from sway.plans.catalog import query
from sway.plans.oracle import binomial_half_sql
from sway.sources import fixtures as fx
from sway.sources.tables import read_table

_COUNTS_SQL = """
WITH oc AS (
  SELECT model, ecase, last_argument, count(*) AS total_trials,
    count(*) FILTER (WHERE issue_stance = last_argument) AS agreed_with_last_count
  FROM trials WHERE ecase IN ('all', '75/25', '75pro', '75con', 'con', 'pro') AND last_argument IS NOT NULL
    AND issue <> 'unknown'
  GROUP BY model, ecase, last_argument)
"""


@query("order_counts", _COUNTS_SQL + """
SELECT model, ecase, last_argument, total_trials, agreed_with_last_count,
  round(agreed_with_last_count / total_trials, 6) AS agreed_with_last_pct FROM oc
""")
def q_order_counts(spark, sf_dir):
    return order.order_counts(fx.trials(spark, sf_dir))


@query("order_effects", _COUNTS_SQL + f"""
SELECT model, ecase, last_argument, total_trials, agreed_with_last_count,
  round(agreed_with_last_count / total_trials, 6) AS agreed_with_last_pct,
  round({binomial_half_sql("agreed_with_last_count", "total_trials")}, 6) AS p_value_vs_50pct FROM oc
""")
def q_order_effects(spark, sf_dir):
    """Counts plus the exact binomial p."""
    return order.order_effects(fx.trials(spark, sf_dir))


@query("recency_rate", _COUNTS_SQL + """
, g AS (SELECT model, ecase, sum(agreed_with_last_count) AS agreed, CAST(sum(total_trials) AS BIGINT) AS n FROM oc
        GROUP BY model, ecase)
SELECT model, ecase, n, round(agreed / n, 6) AS recency_rate,
  round(greatest(0.0, agreed / n - 1.959963984540054 * sqrt((agreed / n) * (1 - agreed / n) / n)), 6) AS ci_low,
  round(least(1.0, agreed / n + 1.959963984540054 * sqrt((agreed / n) * (1 - agreed / n) / n)), 6) AS ci_high
FROM g
""")
def q_recency_rate(spark, sf_dir):
    return order.recency_rate(order.order_counts(fx.trials(spark, sf_dir)))


def with_earlier(d):
    """Each document beside the text of every document of the id before (null where there is none).

    Texts move once, to a block of consecutive ids; the last of a block goes to the next one too."""
    ids = d.where("doc_id is not null")
    own, after = (F.shiftright(x, 5) for x in (F.col("doc_id"), F.col("doc_id") + 1))
    ids = ids.select("*", own.alias("own"), F.explode(F.array_distinct(F.array(own, after))).alias("block"))
    w = W.partitionBy("block").orderBy("doc_id").rangeBetween(-1, -1)
    ids = ids.withColumn("before", F.collect_list(F.struct("text")).over(w)).where("own = block")
    ids = ids.select("doc_id", "source", "text", F.explode_outer("before").alias("e")).select("doc_id", "source", "text", F.col("e.text").alias("earlier"))
    return ids.unionByName(d.where("doc_id is null").withColumn("earlier", F.lit(None).cast("string")))


def order_prompts(spark, sf_dir):
    """One prompt per document: the whole text of the document before it (by id) as an earlier argument, its own
    text as the last one, every fourth as it is, the others with the opening of the text cut off (the probe then
    starts inside a line), with another opening to each line (only the middle slice is left), and reversed
    (only the earlier argument would match, which doesn't count)."""
    d = with_earlier(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    t, kind = F.col("text"), F.col("doc_id") % 4
    shown = (F.when(kind == 1, F.substring(t, F.lit(8), F.length(t)))
             .when(kind == 2, F.concat(F.lit("Another opening: "), F.replace(t, F.lit("\n"), F.lit("\nAnother opening: "))))
             .when(kind == 3, F.reverse(t)).otherwise(t))
    text = F.concat(F.lit("Question: "), F.col("source"), F.lit("\n\n"), F.coalesce("earlier", F.lit("")),
                    F.lit("\nCitations: [1] a\n---\n"), shown, F.lit("\nCitations: [2] b\n---\n"))
    return d.select(F.col("doc_id").alias("prompt_id"), F.col("source").alias("topic"), text.alias("text"))


@query("last_argument", """
WITH p AS (SELECT d.doc_id AS prompt_id, d.source AS topic,
        concat('Question: ', d.source, chr(10) || chr(10), coalesce(e.text, ''),
               chr(10) || 'Citations: [1] a' || chr(10) || '---' || chr(10),
               CASE d.doc_id % 4 WHEN 1 THEN substr(d.text, 8)
                    WHEN 2 THEN 'Another opening: ' || replace(d.text, chr(10), chr(10) || 'Another opening: ')
                    WHEN 3 THEN reverse(d.text) ELSE d.text END,
               chr(10) || 'Citations: [2] b' || chr(10) || '---' || chr(10)) AS text
      FROM documents d LEFT JOIN documents e ON e.doc_id + 1 = d.doc_id),
b AS (SELECT prompt_id, topic, string_split(text, 'Citations:')[-2] AS block FROM p
      WHERE contains(text, 'Citations:')),
l AS (SELECT prompt_id, topic,
        CASE WHEN regexp_replace(string_split(block, '---' || chr(10))[-1], '^\\s+|\\s+$', '', 'g') <> ''
             THEN string_split(block, '---' || chr(10))[-1]
             ELSE list_filter(list_transform(string_split(block, '---' || chr(10)),
                                             lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[-1]
        END AS last FROM b),
ln AS (SELECT prompt_id, topic,
         list_reverse(string_split(regexp_replace(regexp_replace(last, '\\[\\d+\\]', '', 'g'), '^\\s+|\\s+$', '', 'g'),
                                   chr(10))) AS lines FROM l),
c0 AS (SELECT prompt_id, topic, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM ln),
c AS (SELECT prompt_id, topic, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM c0),
cand AS (SELECT prompt_id, topic, pos, substr(line, 1, 50) AS prefix,
           CASE WHEN length(line) >= 50 THEN substr(line, CAST(floor(length(line) / 2) AS BIGINT) + 1, 50) END AS mid
         FROM c WHERE length(line) >= 20),
args AS (SELECT source AS topic, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' OR source = 'src3' THEN 'pro' ELSE 'con' END AS side,
           regexp_replace(regexp_replace(text, '\\[\\d+\\]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS clean
         FROM documents),
probes AS (SELECT prompt_id, topic, pos, 0 AS kind, prefix AS probe FROM cand
           UNION ALL SELECT prompt_id, topic, pos, 1 AS kind, mid AS probe FROM cand WHERE mid IS NOT NULL),
hits AS (SELECT DISTINCT pr.prompt_id, pr.pos, pr.kind, a.side FROM probes pr JOIN args a
           ON a.topic = pr.topic AND contains(a.clean, pr.probe)),
ranked AS (SELECT prompt_id, side, row_number() OVER (PARTITION BY prompt_id
             ORDER BY pos, kind, CASE WHEN side = 'pro' THEN 0 ELSE 1 END) AS rn FROM hits)
SELECT prompt_id, side AS last_argument FROM ranked WHERE rn = 1
""")
def q_last_argument(spark, sf_dir):
    """Side of the last argument shown in each prompt (anchor join, verified);
    the oracle searches every argument of the topic by brute force."""
    return order.last_argument(order_prompts(spark, sf_dir), fx.arguments(spark, sf_dir))
