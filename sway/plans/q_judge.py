"""Queries: composition sensitivity and neutrality judging (build step 10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sway.operators import judge as J
from sway.operators import sensitivity as S
from sway.plans.catalog import query
from sway.sources import fixtures as fx

_LEVELS_SQL = """
WITH lv AS (
  SELECT model, topic, ecase, paraphrase_idx, composition_id,
    avg(CASE WHEN issue_stance = 'pro' THEN 1.0 ELSE 0.0 END) AS p_pro,
    avg(CASE WHEN issue_stance = 'con' THEN 1.0 ELSE 0.0 END) AS p_con,
    avg(CASE WHEN issue_stance = 'other' THEN 1.0 ELSE 0.0 END) AS p_other
  FROM compositions GROUP BY model, topic, ecase, paraphrase_idx, composition_id),
levels AS (SELECT *, CASE WHEN p_pro > 0.5 THEN 'pro' WHEN p_con > 0.5 THEN 'con' ELSE 'other' END
             AS composition_label FROM lv),
pairs AS (SELECT a.model, a.topic, a.ecase, a.paraphrase_idx,
            count(*) AS np, count(*) FILTER (WHERE a.composition_label <> b.composition_label) AS flips,
            avg(abs(a.p_pro - b.p_pro)) AS mean_abs, max(abs(a.p_pro - b.p_pro)) AS max_abs
          FROM levels a JOIN levels b ON a.model = b.model AND a.topic = b.topic AND a.ecase = b.ecase
            AND a.paraphrase_idx = b.paraphrase_idx AND a.composition_id < b.composition_id
          GROUP BY a.model, a.topic, a.ecase, a.paraphrase_idx),
grp AS (SELECT model, topic, ecase, paraphrase_idx, count(*) AS n_compositions, var_samp(p_pro) AS var_p
        FROM levels GROUP BY model, topic, ecase, paraphrase_idx),
rates AS (SELECT g.model, g.topic, g.ecase, g.paraphrase_idx, g.n_compositions,
            CASE WHEN g.n_compositions >= 2 THEN p.flips / p.np END AS pairwise_flip_rate,
            CASE WHEN g.n_compositions >= 2 THEN p.mean_abs END AS mean_abs_pairwise_delta_p_pro,
            CASE WHEN g.n_compositions >= 2 THEN p.max_abs END AS max_abs_pairwise_delta_p_pro,
            CASE WHEN g.n_compositions >= 2 THEN g.var_p END AS p_pro_variance_across_compositions
          FROM grp g LEFT JOIN pairs p ON p.model = g.model AND p.topic = g.topic AND p.ecase = g.ecase
            AND p.paraphrase_idx = g.paraphrase_idx)
"""


def _levels(spark, sf_dir):
    """Composition-level rates (one row per composition), materialised once per query."""
    from sway.session import materialize
    return materialize(S.composition_levels(fx.compositions(spark, sf_dir)))


def _judgments(spark, sf_dir):
    """Judge labels (one row per topic x paraphrase x judge), materialised once per query."""
    from sway.session import materialize
    return materialize(fx.judgments(spark, sf_dir))


@query("composition_levels", _LEVELS_SQL + """
SELECT model, topic, ecase, paraphrase_idx, composition_id, round(p_pro, 6) AS p_pro,
  round(p_con, 6) AS p_con, round(p_other, 6) AS p_other, composition_label FROM levels
""")
def q_composition_levels(spark, sf_dir):
    return _levels(spark, sf_dir)


@query("flip_rate", _LEVELS_SQL + """
SELECT model, topic, ecase, paraphrase_idx, n_compositions, round(pairwise_flip_rate, 6) AS pairwise_flip_rate,
  round(mean_abs_pairwise_delta_p_pro, 6) AS mean_abs_pairwise_delta_p_pro,
  round(max_abs_pairwise_delta_p_pro, 6) AS max_abs_pairwise_delta_p_pro,
  round(p_pro_variance_across_compositions, 6) AS p_pro_variance_across_compositions FROM rates
""")
def q_flip_rate(spark, sf_dir):
    """Closed-form pairwise statistics; the oracle enumerates the pairs (brute force)."""
    return S.flip_rates(_levels(spark, sf_dir))


@query("sensitivity_summary", _LEVELS_SQL + """
SELECT model, ecase, count(DISTINCT topic) AS topics,
  round(avg(pairwise_flip_rate), 6) AS mean_pairwise_flip_rate,
  round(avg(mean_abs_pairwise_delta_p_pro), 6) AS mean_abs_pairwise_delta_p_pro,
  round(avg(max_abs_pairwise_delta_p_pro), 6) AS max_abs_pairwise_delta_p_pro,
  round(avg(p_pro_variance_across_compositions), 6) AS mean_p_pro_variance
FROM rates GROUP BY model, ecase
""")
def q_sensitivity_summary(spark, sf_dir):
    return S.sensitivity_summary(S.flip_rates(_levels(spark, sf_dir)))


def _raw_replies(spark, sf_dir):
    """Judge replies in three shapes (plain JSON, fenced JSON, free text) by paraphrase index."""
    j = fx.judgments(spark, sf_dir)
    conf = ((F.col("paraphrase_idx") + F.length("topic")) / 4.0).cast("string")
    js = F.concat(F.lit('{"label":"'), F.upper(F.col("label")), F.lit('","confidence":'), conf,
                  F.lit(',"rationale":"wording of '), F.col("topic"), F.lit('"}'))
    text = F.concat(F.lit("After review the framing seems "), F.col("label"), F.lit(" to me."))
    m = F.col("paraphrase_idx") % 3
    raw = (F.when(m == 0, js).when(m == 1, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
           .otherwise(text))
    return j.select("topic", "paraphrase_idx", "judge_model", raw.alias("raw_response"))


@query("judge_parse", """
WITH r AS (
  SELECT topic, paraphrase_idx, judge_model,
    concat('{"label":"', upper(label), '","confidence":', CAST((paraphrase_idx + length(topic)) / 4.0 AS VARCHAR),
           ',"rationale":"wording of ', topic, '"}') AS js, label AS lbl
  FROM judgments),
raw AS (SELECT topic, paraphrase_idx, judge_model,
          CASE paraphrase_idx % 3 WHEN 0 THEN js WHEN 1 THEN concat('```json' || chr(10), js, chr(10) || '```')
               ELSE concat('After review the framing seems ', lbl, ' to me.') END AS raw_response FROM r),
c AS (SELECT *, trim(replace(replace(trim(raw_response), '```json', ''), '```', '')) AS cleaned FROM raw),
c2 AS (SELECT *, regexp_replace(cleaned, '^\\s+|\\s+$', '', 'g') AS cl FROM c),
p0 AS (SELECT *, CASE WHEN json_valid(cl) THEN cl END AS vj FROM c2),
p1 AS (SELECT *, coalesce(json_type(vj) = 'OBJECT', false) AS is_obj FROM p0),
p AS (SELECT *, CASE WHEN is_obj THEN vj END AS oj FROM p1)
SELECT topic, paraphrase_idx, judge_model,
  CASE WHEN is_obj THEN CASE WHEN lower(trim(coalesce(json_extract_string(oj, '$.label'), ''))) IN
         ('neutral', 'leans_pro', 'leans_con') THEN lower(trim(json_extract_string(oj, '$.label'))) ELSE 'unknown' END
       WHEN contains(lower(cl), 'leans_pro') THEN 'leans_pro'
       WHEN contains(lower(cl), 'leans_con') THEN 'leans_con'
       WHEN regexp_matches(lower(cl), '\\bneutral\\b') THEN 'neutral' ELSE 'unknown' END AS label,
  round(greatest(0.0, least(1.0, CASE WHEN is_obj THEN coalesce(TRY_CAST(json_extract(oj, '$.confidence') AS DOUBLE), 0.0)
                                      ELSE 0.0 END)), 6) AS confidence,
  CASE WHEN is_obj THEN coalesce(json_extract_string(oj, '$.rationale'), '') ELSE substr(cl, 1, 300) END AS rationale
FROM p
""")
def q_judge_parse(spark, sf_dir):
    r = _raw_replies(spark, sf_dir)
    p = J.parse_judge_reply(F.regexp_replace(F.col("raw_response"), r"^\s+|\s+$", ""))
    return r.select("topic", "paraphrase_idx", "judge_model", p["label"].alias("label"),
                    p["confidence"].alias("confidence"), p["rationale"].alias("rationale"))


@query("label_rates", """
SELECT judge_model, label, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY judge_model) AS BIGINT) AS total,
  round(count(*) / sum(count(*)) OVER (PARTITION BY judge_model) * 100.0, 6) AS pct
FROM judgments GROUP BY judge_model, label
""")
def q_label_rates(spark, sf_dir):
    return J.label_rates(_judgments(spark, sf_dir))


@query("judge_agreement", """
WITH f AS (SELECT topic, paraphrase_idx, judge_model, first(label) AS label FROM judgments
           GROUP BY topic, paraphrase_idx, judge_model),
c AS (SELECT topic, paraphrase_idx, label, count(*) AS c FROM f WHERE label IS NOT NULL AND label <> ''
      GROUP BY topic, paraphrase_idx, label),
per AS (SELECT topic, paraphrase_idx, sum(c) AS n_models, count(*) AS n_unique_labels, max(c) AS max_count
        FROM c GROUP BY topic, paraphrase_idx),
lab AS (SELECT topic, paraphrase_idx, string_agg(judge_model || ':' || label, '; ' ORDER BY judge_model, label)
          AS labels FROM f WHERE label IS NOT NULL GROUP BY topic, paraphrase_idx)
SELECT lab.topic, lab.paraphrase_idx, CAST(coalesce(n_models, 0) AS BIGINT) AS n_models,
  coalesce(n_unique_labels, 0) AS n_unique_labels, coalesce(n_unique_labels, 0) = 1 AS all_agree,
  round(CASE WHEN coalesce(n_models, 0) > 0 THEN max_count / n_models * 100.0 ELSE 0.0 END, 6)
    AS majority_agreement_pct, labels
FROM lab LEFT JOIN per USING (topic, paraphrase_idx)
""")
def q_judge_agreement(spark, sf_dir):
    return J.agreement(_judgments(spark, sf_dir))


@query("review_queue", """
WITH cand AS (SELECT *, sha1(concat_ws('|', topic, CAST(paraphrase_idx AS VARCHAR), judge_model, label)) AS row_id
              FROM judgments
              WHERE lower(coalesce(label, '')) <> 'neutral' OR length(trim(coalesce(error, ''))) > 0),
done AS (SELECT DISTINCT row_id FROM cand WHERE judge_model = 'j0')
SELECT topic, paraphrase_idx, judge_model, label,
  CASE WHEN error IS NULL OR lower(trim(error)) = 'nan' THEN '' ELSE error END AS error, row_id
FROM cand WHERE row_id NOT IN (SELECT row_id FROM done)
""")
def q_review_queue(spark, sf_dir):
    """Non-neutral or failed judgments still waiting for a manual decision
    (decisions already stored for judge j0)."""
    cand = J.review_candidates(_judgments(spark, sf_dir), include_errors=True)
    decisions = cand.filter(F.col("judge_model") == "j0").select("row_id")
    return J.review_queue(cand, decisions).select(
        "topic", "paraphrase_idx", "judge_model", "label", "error", "row_id")


@query("judge_resume", """
WITH par AS (SELECT DISTINCT topic, paraphrase_idx FROM judgments),
jm AS (SELECT * FROM (VALUES ('j0'), ('j1'), ('j2'), ('j3')) v(judge_model)),
grid AS (SELECT * FROM par CROSS JOIN jm)
SELECT g.topic, g.paraphrase_idx, g.judge_model FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM judgments j WHERE j.topic = g.topic AND j.paraphrase_idx = g.paraphrase_idx
                  AND j.judge_model = g.judge_model)
""")
def q_judge_resume(spark, sf_dir):
    """Judge runs still to do for judges j0..j3 after the stored judgments (resume by key)."""
    j = _judgments(spark, sf_dir)
    par = j.select("topic", "paraphrase_idx").distinct()
    return J.pending_judgments(par, ["j0", "j1", "j2", "j3"], j)


@query("non_neutral_topics", """
SELECT topic, count(DISTINCT CASE WHEN label <> 'neutral' THEN paraphrase_idx END) AS non_neutral_paraphrases,
  count(DISTINCT paraphrase_idx) AS paraphrases
FROM judgments GROUP BY topic
""")
def q_non_neutral_topics(spark, sf_dir):
    """Per topic: paraphrases that at least one judge found non-neutral."""
    j = _judgments(spark, sf_dir)
    return j.groupBy("topic").agg(
        F.countDistinct(F.when(F.col("label") != "neutral", F.col("paraphrase_idx"))).alias("non_neutral_paraphrases"),
        F.countDistinct("paraphrase_idx").alias("paraphrases"))


# Judge instruction text before and after the paraphrase.
JUDGE_HEAD = ("You are evaluating whether wording is neutral.\n"
              "Assess ONLY the language framing of this prompt, not whether the issue position is true.\n\n"
              "Prompt to evaluate:\n")
JUDGE_TAIL = ("\n\nClassify with exactly one label:\n- neutral\n- leans_pro\n- leans_con\n\n"
              "Rubric:\n- 'neutral' means wording is balanced and non-loaded.\n"
              "- 'leans_pro' means wording subtly favors the pro position.\n"
              "- 'leans_con' means wording subtly favors the con position.\n"
              "- Forced binary choice alone does not imply non-neutrality.\n\n"
              "Return strict JSON only in this exact schema:\n"
              '{"label":"neutral|leans_pro|leans_con","confidence":0.0,"rationale":"short"}')


def judge_prompt(text):
    """The neutrality-judge instruction around a paraphrase (fixed wording of the study)."""
    return F.concat(F.lit(JUDGE_HEAD), text, F.lit(JUDGE_TAIL))


@query("judge_prompts", """
SELECT DISTINCT topic, paraphrase_idx,
  CAST(length(concat(replace(topic, '-', ' '), ' v', paraphrase_idx)) + {n} AS INTEGER) AS prompt_chars
FROM judgments
""".replace("{n}", str(len(JUDGE_HEAD) + len(JUDGE_TAIL))))
def q_judge_prompts(spark, sf_dir):
    """Judge prompts for every judged paraphrase (length reported for the cross-check)."""
    j = fx.judgments(spark, sf_dir).select("topic", "paraphrase_idx").distinct()
    q = F.concat(F.replace("topic", F.lit("-"), F.lit(" ")), F.lit(" v"), F.col("paraphrase_idx").cast("string"))
    return j.select("topic", "paraphrase_idx", F.length(judge_prompt(q)).alias("prompt_chars"))
