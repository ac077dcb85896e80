"""Queries: parsing chain from raw reply lines to trials (build step 2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sway.functions import parse as P
from sway.operators import ingest
from sway.plans.catalog import query
from sway.sources import fixtures as fx
from sway.sources.tables import read_table
from pyspark.sql.window import Window as W

_ANSWER_SQL = """coalesce(upper(coalesce(
    nullif(regexp_extract({t}, '(?i)position ([A|B])', 1), ''),
    nullif(regexp_extract({t}, '(?i)position <<([A|B])>>', 1), ''),
    nullif(regexp_extract({t}, '(?i)<<([A|B])>>', 1), ''),
    nullif(regexp_extract({t}, '(?i)^\\s*([A|B])\\s*$', 1), ''))), 'Other')"""


def _question_map(spark, sf_dir):
    """Topic dimension: one question text per issue (from the ``part`` dimension table)."""
    return fx.issues_dim(spark, sf_dir).select("question", "issue",
                                               F.lit(None).cast("string").alias("orientation"))


@query("parse_answers", f"""
, p AS (
  SELECT model, l_orderkey, l_linenumber, custom_id, {_ANSWER_SQL.format(t='response_text')} AS llm_answer,
    lower(replace(regexp_extract(custom_id, 'request-(.*?)-(\\d+)-framing', 1), '_', ' ')) AS question,
    CAST(regexp_extract(custom_id, 'request-(.*?)-(\\d+)-framing', 2) AS INTEGER) AS trial_num,
    regexp_extract(custom_id, '-framing-(.*?)-evidence-', 1) AS question_stance,
    split_part(custom_id, '-evidence-', 2) AS ecase
  FROM responses)
SELECT model, coalesce(q.issue, 'unknown') AS issue, ecase, trial_num, question, question_stance, llm_answer,
  CASE WHEN question_stance = 'pro' AND llm_answer = 'A' THEN 'pro'
       WHEN question_stance = 'con' AND llm_answer = 'A' THEN 'con'
       WHEN question_stance = 'pro' AND llm_answer = 'B' THEN 'con'
       WHEN question_stance = 'con' AND llm_answer = 'B' THEN 'pro' ELSE 'other' END AS issue_stance,
  l_orderkey, l_linenumber
FROM p LEFT JOIN issues_dim q USING (question)
""".replace("\n, p AS", "WITH p AS", 1))
def q_parse_answers(spark, sf_dir):
    """JSON reply lines in four dialects -> id parse -> answer -> topic lookup -> stance."""
    lines = fx.prediction_lines(spark, sf_dir).select("model", "l_orderkey", "l_linenumber", "value")
    dec = ingest.decode_predictions(lines)
    parsed = ingest.parsed_ids(dec)
    t = ingest.enrich_trials(parsed, _question_map(spark, sf_dir), stance_from="framing")
    return t.select("model", "issue", "ecase", "trial_num", "question", "question_stance",
                    "llm_answer", "issue_stance", "l_orderkey", "l_linenumber")


@query("parse_ids", """
SELECT lower(replace(regexp_extract(custom_id, 'request-(.*?)-(\\d+)-framing', 1), '_', ' ')) AS question,
  CAST(regexp_extract(custom_id, 'request-(.*?)-(\\d+)-framing', 2) AS INTEGER) AS trial_num,
  regexp_extract(custom_id, '-framing-(.*?)-evidence-', 1) AS framing,
  split_part(custom_id, '-evidence-', 2) AS ecase, count(*) AS n
FROM responses GROUP BY 1, 2, 3, 4
""")
def q_parse_ids(spark, sf_dir):
    r = fx.responses(spark, sf_dir).select("custom_id")
    return (ingest.parsed_ids(r).groupBy("question", "trial_num", "framing", "ecase")
            .agg(F.count(F.lit(1)).alias("n")))


def _conv_prompts(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    users = c.filter(F.col("role") == "user")
    return users.select(F.lit("conv").alias("model"),
                        F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("-"),
                                 F.col("turn").cast("string")).alias("custom_id"),
                        "text", F.struct("conv_id", "turn").alias("line_no"), "conv_id", "turn")


@query("hash_recovery", """
WITH u AS (SELECT conv_id, turn, text,
             concat('conv-', conv_id, '-', turn) AS custom_id,
             CASE WHEN length(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) > 0
                  THEN sha1(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) END AS h
           FROM conversations WHERE role = 'user'),
lk AS (SELECT h, arg_min(custom_id, conv_id * 1000000 + turn) AS custom_id FROM u
       WHERE h IS NOT NULL GROUP BY h),
a AS (SELECT c.conv_id, c.turn, u.h FROM conversations c
      JOIN u ON u.conv_id = c.conv_id AND u.turn = c.turn - 1 WHERE c.role = 'assistant')
SELECT a.conv_id, a.turn, lk.custom_id AS recovered_id FROM a LEFT JOIN lk ON lk.h = a.h
""")
def q_hash_recovery(spark, sf_dir):
    """Replies without an id get it back through the hash of their request text.

    Replies are assistant turns whose request is the preceding user turn;
    the lookup keys every user turn by its normalised-text hash, first wins.
    """
    prompts = _conv_prompts(spark, sf_dir)
    lookup = ingest.prompt_hash_lookup(prompts.select("model", "custom_id", "text", "line_no"))
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    replies = (c.filter(F.col("role") == "assistant")
               .join(prompts.select("conv_id", (F.col("turn") + 1).alias("turn"), "text"),
                     ["conv_id", "turn"]))
    r = replies.select("conv_id", "turn", F.lit("conv").alias("model"),
                       P.request_text_hash(F.col("text")).alias("text_hash"))
    return (r.join(lookup, ["model", "text_hash"], "left")
            .select("conv_id", "turn", F.col("custom_id").alias("recovered_id")))


def _delivered(spark, sf_dir):
    """Original and retry deliveries from one scan: every reply yields its original (an
    error when l_orderkey % 11 = 0) and, when l_orderkey % 22 = 0, a retried copy."""
    r = fx.responses(spark, sf_dir).select("model", "custom_id", "response_text", "l_orderkey", "l_linenumber")
    orig = F.struct(F.lit(0).alias("_prio"), F.when(F.col("l_orderkey") % 11 == 0, F.lit("ERROR: request failed"))
                    .otherwise(F.col("response_text")).alias("response_text"))
    retry = F.when(F.col("l_orderkey") % 22 == 0, F.struct(F.lit(1).alias("_prio"),
                                                           F.col("response_text").alias("response_text")))
    d = r.select("model", "custom_id", "l_orderkey", "l_linenumber",
                 F.explode(F.filter(F.array(orig, retry), lambda x: x.isNotNull())).alias("d"))
    return d.select("model", "custom_id", "l_orderkey", "l_linenumber", "d._prio", "d.response_text")


@query("retry_merge", """
WITH o AS (SELECT model, custom_id, l_orderkey, l_linenumber, 0 AS prio,
             CASE WHEN l_orderkey % 11 = 0 THEN 'ERROR: request failed' ELSE response_text END AS response_text
           FROM responses),
rt AS (SELECT model, custom_id, l_orderkey, l_linenumber, 1 AS prio, response_text FROM responses
       WHERE l_orderkey % 22 = 0),
u AS (SELECT * FROM o UNION ALL SELECT * FROM rt),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, custom_id ORDER BY prio DESC, l_orderkey DESC,
             l_linenumber DESC, response_text DESC) AS rn FROM u)
SELECT custom_id, model, response_text, l_orderkey, l_linenumber, prio = 1 AS from_retry,
       starts_with(response_text, 'ERROR:') AS is_error
FROM ranked WHERE rn = 1
""")
def q_retry_merge(spark, sf_dir):
    d = _delivered(spark, sf_dir)
    m = ingest.merge_prioritized(d, order_cols=("l_orderkey", "l_linenumber"))
    return m.select("custom_id", "model", "response_text", "l_orderkey", "l_linenumber", "from_retry",
                    F.col("response_text").startswith("ERROR:").alias("is_error"))


@query("unpredicted_prompts", """
SELECT DISTINCT model, custom_id FROM responses p
WHERE NOT EXISTS (SELECT 1 FROM responses r WHERE r.l_orderkey % 11 <> 0 AND r.model = p.model AND r.custom_id = p.custom_id)
""")
def q_unpredicted_prompts(spark, sf_dir):
    r = fx.responses(spark, sf_dir).select("model", "custom_id", "l_orderkey")
    # one aggregation per request instead of distinct + anti join over two scans
    g = r.groupBy(*ingest.REPLY_KEY).agg(F.bool_or(F.col("l_orderkey") % 11 != 0).alias("_pred"))
    return g.filter(~F.col("_pred")).select("model", "custom_id")


@query("error_rows", """
WITH ids AS (SELECT DISTINCT model, custom_id FROM responses WHERE l_orderkey % 11 = 0)
SELECT r.model, count(*) FILTER (WHERE l_orderkey % 11 = 0) AS n_errors, count(DISTINCT ids.custom_id) AS n_error_ids,
  count(*) FILTER (WHERE ids.custom_id IS NOT NULL) AS n_prompts_for_errors, count(*) FILTER (WHERE l_orderkey % 22 = 0) AS n_retried
FROM responses r LEFT JOIN ids ON ids.model = r.model AND ids.custom_id = r.custom_id GROUP BY r.model
""")
def q_error_rows(spark, sf_dir):
    """Per model: error replies, requests with one, their deliveries, and retries."""
    d = fx.responses(spark, sf_dir).select("model", "custom_id", "l_orderkey")
    err = F.col("l_orderkey") % 11 == 0
    g = d.groupBy(*ingest.REPLY_KEY).agg(F.count(F.lit(1)).alias("rows"), F.count_if(err).alias("errs"),
                                         F.count_if(F.col("l_orderkey") % 22 == 0).alias("retried"))
    return g.groupBy("model").agg(
        F.sum("errs").alias("n_errors"), F.count_if(F.col("errs") > 0).alias("n_error_ids"),
        F.coalesce(F.sum(F.when(F.col("errs") > 0, F.col("rows"))), F.lit(0)).alias("n_prompts_for_errors"),
        F.sum("retried").alias("n_retried"))


@query("resend_prompts", """
SELECT DISTINCT model, custom_id, lower(replace(regexp_extract(custom_id, 'request-(.*?)-(\\d+)-framing', 1), '_', ' ')) AS question
FROM responses WHERE l_orderkey % 11 = 0
""")
def q_resend_prompts(spark, sf_dir):
    """The requests to send again: those with an error reply, once each."""
    r = fx.responses(spark, sf_dir).select(
        "model", "custom_id", F.when(F.col("l_orderkey") % 11 == 0, F.lit("ERROR: request failed"))
        .otherwise(F.col("response_text")).alias("response_text"))
    again = ingest.error_rows(r).select(*ingest.REPLY_KEY).distinct()
    return again.withColumn("question", P.id_question(F.col("custom_id")))


@query("prompt_texts", """
WITH u AS (SELECT concat('m', conv_id % 9) AS model, concat('conv-', conv_id) AS custom_id, turn, text FROM conversations WHERE role = 'user')
SELECT model, custom_id, sha256(arg_max_null(text, turn)) AS text_sha256 FROM u GROUP BY model, custom_id
HAVING length(arg_max_null(text, turn)) > 0
""")
def q_prompt_texts(spark, sf_dir):
    """Prompt text of each request, the last line wins."""
    c = read_table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    prompts = c.select(F.concat(F.lit("m"), (F.col("conv_id") % 9).cast("string")).alias("model"),
                       F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("custom_id"),
                       "text", F.col("turn").alias("line_no"))
    return ingest.prompt_text_lookup(prompts).select("model", "custom_id", F.sha2("text", 256).alias("text_sha256"))


@query("unparsed_sample", f"""
WITH o AS (SELECT custom_id, l_orderkey, l_linenumber, response_text FROM responses
           WHERE {_ANSWER_SQL.format(t='response_text')} = 'Other')
SELECT custom_id, l_orderkey, l_linenumber, response_text, (SELECT count(*) FROM o) AS n_other
FROM o ORDER BY custom_id, l_orderkey, l_linenumber LIMIT 100
""")
def q_unparsed_sample(spark, sf_dir):
    """First 100 unparsed replies (the QA listing) with the total count."""
    r = fx.responses(spark, sf_dir).select("custom_id", "l_orderkey", "l_linenumber", "response_text")
    o = P.with_answer(r).filter(F.col("llm_answer") == "Other").drop("llm_answer")
    top = o.orderBy("custom_id", "l_orderkey", "l_linenumber").limit(100)
    return top.select("*", o.select(F.count(F.lit(1))).scalar().alias("n_other"))


@query("framing_audit", """
WITH ids AS (SELECT DISTINCT custom_id,
               lower(replace(regexp_extract(custom_id, 'request-(.*?)-(\\d+)-framing', 1), '_', ' ')) AS question,
               regexp_extract(custom_id, '-framing-(.*?)-evidence-', 1) AS framing FROM responses),
par AS (SELECT lower(replace(topic, '-', ' ')) AS question, topic AS issue, paraphrase_idx FROM paraphrases_dim)
SELECT ids.custom_id, par.issue, count(*) AS n_late_paraphrases
FROM ids JOIN par ON ids.question = par.question
WHERE par.paraphrase_idx >= 4 AND ids.framing = 'pro'
GROUP BY ids.custom_id, par.issue
""")
def q_framing_audit(spark, sf_dir):
    """Ids issued with framing 'pro' for questions whose paraphrase index is >= 4."""
    ids = ingest.parsed_ids(fx.responses(spark, sf_dir).select("custom_id").distinct())
    par = (fx.paraphrases_dim(spark, sf_dir).select(F.col("topic").alias("issue"), "paraphrase_idx")
           .filter(F.col("paraphrase_idx") >= 4)
           .withColumn("question", F.lower(F.replace("issue", F.lit("-"), F.lit(" ")))))
    j = ids.filter(F.col("framing") == "pro").join(par, "question")
    return j.groupBy("custom_id", "issue").agg(F.count(F.lit(1)).alias("n_late_paraphrases"))


@query("batch_ingest", """
SELECT issue, issue_stance, "count", ecase, model FROM stance_counts
""")
def q_batch_ingest(spark, sf_dir):
    """Reply lines written as JSONL shards ``predictions_<model>_<n>.jsonl`` (with blank,
    large-file-pointer and malformed lines mixed in), read back line by line with the model
    taken from the path, decoded and counted: equals ``stance_counts``."""
    import os
    import uuid

    from sway.operators import shares
    from sway.session import checkpoint_dir

    lines = fx.prediction_lines(spark, sf_dir)
    shard = (F.col("trial_num") % 4).cast("string")
    d = F.concat(F.lit("predictions_"), F.col("model"), F.lit("_"), shard, F.lit(".jsonl"))
    good = lines.select(F.col("value"), d.alias("dir"))
    m3 = F.col("l_linenumber") % 3
    junk = lines.filter(F.col("l_orderkey") % 97 == 0).select(
        F.when(m3 == 0, F.lit("")).when(m3 == 1, F.lit("version https://git-lfs.github.com/spec/v1"))
         .otherwise(F.lit('{"custom_id": "request-broken')).alias("value"), d.alias("dir"))
    path = os.path.join(checkpoint_dir(spark), f"batch-ingest-{uuid.uuid4().hex}")
    good.unionByName(junk).write.partitionBy("dir").text(path)
    raw = ingest.read_prediction_text(spark, path)
    dec = ingest.decode_predictions(raw)
    t = ingest.enrich_trials(ingest.parsed_ids(dec), _question_map(spark, sf_dir), stance_from="framing")
    return shares.stance_counts(t)


@query("prediction_prompts", """
WITH pr AS (SELECT concat('request-', replace(replace(i.issue, '-', ' '), ' ', '_'), '-', t.trial, '-framing-', f.framing,
              '-evidence-', c.ecase) AS custom_id, i.question
            FROM issues_dim i, range(1, 16) t(trial), (VALUES ('pro'), ('con')) f(framing),
              (VALUES ('neither'), ('pro'), ('75pro'), ('all'), ('75con'), ('con')) c(ecase)),
pp AS (SELECT sha256(custom_id) AS h, question FROM pr)
SELECT r.model, r.custom_id, r.l_orderkey, r.l_linenumber, sha256(r.custom_id) AS custom_id_hash, pp.question
FROM responses r LEFT JOIN pp ON pp.h = sha256(r.custom_id)
""")
def q_prediction_prompts(spark, sf_dir):
    """Replies joined to their prompt records on the SHA-256 of the request id (left join;
    the prompt records are the design's ids with their question, built from the issue
    dimension)."""
    r = fx.responses(spark, sf_dir).select("model", "custom_id", "l_orderkey", "l_linenumber")
    # prompt records of the design: issue x trial x framing x case, from the issue dimension
    i = fx.issues_dim(spark, sf_dir)
    ids = i.select("issue", "question", F.explode(F.sequence(F.lit(1), F.lit(fx.TRIALS))).alias("t"),
                   F.explode(F.array(F.lit("pro"), F.lit("con"))).alias("framing"))
    ids = ids.select("*", F.explode(F.array(*[F.lit(c) for c in fx.CASES])).alias("ecase"))
    cid = F.concat(F.lit("request-"), F.replace(F.replace("issue", F.lit("-"), F.lit(" ")), F.lit(" "), F.lit("_")),
                   F.lit("-"), F.col("t").cast("string"), F.lit("-framing-"), F.col("framing"),
                   F.lit("-evidence-"), F.col("ecase"))
    prompts = ids.select(F.sha2(cid, 256).alias("custom_id_hash"), "question")
    return (r.withColumn("custom_id_hash", F.sha2("custom_id", 256))
            .join(prompts, "custom_id_hash", "left")
            .select("model", "custom_id", "l_orderkey", "l_linenumber", "custom_id_hash", "question"))
