"""Queries: streaming ingest of prediction shards (build step 12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sway.plans.catalog import query
from sway.plans.q_parse import _ANSWER_SQL, _question_map
from sway.sources import fixtures as fx
from sway.streaming.retry_stream import run_retry_stream
from sway.streaming.stance_stream import run_stance_stream


def delivered_lines(spark, sf_dir):
    """(value, shard): reply lines with their model and a request id of their own (its trial number is
    made of the row's keys), as one model's requests have."""
    lines = fx.prediction_lines(spark, sf_dir)
    trial = F.concat(*[F.lpad(F.col(c).cast("long").cast("string"), n, "0") for c, n in (
        ("l_orderkey", 12), ("l_linenumber", 2), ("l_partkey", 12), ("l_suppkey", 10), ("l_quantity", 4))])
    value = F.regexp_replace(F.col("value"), F.lit("-[0-9]+-framing-"), F.concat(F.lit("-"), trial, F.lit("-framing-")))
    value = F.concat(F.lit('{"model":"'), F.col("model"), F.lit('",'), F.substring(value, F.lit(2), F.length(value)))
    return lines.select(value.alias("value"), (F.col("trial_num") % 4).alias("shard"))


@query("stream_stance_counts", """
SELECT issue, issue_stance, "count", ecase, model FROM stance_counts
""")
def q_stream_stance_counts(spark, sf_dir):
    """Prediction lines are written as four JSON shards, ingested with ``availableNow`` and counted once
    per (model, request id); the result equals the batch ``stance_counts``."""
    return run_stance_stream(spark, delivered_lines(spark, sf_dir), _question_map(spark, sf_dir)).select(
        "issue", "issue_stance", "count", "ecase", "model")


def retried_lines(spark, sf_dir):
    """(value, shard): every reply with its attempt and place; errors of the first attempt, and every second
    one of them again as attempt 1, in a shard before or after the first (see ``q_parse._delivered``)."""
    error = F.col("l_orderkey") % 11 == 0
    lines = fx.prediction_lines(spark, sf_dir)
    place = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    failed = F.to_json(F.struct(F.coalesce(F.get_json_object("value", "$.custom_id"), F.get_json_object(
        "value", "$.request.labels.custom_id")).alias("custom_id"), F.lit("ERROR: request failed").alias("response")))
    first = F.struct(F.lit(0).alias("attempt"), F.when(error, failed).otherwise(F.col("value")).alias("line"), (F.col("trial_num") % 4).alias("shard"))
    again = F.when(F.col("l_orderkey") % 22 == 0, F.struct(F.lit(1).alias("attempt"), F.col("value").alias("line"), ((F.col("trial_num") + 1) % 4).alias("shard")))
    d = lines.select("model", place.alias("place"), F.inline(F.filter(F.array(first, again), lambda x: x.isNotNull())))
    value = F.concat(F.lit('{"model":"'), "model", F.lit('","attempt":'), F.col("attempt").cast("string"), F.lit(',"place":'),
                     F.col("place").cast("string"), F.lit(","), F.substring("line", 2, 1 << 30))
    return d.select(value.alias("value"), "shard")


@query("stream_retry_counts", f"""
WITH u AS (SELECT *, 0 AS prio, CASE WHEN l_orderkey % 11 = 0 THEN 'ERROR: request failed' ELSE response_text END AS reply FROM responses
  UNION ALL SELECT *, 1, response_text FROM responses WHERE l_orderkey % 22 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, custom_id
             ORDER BY prio DESC, l_orderkey * 10 + l_linenumber DESC, encode(reply) DESC) AS rn FROM u),
p AS (SELECT *, {_ANSWER_SQL.format(t='reply')} AS answer FROM ranked WHERE rn = 1)
SELECT issue, CASE WHEN answer = 'Other' OR answer = '|' THEN 'other' WHEN answer = 'A' THEN question_stance
    WHEN question_stance = 'pro' THEN 'con' ELSE 'pro' END AS issue_stance, count(*) AS "count", ecase, model
FROM p GROUP BY ALL
""")
def q_stream_retry_counts(spark, sf_dir):
    """Replies and retries as shards through the retracting stream: equals ``retry_merge``,
    then a count of the stances."""
    return run_retry_stream(spark, retried_lines(spark, sf_dir), _question_map(spark, sf_dir)).select(
        "issue", "issue_stance", "count", "ecase", "model")
