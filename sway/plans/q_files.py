"""Queries: the study's files written and read back (result CSVs, sorted lines, prompt files)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from sway.functions import prompts as PR
from sway.operators import ingest, shares
from sway.plans.catalog import query
from sway.session import checkpoint_dir, materialize
from sway.sources import fixtures as fx
from sway.sources import study_files as SF
from sway.sources.tables import read_table


def _folder(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def _counts(spark, sf_dir):
    return materialize(shares.stance_counts(fx.trials(spark, sf_dir)))


@query("csv_results", """
SELECT issue, issue_stance, "count", ecase, model FROM stance_counts
""")
def q_csv_results(spark, sf_dir):
    """Stance counts written as result CSVs in three layouts (as read; columns reordered; with a quoted remark that
    holds commas and quotes), beside CSVs of another kind, and read back by header: equals ``stance_counts``."""
    c = _counts(spark, sf_dir).withColumnRenamed("ecase", "case")
    at = _folder(spark, "csv-results")
    third = F.regexp_extract("model", r"(\d+)$", 1).cast("int") % 3
    remark = F.concat(F.lit('of "'), F.col("issue"), F.lit('", '), F.col("case"), F.lit(", all trials"))
    layouts = [c.select("issue", "issue_stance", "count", "case", F.concat("model", F.lit(".csv")).alias("model"), third.alias("part")),
               c.select("model", "case", "count", "issue_stance", "issue", third.alias("part")),
               c.select(remark.alias("remark"), "count", "issue", "model", F.lit("").alias("note"), "case", "issue_stance", third.alias("part"))]
    for i, d in enumerate(layouts):
        SF.write_table(d.where(F.col("part") == i).drop("part"), f"{at}/{i}", "csv")
    # share tables have no stance column and are left out by the reader
    SF.write_table(c.groupBy("model", "issue", "case").agg(F.sum("count").alias("count")), f"{at}/other", "csv")
    return SF.read_stance_csvs(spark, f"{at}/*").select("issue", "issue_stance", "count", "ecase", "model")


@query("sorted_results", """
SELECT row_number() OVER (ORDER BY model, ecase, issue, issue_stance) - 1 AS line_no, model, ecase, issue, issue_stance, "count"
FROM stance_counts
""")
def q_sorted_results(spark, sf_dir):
    """Stance counts written as JSON lines sorted by their key, read back with the number of each line."""
    at = _folder(spark, "sorted-results")
    SF.write_table(_counts(spark, sf_dir), at, "json", sort_by=["model", "ecase", "issue", "issue_stance"])
    lines = SF.read_lines(spark, at)
    row = F.from_json("value", "model string, ecase string, issue string, issue_stance string, count long")
    return lines.select("line_no", row.alias("r")).select("line_no", "r.*")


def _turns(spark, sf_dir):
    """Turns of conversations with the model they were held with and the request id of the conversation."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return c.withColumns({"model": F.concat(F.lit("m"), (F.col("conv_id") % 9).cast("string")),
                          "custom_id": F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))})


def prompt_files(spark, sf_dir) -> str:
    """Every user turn as a request line of its model's provider, in files prompts_<model>_<n>.jsonl in
    (conversation, turn) order; the folder."""
    u = _turns(spark, sf_dir).where("role = 'user'")
    value = PR.request_payload(PR.dialect_of(F.col("model")), F.col("model"), F.col("custom_id"), F.col("text"))
    lines = u.select(value.alias("value"), F.concat(F.lit("prompts_"), "model", F.lit(".jsonl")).alias("dir"), "conv_id", "turn", "text")
    at = _folder(spark, "prompt-files")
    keys = ["conv_id", "turn", "text"]
    lines.repartitionByRange(*keys).sortWithinPartitions("dir", *keys).select("value", "dir").write.partitionBy("dir").text(at)
    return at


def _reply_lines(spark, sf_dir):
    """Assistant turns as reply lines: those of the google and x dialects repeat the request and lost their id, the
    others carry the id and no request."""
    t = _turns(spark, sf_dir)
    asked = t.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("asked"))
    r = t.where("role = 'assistant'").join(asked, ["conv_id", "turn"])
    request = F.struct(F.array(F.struct(F.array(F.struct(F.col("asked").alias("text"))).alias("parts"))).alias("contents"))
    nameless = PR.dialect_of(F.col("model")).isin("google", "x")
    value = F.when(nameless, F.to_json(F.struct(request.alias("request"), F.col("text").alias("response")))).otherwise(
        F.to_json(F.struct("custom_id", F.col("text").alias("response"))))
    return r.select("model", "conv_id", "turn", nameless.alias("nameless"), value.alias("value"))


@query("prompt_lookup", """
WITH u AS (SELECT concat('m', conv_id % 9) AS model, concat('conv-', conv_id) AS custom_id, conv_id, turn, text,
             lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm FROM conversations WHERE role = 'user'),
lk AS (SELECT model, sha1(norm) AS h, arg_min(custom_id, conv_id * 1000000 + turn) AS id FROM u WHERE length(norm) > 0 GROUP BY ALL),
tx AS (SELECT model, custom_id, arg_max_null(text, turn) AS text FROM u GROUP BY ALL),
a AS (SELECT u.*, u.turn + 1 AS reply, (u.conv_id % 9) % 4 IN (2, 3) AS nameless FROM u
      JOIN conversations c ON c.conv_id = u.conv_id AND c.turn = u.turn + 1 AND c.role = 'assistant')
SELECT a.model, a.conv_id, a.reply AS turn, nameless AS recovered, CASE WHEN nameless THEN lk.id ELSE a.custom_id END AS custom_id,
  sha256(CASE WHEN nameless THEN a.text WHEN length(tx.text) > 0 THEN tx.text END) AS text_sha256
FROM a LEFT JOIN lk ON lk.model = a.model AND lk.h = sha1(a.norm) AND length(a.norm) > 0
LEFT JOIN tx ON tx.model = a.model AND tx.custom_id = a.custom_id
WHERE NOT nameless OR lk.id IS NOT NULL
""")
def q_prompt_lookup(spark, sf_dir):
    """Replies against the prompt files: ids that were lost come back by the request's hash (first line wins),
    request texts that weren't repeated come from the id (last line wins).  Each lookup reads the prompts of
    those models only that have such replies."""
    table = ingest.import_prompts(spark, prompt_files(spark, sf_dir), _folder(spark, "prompts"))
    lines = _reply_lines(spark, sf_dir)
    lost = ingest.prompts_of(spark, table, lines.where(F.col("nameless")))
    told = ingest.prompts_of(spark, table, lines.where(~F.col("nameless")))
    d = ingest.decode_predictions(lines, ingest.prompt_hash_lookup(lost))
    texts = ingest.prompt_text_lookup(told).withColumnRenamed("text", "stored")
    d = d.join(texts, ["model", "custom_id"], "left")
    text = F.when(F.col("nameless"), F.col("request_text")).otherwise(F.col("stored"))
    return d.select("model", "conv_id", "turn", F.col("nameless").alias("recovered"), "custom_id", F.sha2(text, 256).alias("text_sha256"))
