"""Raw prediction/prompt lines -> trials (scan, decode, key recovery, enrich)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sway.functions import parse as P

LFS_PREFIX = "version https://git-lfs"


def read_prediction_text(spark, path: str) -> DataFrame:
    """Line-oriented scan of prediction JSONL files with the model from the file name.

    Blank lines and large-file pointer lines are rejected before any JSON
    decoding; malformed JSON survives as a row whose parse is NULL and is
    dropped by ``decode_predictions``.
    """
    raw = spark.read.text(path).select(
        F.trim("value").alias("value"),
        P.model_from_file(F.col("_metadata.file_path")).alias("model"))
    return raw.filter((F.length("value") > 0) & ~F.col("value").startswith(LFS_PREFIX))


def decode_predictions(lines: DataFrame, prompt_lookup: DataFrame | None = None,
                       drop_missing_text: bool = False) -> DataFrame:
    """(model, value) JSON lines -> (model, custom_id, response_text, llm_answer, ...).

    ``prompt_lookup`` (model, text_hash, custom_id) recovers missing ids by
    request-text hash (first prompt line wins, see ``prompt_hash_lookup``).
    """
    # Parse inside a generator: filters on parsed fields (e.g. the id check below) cannot be
    # pushed beneath it, so the JSON is decoded once per line instead of once per reference.
    fields = ("custom_id", "llm_answer", "prompt_text", "request", "response")
    d = lines.select("*", F.inline(F.array(P.parse_prediction(F.col("value")))))
    d = d.select(*lines.columns, F.struct(*[F.col(c) for c in fields]).alias("j"))
    d = d.select(
        "*",
        P.custom_id_of(F.col("j")).alias("custom_id0"),
        P.request_text(F.col("j"), contents_first=True).alias("request_text"),
        P.response_text(F.col("value"), F.col("j")).alias("response_text"),
        F.col("j.llm_answer").alias("pre_answer")).withColumn("req_hash", P.request_text_hash(F.col("request_text")))
    if prompt_lookup is not None:
        lk = prompt_lookup.select("model", F.col("text_hash").alias("req_hash"),
                                  F.col("custom_id").alias("recovered_id"))
        d = d.join(lk, ["model", "req_hash"], "left")
        cid = F.coalesce(F.col("custom_id0"), F.col("recovered_id"))
    else:
        cid = F.col("custom_id0")
    d = d.withColumn("custom_id", cid).filter(F.col("custom_id").isNotNull())
    if drop_missing_text:
        # the notebooks drop replies without text; the scripts count them as 'Other'
        d = d.filter(F.length(F.col("response_text")) > 0)
    return d.drop("j", "custom_id0")


def import_prompts(spark, folder: str, path: str) -> str:
    """Prompt files ``prompts_<model>[_<n>].jsonl`` -> a Parquet table at ``path``, a folder for each model.

    (model, custom_id, text, line_no): ``line_no`` orders the lines of a model by file name and place.  Lines
    that are blank, pointers or no JSON are left out.  Returns ``path``."""
    raw = spark.read.text(folder).select(
        F.trim("value").alias("value"), P.model_from_file(F.col("_metadata.file_path"), "prompts").alias("model"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                 F.monotonically_increasing_id().alias("line")).alias("line_no"))
    raw = raw.filter((F.length("value") > 0) & ~F.col("value").startswith(LFS_PREFIX))
    j = raw.select("model", "line_no", F.inline(F.array(P.parse_prompt(F.col("value")))))
    j = j.filter(F.col("custom_id").isNotNull())
    j.select("model", "custom_id", "text", "line_no").write.partitionBy("model").parquet(path)
    return path


def prompts_of(spark, path: str, replies: DataFrame) -> DataFrame:
    """The imported prompts of the models that occur in ``replies``; other models' folders aren't read.

    The models (a row each) are broadcast, from which Spark prunes the folders at run time; that is safe at any
    size of ``replies``, as they are at most as many as the table has folders."""
    schema = "custom_id string, text string, line_no struct<file string, start long, line long>, model string"
    models = replies.select("model").distinct()
    return spark.read.schema(schema).parquet(path).join(F.broadcast(models), "model", "left_semi")


def prompt_hash_lookup(prompts: DataFrame) -> DataFrame:
    """(model, custom_id, text, line_no) -> one custom_id per (model, text hash), first line wins."""
    h = prompts.select("model", "custom_id", "line_no",
                       P.request_text_hash(F.col("text")).alias("text_hash"))
    h = h.filter(F.col("text_hash").isNotNull() & F.col("custom_id").isNotNull())
    return h.groupBy("model", "text_hash").agg(
        F.min_by("custom_id", "line_no").alias("custom_id"))


def parsed_ids(df: DataFrame, cid: str = "custom_id") -> DataFrame:
    """Add question, trial_num, framing, ecase from the packed id; drop unparsable ids."""
    c = F.col(cid)
    return (df.filter(P.id_is_valid(c))
            .withColumn("question", P.id_question(c))
            .withColumn("trial_num", P.id_trial(c))
            .withColumn("framing", P.id_framing(c))
            .withColumn("ecase", P.id_case(c)))


def enrich_trials(parsed: DataFrame, question_map: DataFrame, stance_from: str = "map") -> DataFrame:
    """Topic lookup on the lower-cased question (miss -> 'unknown') and stance mapping.

    ``question_map`` (question, issue, orientation) is a dimension whose size
    is the number of paraphrases; AQE broadcasts it when its runtime size is
    under the broadcast threshold and shuffles otherwise.
    """
    qm = question_map.select("question", F.col("issue").alias("_issue"),
                             F.col("orientation").alias("_orient"))
    j = parsed.join(qm, "question", "left")
    qs = F.coalesce(F.col("_orient"), F.lit("unknown")) if stance_from == "map" else F.col("framing")
    answer = P.final_answer(F.col("response_text"), F.col("pre_answer"))
    return (j.withColumn("issue", F.coalesce(F.col("_issue"), F.lit("unknown")))
             .withColumn("question_stance", qs)
             .withColumn("llm_answer", answer)
             .withColumn("issue_stance", P.issue_stance(F.col("question_stance"), F.col("llm_answer")))
             .drop("_issue", "_orient"))


REPLY_KEY = ("model", "custom_id")  # a request id says nothing of the model it was sent to


def merge_retries(originals: DataFrame, retries: DataFrame, key: tuple[str, ...] = REPLY_KEY,
                  order_cols: tuple[str, ...] = ()) -> DataFrame:
    """Upsert of retries over originals (see ``merge_prioritized``)."""
    u = (originals.withColumn("_prio", F.lit(0))
         .unionByName(retries.withColumn("_prio", F.lit(1)), allowMissingColumns=True))
    return merge_prioritized(u, key, order_cols)


def merge_prioritized(u: DataFrame, key: tuple[str, ...] = REPLY_KEY, order_cols: tuple[str, ...] = ()) -> DataFrame:
    """Upsert: a retry row replaces the original with the same key; the last line wins within a side.

    Written as ``max_by`` over a (priority, order...) struct rather than a
    window, so a key holding a large share of the rows is reduced map-side
    instead of being sorted in one task.
    """
    payload = [c for c in u.columns if c not in (*key, "_prio")]
    order = F.struct(F.col("_prio"), *[F.col(c) for c in order_cols],
                     *[F.col(c) for c in payload if c not in order_cols])
    best = u.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in payload + ["_prio"]]), order).alias("_b"))
    return best.select(*key, *[F.col("_b")[c].alias(c) for c in payload],
                       (F.col("_b._prio") == 1).alias("from_retry"))


def prompt_text_lookup(prompts: DataFrame) -> DataFrame:
    """(model, custom_id, text, line_no) -> the text of each (model, custom_id), last line wins;
    ids without a text are left out."""
    last = prompts.filter(F.col("custom_id").isNotNull()).groupBy("model", "custom_id").agg(
        F.max_by("text", "line_no").alias("text"))
    return last.filter(F.length("text") > 0)


def error_rows(predictions: DataFrame, text_col: str = "response_text") -> DataFrame:
    return predictions.filter(F.col(text_col).startswith("ERROR:"))
