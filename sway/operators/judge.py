"""Neutrality judgments: reply parsing, label rates, agreement, review queue, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sway.functions.parse import clean_text

LABELS = ("neutral", "leans_pro", "leans_con", "unknown")


def parse_judge_reply(raw: Column) -> Column:
    """Struct(label, confidence, rationale) from a judge reply.

    Code fences are stripped; a JSON object gives label (if known),
    confidence and rationale; anything else falls back to keyword search
    with the first 300 characters as rationale.  Confidence is clamped to [0, 1].
    """
    cleaned = F.trim(F.replace(F.replace(F.trim(raw), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    is_obj = F.json_object_keys(cleaned).isNotNull()
    j = F.from_json(cleaned, "label string, confidence string, rationale string")
    jl = F.lower(F.trim(F.coalesce(j["label"], F.lit(""))))
    json_label = F.when(jl.isin("neutral", "leans_pro", "leans_con"), jl).otherwise("unknown")
    low = F.lower(cleaned)
    kw_label = (F.when(F.instr(low, "leans_pro") > 0, "leans_pro")
                .when(F.instr(low, "leans_con") > 0, "leans_con")
                .when(low.rlike(r"(?U)\bneutral\b"), "neutral").otherwise("unknown"))
    # a number, also quoted; a flag counts as 1 or 0; anything else fails the reply, whose label is then
    # searched by keyword as well
    said = F.nullif(F.trim(j["confidence"]), F.lit(""))
    number = F.when(said == "true", 1.0).when(said == "false", 0.0).otherwise(said.try_cast("double"))
    broken = is_obj & said.isNotNull() & number.isNull()
    conf = F.when(is_obj, F.coalesce(number, F.lit(0.0))).otherwise(F.lit(0.0))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))
    rationale = F.when(is_obj & ~F.coalesce(broken, F.lit(False)), F.coalesce(j["rationale"], F.lit(""))).otherwise(F.substring(cleaned, 1, 300))
    label = F.when(raw.isNull(), "unknown").when(
        F.coalesce(broken, F.lit(False)), F.when(kw_label != "unknown", kw_label).otherwise(json_label)).when(
        is_obj, json_label).otherwise(kw_label)
    return F.struct(label.alias("label"), F.when(raw.isNull(), 0.0).otherwise(conf).alias("confidence"),
                    F.when(raw.isNull(), "Non-string output.").otherwise(rationale).alias("rationale"))


def label_rates(j: DataFrame) -> DataFrame:
    """n, total and percent of each label per judge model (total by a window, not a join)."""
    from pyspark.sql.window import Window as W
    g = j.groupBy("judge_model", "label").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(W.partitionBy("judge_model"))
    return g.select("judge_model", "label", "n", tot.alias("total"), (F.col("n") / tot * 100.0).alias("pct"))


def agreement(j: DataFrame) -> DataFrame:
    """Per (topic, paraphrase_idx): judges, distinct labels, all-agree, majority %, label list."""
    first = j.groupBy("topic", "paraphrase_idx", "judge_model").agg(
        F.min("label").alias("label"))
    counts = first.filter(F.col("label").isNotNull() & (F.col("label") != "")).groupBy(
        "topic", "paraphrase_idx", "label").agg(F.count(F.lit(1)).alias("c"))
    per = counts.groupBy("topic", "paraphrase_idx").agg(
        F.sum("c").alias("n_models"), F.count(F.lit(1)).alias("n_unique_labels"),
        F.max("c").alias("max_count"))
    lab = first.filter(F.col("label").isNotNull()).groupBy("topic", "paraphrase_idx").agg(
        F.array_sort(F.collect_list(F.struct("judge_model", "label"))).alias("_l"))
    out = lab.join(per, ["topic", "paraphrase_idx"], "left")
    n = F.coalesce(F.col("n_models"), F.lit(0))
    return out.select(
        "topic", "paraphrase_idx", n.alias("n_models"),
        F.coalesce(F.col("n_unique_labels"), F.lit(0)).alias("n_unique_labels"),
        (F.coalesce(F.col("n_unique_labels"), F.lit(0)) == 1).alias("all_agree"),
        F.when(n > 0, F.col("max_count") / n * 100.0).otherwise(0.0).alias("majority_agreement_pct"),
        F.array_join(F.transform("_l", lambda s: F.concat(s["judge_model"], F.lit(":"), s["label"])), "; ")
         .alias("labels"))


def row_id(topic: Column, idx: Column, judge: Column, label: Column) -> Column:
    return F.sha1(F.concat_ws("|", topic.cast("string"), idx.cast("string"), judge, label))


def review_candidates(j: DataFrame, include_errors: bool = True) -> DataFrame:
    non_neutral = F.lower(F.coalesce(F.col("label"), F.lit(""))) != "neutral"
    cond = non_neutral
    if include_errors:
        cond = cond | (F.length(F.trim(F.coalesce(F.col("error"), F.lit("")))) > 0)
    return j.filter(cond).withColumn(
        "row_id", row_id(F.col("topic"), F.col("paraphrase_idx"), F.col("judge_model"), F.col("label")))


def review_queue(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates without a stored decision (anti join on row_id)."""
    return (candidates.join(decisions.select("row_id").distinct(), "row_id", "left_anti")
            .withColumn("error", clean_text(F.col("error"))))


def pending_judgments(paraphrases: DataFrame, judges: list[str], done: DataFrame) -> DataFrame:
    """(topic, paraphrase_idx) x judge models minus keys already judged (resume).

    The judge list is a short run parameter, expanded with ``explode``; the
    done keys are removed with an anti join.
    """
    grid = paraphrases.select("topic", "paraphrase_idx",
                              F.explode(F.array(*[F.lit(m) for m in judges])).alias("judge_model"))
    keys = done.select("topic", "paraphrase_idx", "judge_model").distinct()
    return grid.join(keys, ["topic", "paraphrase_idx", "judge_model"], "left_anti")
