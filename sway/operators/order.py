"""Order (recency) effects: does the model side with the last argument shown?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sway.functions.anchors import probe_anchors, text_passages
from sway.functions.stats import binom_p_half
from sway.session import materialize

ORDER_CASES = ("all", "75/25", "75pro", "75con", "con", "pro")
_MARK = r"\[\d+\]"


def order_counts(trials: DataFrame, weight: str | None = None) -> DataFrame:
    """Per (model, ecase, last_argument): trials, agreements with the last argument, share.

    An 'other' answer counts as disagreement, as in the study.  ``weight`` names a count
    column when the rows are already pre-aggregated."""
    t = trials.filter(F.col("ecase").isin(*ORDER_CASES) & F.col("last_argument").isNotNull()
                      & (F.col("issue") != "unknown"))
    agreed = F.col("issue_stance") == F.col("last_argument")
    if weight is None:
        aggs = [F.count(F.lit(1)).alias("total_trials"), F.count_if(agreed).alias("agreed_with_last_count")]
    else:
        aggs = [F.sum(weight).alias("total_trials"),
                F.coalesce(F.sum(F.when(agreed, F.col(weight))), F.lit(0)).alias("agreed_with_last_count")]
    g = t.groupBy("model", "ecase", "last_argument").agg(*aggs)
    return g.withColumn("agreed_with_last_pct", F.col("agreed_with_last_count") / F.col("total_trials"))


def order_effects(trials: DataFrame) -> DataFrame:
    """Order counts plus the exact two-sided binomial p against 50 %."""
    c = order_counts(trials)
    return c.withColumn("p_value_vs_50pct",
                        binom_p_half(F.col("agreed_with_last_count"), F.col("total_trials")))


def recency_rate(counts: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Per (model, ecase): agreement rate pooled over last-argument sides (weighted by
    trials) with a normal-approximation interval clipped to [0, 1]."""
    g = counts.groupBy("model", "ecase").agg(
        F.sum("agreed_with_last_count").alias("agreed"), F.sum("total_trials").alias("n"))
    rate = F.col("agreed") / F.col("n")
    half = z * F.sqrt(rate * (1 - rate) / F.col("n"))
    return g.select("model", "ecase", "n", rate.alias("recency_rate"),
                    F.greatest(F.lit(0.0), rate - half).alias("ci_low"),
                    F.least(F.lit(1.0), rate + half).alias("ci_high"))


def _strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def last_block_candidates(prompts: DataFrame) -> DataFrame:
    """(prompt_id, topic, text) -> candidate lines of the last argument shown.

    The last argument is the text before the final ``Citations:`` marker
    after its ``---`` separator; citation markers are removed and lines of
    at least 20 characters are kept, numbered from the bottom (pos 0 first; ``nth`` counts those kept).
    """
    p = prompts.filter(F.instr("text", "Citations:") > 0)
    parts = F.split(F.col("text"), "Citations:")
    block = F.try_element_at(parts, F.lit(-2))
    tail = F.element_at(F.split(block, "---\n"), -1)
    paras = F.filter(F.transform(F.split(block, "---\n"), lambda x: _strip(x)), lambda x: x != "")
    last = F.when(_strip(tail) != "", tail).otherwise(F.try_element_at(paras, F.lit(-1)))
    cleaned = _strip(F.regexp_replace(last, _MARK, ""))
    p = p.select("prompt_id", "topic", F.reverse(F.split(cleaned, "\n")).alias("lines"))
    kept = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("pos"), _strip(x).alias("line"))), lambda x: F.length(x["line"]) >= 20)
    c = p.select("prompt_id", "topic", F.posexplode(kept).alias("nth", "c")).select("prompt_id", "topic", "nth", "c.pos", "c.line")
    n = F.length("line")
    return c.select("prompt_id", "topic", "pos", "nth",
                    F.substring("line", 1, 50).alias("prefix"),
                    F.when(n >= 50, F.expr("substring(line, floor(length(line) / 2) + 1, 50)")).alias("mid"))


def _hits(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(prompt_id, best): the first (pos, kind, side) of the lines of each prompt that ``texts`` (topic, side, clean) hold."""
    probes = lines.select("prompt_id", "topic", "pos", F.inline(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("prefix").alias("probe")),
        F.struct(F.lit(1).alias("kind"), F.col("mid").alias("probe"))))).filter(F.col("probe").isNotNull())
    # a probe is as long as the grams of its class allow, so texts that share an anchor share most of the probe
    wanted = materialize(probes.select("topic", "probe").distinct().select("topic", "probe", F.inline(probe_anchors("probe"))), tidy=True)
    # copies of a passage are one row, of the side that wins ('pro' sorts after 'con')
    index = (texts.select("topic", "side", F.explode(text_passages("clean", wanted)).alias("p")).select("topic", "side", "p.*")
             .groupBy("topic", "gram", "anchor", "passage", "lead").agg(F.max("side").alias("side")))
    found = (index.join(wanted, ["topic", "gram", "anchor"])
             .filter((F.col("lead") >= F.col("offset")) & (F.substring("passage", F.col("lead") - F.col("offset") + 1, F.length("probe")) == F.col("probe")))
             .groupBy("topic", "probe").agg(F.max("side").alias("side")))
    return probes.join(found, ["topic", "probe"]).groupBy("prompt_id").agg(F.min(F.struct("pos", "kind", "side")).alias("best"))


def last_argument(prompts: DataFrame, arguments: DataFrame) -> DataFrame:
    """Side (pro/con) of the last argument in each prompt, or no row when not found.

    Candidate lines are matched bottom-up; for each, the 50-character prefix is looked up
    anywhere in the topic's pro arguments, then con, then the middle 50-character slice
    likewise; the first hit decides.  The lowest lines are searched first, the others only of
    prompts that these don't decide.  Each distinct probe of a round is searched once: candidates come from an
    equality join on (topic, anchor), which loses no containing argument, and are verified on the
    passage around the anchor.
    """
    cand = materialize(last_block_candidates(prompts), tidy=True)
    texts = arguments.select("topic", "side", _strip(F.regexp_replace(F.col("text"), _MARK, "")).alias("clean"))
    lowest = materialize(_hits(cand.filter("nth = 0"), texts), tidy=True)
    # ids may repeat: a line of another prompt of the id can still lie as low as the best
    open_ = cand.filter("nth > 0").join(lowest, "prompt_id", "left").filter("best is null or pos <= best.pos")
    others = _hits(materialize(open_.select("prompt_id", "topic", "pos", "prefix", "mid"), tidy=True), texts)
    best = lowest.unionByName(others).groupBy("prompt_id").agg(F.min("best").alias("best"))
    return best.select("prompt_id", F.col("best.side").alias("last_argument"))
