"""Quality rules whose cutoffs limit false rejections, in DataFrame functions only.

Base counts of every text (words, symbols, repeated lines, repeated eight-word windows) give the base
checks and a few scores, larger for worse texts.  What score is too large is decided per stratum
(a language) with labelled documents, in two halves that share no text:

* the tuning half proposes: level j of a stratum puts the cutoff of each score at the LEVELS[j] quantile of the
  good texts' scores, so levels grow stricter, and a text that one level rejects is rejected by all that follow; a
  score by which the strictest level hardly tells bad from good texts has no cutoffs there;
* the holdout half disposes: level j is certified if the good texts it rejects are so few that, were its true rate
  of false rejection above ``risk``, at most that few would be seen with a probability below the allowed
  error.  That probability is an exact binomial tail.

Levels are tested from the most lenient on and the first that fails ends the sequence, so the levels
of a stratum need no correction among each other; the strata share the error evenly (Bonferroni).  So with
probability 1 - ``error`` or more, no stratum rejects more than ``risk`` of its good texts (those the base checks
pass).  Of the certified levels each stratum takes the one that best parts bad from good texts of
the tuning half.  A stratum with too few labelled texts to certify any rejects by the base checks alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sway.llm.common import prepare, shared_table

#: Words of a window, words a text needs, and the share (in %) of its words that repeated windows may cover.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
# The characters that part words, and those that count as symbols.
SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
CAPITALS = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
#: Quantiles of the good tuning texts' scores at which the levels cut, most lenient first.
LEVELS = (0.999, 0.998, 0.995, 0.99, 0.985, 0.98, 0.97, 0.95)
#: A score counts in a stratum if the strictest level rejects this many times more of the bad than of the good tuning texts by it.
TELLING = 3
#: Share of good texts a stratum may reject, and the probability that any stratum rejects more.
RISK, ERROR = 0.02, 0.05
#: Scores are counted in steps of a thousandth up to this number, so a histogram has a bounded number of rows.
STEPS, MOST = 1000, 100


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), "")


def _covered(windows: Column) -> Column:
    """Words within windows whose hash occurs twice or more: neighbours in the order of hashes are equal; in
    the order of places, a window adds the words that the next one doesn't hold."""
    dealt = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
    places = let(dealt, lambda s: F.sort_array(F.filter(
        F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x["at"])), lambda at: at.isNotNull())))
    return let(places, lambda p: F.aggregate(
        F.transform(p, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - at, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))


def _repeated(words: Column) -> Column:
    """Words of a text in windows of WINDOW words that the text holds twice or more."""
    windows = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(0))
    return F.when(F.size(words) > WINDOW, counted).otherwise(0)


def base_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and the counts of every whole text: n_words, word_chars, n_symbols, n_capitals, n_lines
    (lines with a word), n_dup_lines, n_repeat_words, and base_failed.

    A null text has no words.  Equal windows are found by 64-bit hashes within one text."""
    content = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(F.col("__text"), "\n", -1), lambda line: line.rlike("[^ \\t-\\r]"))
    without = lambda chars: F.length(F.translate(F.col("__text"), chars, ""))
    counts = F.struct(
        let(words_of(F.col("__text")), lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("repeated"))).alias("words"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("unlike"))).alias("lines"),
        without(SPACES).alias("word_chars"), (F.length("__text") - without(SYMBOLS)).alias("n_symbols"),
        (F.length("__text") - without(CAPITALS)).alias("n_capitals"))
    kept = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]
    # made by a generator, so that no later use of a count computes it again
    found = docs.select(*kept, content.alias("__text")).select(*[k for k in [f"__k{i}" for i in range(len(keep))]], F.inline(F.array(counts)))
    n, repeated = F.col("words.n").cast("long"), F.col("words.repeated").cast("long")
    return found.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], n.alias("n_words"), *[F.col(c).cast("long").alias(c) for c in ("word_chars", "n_symbols", "n_capitals")],
        F.col("lines.n").cast("long").alias("n_lines"), (F.col("lines.n") - F.col("lines.unlike")).cast("long").alias("n_dup_lines"), repeated.alias("n_repeat_words"),
        ((n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)).alias("base_failed"))


#: The scores of a text from its base counts, larger for worse.
def scores() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {"symbols": share("n_symbols", "n_words"), "capitals": share("n_capitals", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"),
            "repeats": share("n_repeat_words", "n_words"), "long_words": share("word_chars", "n_words"), "short_words": -share("word_chars", "n_words")}


def _steps(score: Column) -> Column:
    return F.floor(F.greatest(F.lit(float(-MOST)), F.least(F.lit(float(MOST)), score)) * STEPS).cast("int")


def _stirling_rest(x: Column) -> Column:
    """ln x! less Stirling's leading terms, of a whole number x of 1 or more."""
    x2 = x * x
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) / x2) / x2) / x2) / x
    small = F.least(x, F.lit(20.0))
    exact = F.ln(F.factorial(small.cast("int")).cast("double")) - (small + 0.5) * F.ln(small) + small - 0.5 * math.log(2 * math.pi)
    return F.when(x <= 20, exact).otherwise(series)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of X ~ Binomial(n, rate), for k below n * rate; 1 from there on (the tail is no evidence then), 1 for n = 0.

    The largest term comes from its deviance, so nothing underflows before the sum does; the terms before it
    fall by ratios that are known, and after ten standard deviations there is nothing left to add."""
    k, n = k.cast("double"), n.cast("double")
    inner = F.greatest(k, F.lit(1.0))
    away = lambda x, mean: x * F.ln(x / mean) + mean - x
    log_term = (_stirling_rest(n) - _stirling_rest(inner) - _stirling_rest(n - inner) - away(inner, n * rate) - away(n - inner, n * (1 - rate))
                + 0.5 * F.ln(n / (2 * math.pi * inner * (n - inner))))
    log_term = F.when(k == 0, n * math.log1p(-rate)).otherwise(log_term)
    last = F.least(k, F.floor(10 * F.sqrt(n)) + 50).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(0), last), start, lambda at, s: F.struct(
        (at["term"] * (k - s) * (1 - rate) / ((n - k + s + 1) * rate)).alias("term"), (at["sum"] + at["term"]).alias("sum")), lambda at: at["sum"])
    return F.when((n > 0) & (k < n * rate), F.least(F.lit(1.0), F.exp(log_term) * total)).otherwise(1.0)


def _stratum(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _rejecting_level(names: list[str]) -> Column:
    """First level whose cutoffs reject the text (1 to the number of levels, one more: none)."""
    passed = lambda name: F.size(F.filter(F.col(f"cut_{name}"), lambda cut: cut >= F.col(f"step_{name}")))
    return F.coalesce(F.least(*[passed(x) for x in names]) + 1, F.lit(len(LEVELS) + 1))


def fit(counted: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """The cutoffs of every stratum: (stratum, level, cut_<score> arrays, n_good, n_false, p_value, limit).

    ``counted`` has the base counts, the key, the stratum and text_hash; ``labels`` has the key and quality (1: good,
    0: bad).  A text counts once in its stratum however many documents hold it; of labels that disagree, good holds.
    Level 0 rejects nothing.  n_good, n_false and p_value are those of the chosen level in the holdout half."""
    names = list(scores())
    voted = labels.select(F.col(key).alias("__id"), F.col("quality").alias("__q")).where("__q is not null").groupBy("__id").agg(F.max(F.col("__q") > 0).alias("good"))
    rows = counted.where("not base_failed").select(F.col(key).alias("__id"), _stratum(stratum).alias("stratum"), "text_hash", *[_steps(c).alias(f"step_{x}") for x, c in scores().items()])
    texts = rows.join(voted, "__id").groupBy("stratum", "text_hash").agg(F.max("good").alias("good"), *[F.max(f"step_{x}").alias(f"step_{x}") for x in names])
    texts = shared_table(texts.withColumn("holdout", F.pmod(F.xxhash64("text_hash"), F.lit(2)) == 1), "labelled")

    each = texts.where("not holdout").select("stratum", "good", F.inline(F.array(*[F.struct(F.lit(x).alias("score"), F.col(f"step_{x}").alias("step")) for x in names])))
    histogram = each.groupBy("stratum", "score", "step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    within = Window.partitionBy("stratum", "score")
    placed = histogram.select("*", F.sum("good").over(within.orderBy("step")).alias("upto"), F.sum("good").over(within).alias("all"))
    strictest = LEVELS[-1]
    caught = F.try_divide(F.sum(F.when(F.col("upto") - F.col("good") >= strictest * F.col("all"), F.col("bad")).otherwise(0)), F.sum("bad"))
    cuts = placed.where(F.col("all") > 0).groupBy("stratum", "score").agg(
        F.array(*[F.min(F.when(F.col("upto") >= level * F.col("all"), F.col("step"))) for level in LEVELS]).alias("cuts"), caught.alias("caught"))
    cuts = cuts.withColumn("cuts", F.when(F.col("caught") >= TELLING * (1 - strictest), F.col("cuts")))
    cuts = shared_table(cuts.groupBy("stratum").agg(*[F.max(F.when(F.col("score") == x, F.col("cuts"))).alias(f"cut_{x}") for x in names]), "cuts")

    placed = texts.join(cuts, "stratum").withColumn("first", _rejecting_level(names))
    tallies = placed.groupBy("stratum", "holdout", "good", "first").count()
    levels = F.explode(F.sequence(F.lit(1), F.lit(len(LEVELS)))).alias("level")
    of = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0))
    hit = F.col("first") <= F.col("level")
    by_level = tallies.select("*", levels).groupBy("stratum", "level").agg(
        of(F.col("holdout") & F.col("good")).alias("n_good"), of(F.col("holdout") & F.col("good") & hit).alias("n_false"),
        of(~F.col("holdout") & F.col("good")).alias("tuned_good"), of(~F.col("holdout") & F.col("good") & hit).alias("tuned_false"),
        of(~F.col("holdout") & ~F.col("good")).alias("tuned_bad"), of(~F.col("holdout") & ~F.col("good") & hit).alias("tuned_caught"))
    strata = cuts.select(F.count(F.lit(1))).scalar()
    tested = by_level.withColumn("limit", F.lit(error) / strata).withColumn("p_value", binomial_tail(F.col("n_false"), F.col("n_good"), risk))
    so_far = Window.partitionBy("stratum").orderBy("level")
    gain = F.try_divide(F.col("tuned_caught").cast("double"), F.col("tuned_bad").cast("double")) - F.try_divide(F.col("tuned_false").cast("double"), F.col("tuned_good").cast("double"))
    tested = tested.withColumn("worst", F.max("p_value").over(so_far)).withColumn("gain", F.coalesce(gain, F.lit(0.0)))
    useful = (F.col("worst") <= F.col("limit")) & (F.col("gain") > 0)
    best = tested.where(useful).groupBy("stratum").agg(F.max(F.struct("gain", (-F.col("level")).alias("lenient"), "n_good", "n_false", "p_value", "limit")).alias("best"))
    return shared_table(cuts.join(best, "stratum", "left").select(
        "stratum", F.coalesce(-F.col("best.lenient"), F.lit(0)).alias("level"), *[f"cut_{x}" for x in names],
        *[F.col(f"best.{c}").alias(c) for c in ("n_good", "n_false", "p_value", "limit")]), "rules")


def judge(counted: DataFrame, rules: DataFrame, stratum: str = "lang") -> DataFrame:
    """Add kept, rejected_by (``base``, a score's name, or null) and level to rows with base counts.

    A stratum without rules rejects by the base checks alone."""
    names = list(scores())
    cut = lambda x: F.when(F.col("level") > 0, F.get(F.col(f"cut_{x}"), F.col("level") - 1))
    known = rules.select(F.col("stratum").alias("__stratum"), F.col("level").alias("__level"), *[cut(x).alias(f"__cut_{x}") for x in names])
    named = reduce(lambda rest, x: F.when(_steps(scores()[x]) > F.col(f"__cut_{x}"), x).otherwise(rest), reversed(names), F.lit(None).cast("string"))
    out = counted.join(known, _stratum(stratum) == F.col("__stratum"), "left")
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(named))
    return out.select(*counted.columns, F.col("rejected_by").isNull().alias("kept"), "rejected_by", F.coalesce("__level", F.lit(0)).alias("level"))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Base counts and verdict of every document: the key, the stratum, the counts, base_failed, kept, rejected_by, level.

    Null texts fail the base checks; a null stratum is one of its own; documents with a null key are judged but have
    no labels; repeated rows are judged alike; labels of unknown documents, or null ones, say nothing; without
    labels, or with too few, the base checks alone decide; an empty table gives no rows; other columns are not read."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col(key).alias("doc_id"), F.col(stratum).cast("string").alias("lang"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    counted = shared_table(base_counts(slim, ["doc_id", "lang", "text_hash"]), "counted")
    rules = fit(counted, labels.select(F.col(key).alias("doc_id"), "quality"), risk=risk, error=error)
    return judge(counted, rules).drop("text_hash").withColumnsRenamed({"doc_id": key, "lang": stratum})
