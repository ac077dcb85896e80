"""URL filter: host and path rules first, gradient-boosted trees on lexical features otherwise.

The trees learn from labelled URLs, here those that a rule decides.  Features: lengths, depth,
digit ratio, character entropy, parameter counts, and suffix statistics, the smoothed share of
blocked URLs among all labelled ones with the same host suffix.  Suffixes are hashed to a
fixed number of buckets, so their table has a proven size.  Everything is DataFrame work and
Spark's own tree learner.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sway.llm.common import prepare, shared_table


@dataclass(frozen=True)
class Rule:
    """``verdict`` for URLs of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Labelled URLs that the trees are fitted on at most (a hash picks about half as many where
#: there are more); suffix statistics count all labelled URLs.
TRAIN_ROWS = 40_000
#: Share of the bound that the rarer verdict gets at least.
LEAST_SHARE = 0.05
#: Hash buckets of each kind of suffix, and the weight of the overall share in small ones.
SUFFIXES, PRIOR = 1024, 20
FEATURES = ("chars", "host_chars", "path_chars", "depth", "labels", "digits", "entropy", "params", "dashes", "top_rate", "site_rate")


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))
    return F.when(F.instr(url, F.lit("://")) > 0, _lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise("")


def path_of(url: Column) -> Column:
    """Text from the end of the host up to ``?``, ``#`` or the end; else empty."""
    rest = F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))
    return F.when(F.instr(url, F.lit("://")) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule that fits, or null."""
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.name)) for r in longest]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of a text."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return -F.aggregate(F.transform(letters, share), F.lit(0.0), lambda a, p: a + p * F.log2(p))


def _count(text: Column, mark: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("double")


def features(df: DataFrame) -> DataFrame:
    """Add the lexical features and suffix buckets of __url, __host and __path."""
    url, host, path = F.coalesce("__url", F.lit("")), F.col("__host"), F.col("__path")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return df.select(
        "*", F.length(url).cast("double").alias("chars"), F.length(host).cast("double").alias("host_chars"),
        F.length(path).cast("double").alias("path_chars"), _count(path, "/").alias("depth"),
        _count(host, ".").alias("labels"),
        F.coalesce(F.try_divide(F.length(F.regexp_replace(url, "[^0-9]", "")), F.length(url)), F.lit(0.0)).alias("digits"),
        F.coalesce(_entropy(url), F.lit(0.0)).alias("entropy"),
        F.when(query == "", 0.0).otherwise(_count(query, "&") + 1).alias("params"),
        (_count(url, "-") + _count(url, "_")).alias("dashes"),
        F.pmod(F.xxhash64(F.substring_index(host, ".", -1)), F.lit(SUFFIXES)).alias("__top"),
        F.pmod(F.xxhash64(F.substring_index(host, ".", -2)), F.lit(SUFFIXES)).alias("__site"))


def _with_rates(df: DataFrame, rates: dict[str, DataFrame], overall: float) -> DataFrame:
    for kind, stats in rates.items():
        # At most SUFFIXES rows of three numbers.
        df = (df.join(F.broadcast(stats), f"__{kind}", "left")
              .withColumn(f"{kind}_rate", (F.coalesce("bad", F.lit(0)) + PRIOR * overall) / (F.coalesce("seen", F.lit(0)) + PRIOR))
              .drop("bad", "seen"))
    return df


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id", train_rows: int = TRAIN_ROWS,
          trees: int = 12, depth: int = 4, seed: int = 7) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every row.

    A rule's verdict holds where a rule fits (block_score is null there); otherwise the trees'.
    Null URLs and those without ``://`` have an empty host and path and get the trees' verdict like
    any other.  If the labelled URLs are all of one verdict, that is the verdict of the others too;
    without any, it is allow.  Repeated rows keep a row each; other columns are not read."""
    prepare(pages.sparkSession)
    named = (pages.select(F.col(key).alias("__key"), F.col(url).alias("__url"))
             .withColumns({"__host": host_of(F.col("__url")), "__path": path_of(F.col("__url"))})
             .withColumn("__rule", rule_of(F.col("__host"), F.col("__path"), rules)))
    verdict = F.coalesce(*[F.when(F.col("__rule") == r.name, F.lit(r.verdict)) for r in rules], F.lit(None).cast("string"))
    known = features(named.withColumn("__verdict", verdict))
    labelled = known.where("__verdict is not null").withColumn("label", (F.col("__verdict") == "block").cast("double"))
    tally = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows
    bad, seen = tally.get(1.0, 0), sum(tally.values())
    out = [F.col("__key").alias("page_id"), F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule")]
    if not bad or bad == seen:
        rest = "block" if bad else "allow"
        return known.select(*out, F.coalesce("__verdict", F.lit(rest)).alias("verdict"),
                            F.when(F.col("__verdict").isNull(), F.lit(float(bool(bad)))).alias("block_score"))
    rates = {kind: shared_table(labelled.groupBy(f"__{kind}").agg(F.count("*").alias("seen"), F.sum("label").alias("bad")), kind)
             for kind in ("top", "site")}
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="__features")
    # As many of each verdict as its share of the labelled URLs, but at least a LEAST_SHARE of the bound.
    share = {label: min(1.0, max(train_rows / seen, LEAST_SHARE * train_rows / count)) for label, count in tally.items()}
    bar = F.when(F.col("label") == 1.0, int(share[1.0] * (1 << 30))).otherwise(int(share[0.0] * (1 << 30)))
    sample = labelled.where(F.pmod(F.xxhash64("__key", "__url", F.lit(seed)), F.lit(1 << 30)) < bar)
    lexical = [c for c in FEATURES if not c.endswith("_rate")]
    # Rows alike in all features are one row of that weight.
    sample = sample.groupBy("label", "__top", "__site", *lexical).agg(F.count("*").alias("alike"))
    train = shared_table(_with_rates(sample, rates, bad / seen).select(
        "label", *FEATURES, F.when(F.col("label") == 1.0, F.col("alike") / share[1.0]).otherwise(F.col("alike") / share[0.0]).alias("__weight")), "urls")
    model = GBTClassifier(labelCol="label", featuresCol="__features", predictionCol="__prediction", weightCol="__weight",
                          maxIter=trees, maxDepth=depth, seed=seed).fit(assembler.transform(train))
    scored = model.transform(assembler.transform(_with_rates(known, rates, bad / seen)))
    score = F.get(vector_to_array("probability"), 1)
    return scored.select(*out, F.coalesce("__verdict", F.when(F.col("__prediction") == 1.0, "block").otherwise("allow")).alias("verdict"),
                         F.when(F.col("__verdict").isNull(), score).alias("block_score"))
