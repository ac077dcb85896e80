"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves of a tree domain - language - source.  A token budget flows from the root
down: each node shares what it gets among its children by their weights.  A child whose subtree
can't use its share (tokens times the allowed epochs) gets what it can use, and the rest goes to its
siblings by weight; only what a whole node can't use reaches the siblings of its ancestors.

A leaf reads its documents in seeded epochs, each a new order of all of them, and takes the
prefix of that endless stream that covers its tokens: some whole epochs, then of one more
epoch the documents up to a bar.  The bar is found without sorting a leaf: tokens are summed per
bucket of the order, and only the bucket that holds the bar is ranked.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sway.llm.common import prepare, shared_table

LEVELS = ("domain", "lang", "source")
#: Buckets of a leaf's order.
BUCKETS = 4096
_HEX = 13  # digits of a place in an epoch's order: 52 bits


def place(key: Column, epoch: Column, seed: int) -> Column:
    """Place of a document in the order of an epoch, a number below 2^52."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _HEX), 16, 10).cast("long")


def filled(children: DataFrame, parent: list[str], budget: str, weight: str, most: str, out: str) -> DataFrame:
    """Share each parent's budget among its rows by weight, none above its most.

    Rows are served in the order of most / weight: while the next one's even share of what is left
    exceeds its most it gets its most, and the others share the rest by weight.  The children
    of a node are summaries, so a window over them is small."""
    order = Window.partitionBy(*parent).orderBy(F.col(most) / F.col(weight), *[c for c in LEVELS if c in children.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.col(budget) - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    weights = F.sum(weight).over(Window.partitionBy(*parent)) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    step = children.withColumn("__rate", F.greatest(left, F.lit(0.0)) / weights).withColumn("__turn", F.row_number().over(order))
    # The rate grows while rows are capped; from the first row that isn't, it is the final one.
    capped = F.col(most) <= F.col("__rate") * F.col(weight)
    step = step.withColumn("__final", F.min(F.when(~capped, F.struct("__turn", "__rate"))).over(Window.partitionBy(*parent))["__rate"])
    return step.withColumn(out, F.when(F.col("__final").isNull(), F.col(most)).otherwise(F.least(F.col(most), F.col("__final") * F.col(weight)))).drop("__rate", "__turn", "__final")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, float]], total: float, epochs: float) -> DataFrame:
    """(domain, lang, source, tokens, budget) of each leaf (domain, lang, source, tokens).

    ``weights`` has a weight for names of each level (1 where it has none, names are looked up per
    level); a weight of 0 leaves out all below the name.  ``budget`` is the leaf's tokens to take;
    their sum is ``total``, or all that the epochs allow in what is not left out if that is less."""
    if wrong := [(level, n, w) for level in LEVELS for n, w in weights.get(level, {}).items() if not 0 <= w < float("inf")]:
        raise ValueError(f"weights must be finite and not negative: {wrong}")

    def weight(level: str) -> Column:
        chosen = F.lit(1.0)
        for n, w in weights.get(level, {}).items():
            chosen = F.when(F.col(level) == n, F.lit(float(w))).otherwise(chosen)
        return chosen

    mixed = reduce(and_, [weight(level) > 0 for level in LEVELS])
    most = (leaves.groupBy(*LEVELS).agg(F.sum("tokens").cast("double").alias("tokens"))
            .withColumn("most", F.when(mixed, F.col("tokens") * epochs).otherwise(0.0)))
    nodes = [most.groupBy(*LEVELS[:1]).agg(F.sum("most").alias("most")), most.groupBy(*LEVELS[:2]).agg(F.sum("most").alias("most")), most.select(*LEVELS, "most")]
    above = None
    for depth, level in enumerate(LEVELS):
        here = nodes[depth].withColumn("weight", weight(level)).where("most > 0")
        if above is None:
            here = here.withColumn("__all", F.lit(0)).withColumn("given", F.lit(float(total)))
            parent = ["__all"]
        else:
            here = here.join(above, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in LEVELS[:depth]])
            parent = list(LEVELS[:depth])
        here = filled(here, parent, "given", "weight", "most", "budget")
        above = here.select(*[F.col(c).alias(f"__{c}") for c in LEVELS[:depth + 1]], F.col("budget").alias("given"))
    given = above.withColumnRenamed("given", "budget")
    return (most.join(given, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in LEVELS], "left")
            .select(*LEVELS, F.col("tokens").cast("long").alias("tokens"), F.floor(F.coalesce("budget", F.lit(0.0)) + 1e-6).cast("long").alias("budget")))


def bars(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """Leaves with whole epochs and the last (place, key) taken from the epoch after (null: none).

    ``rows`` has (key, domain, lang, source, tokens).  A document is taken if the tokens before it
    are fewer than what is left, so the budget is reached and exceeded by less than one document."""
    leaf = list(LEVELS)
    named = leaves.select(*[F.col(c).alias(f"__{c}") for c in leaf], F.floor(F.col("budget") / F.greatest("tokens", F.lit(1))).alias("whole"), "budget", F.col("tokens").alias("all_tokens"))
    match = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in leaf]
    open_ = named.withColumn("left", F.col("budget") - F.col("whole") * F.col("all_tokens")).where("left > 0")
    placed = (rows.join(open_, match).select("key", *leaf, "tokens", "left", place(F.col("key"), F.col("whole"), seed).alias("place"))
              .withColumn("bucket", F.shiftright("place", 52 - (BUCKETS.bit_length() - 1)).cast("int")))
    sums = placed.groupBy(*leaf, "bucket", "left").agg(F.sum("tokens").alias("sum"))
    upto = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (sums.withColumn("before", F.coalesce(F.sum("sum").over(upto), F.lit(0)))
            .where((F.col("before") < F.col("left")) & (F.col("before") + F.col("sum") >= F.col("left")))
            .select(*[F.col(c).alias(f"__{c}") for c in leaf], F.col("bucket").alias("__bucket"), "before"))
    inside = (Window.partitionBy(*leaf).orderBy("place", F.col("key").asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, -1))
    last = (placed.join(edge, [*match, F.col("bucket") == F.col("__bucket")])
            .withColumn("ahead", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).where(F.col("ahead") < F.col("left"))
            .groupBy(*leaf).agg(F.max(F.struct("place", F.coalesce(F.col("key"), F.lit(-2 ** 63)).alias("key"))).alias("bar")))
    last = last.select(*[F.col(c).alias(f"_{c}") for c in leaf], "bar")
    return named.join(last, [F.col(f"__{c}").eqNullSafe(F.col(f"_{c}")) for c in leaf], "left").select(*[f"__{c}" for c in leaf], "whole", "bar")


def tokens_of(text: Column) -> Column:
    """Runs of characters other than ASCII white space in a text."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("long")


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, float]], total_share: float = 1.0, epochs: int = 2,
        seed: int = 11, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The mixed documents, one row per document and epoch it is taken in.

    The budget is ``total_share`` of all tokens, and no leaf reads more than ``epochs`` of its own;
    what has a weight of 0 is left out, and a negative or infinite weight is an error.
    Returns all columns of ``docs`` in a struct ``row``, domain, tokens and epoch (from 0).  Null
    languages, sources and domains are leaves of their own; documents without a token cost nothing
    and come along in each whole epoch and below the bar; rows that repeat a key share their place,
    so all or none of them are taken; an empty table gives no rows."""
    prepare(docs.sparkSession)
    named = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("key"), domain.alias("domain"), F.col(lang).alias("lang"),
                        F.col(source).alias("source"), tokens_of(F.col(text)).alias("tokens"))
    rows = shared_table(named.drop("row"), "leaves")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    total = total_share * (leaves.agg(F.sum("tokens")).first()[0] or 0)
    given = shared_table(budgets(leaves, weights, total, epochs), "budgets")
    plan = shared_table(bars(rows, given, seed), "bars")
    found = named.join(plan, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in LEVELS])
    here = F.struct(place(F.col("key"), F.col("whole"), seed).alias("place"), F.coalesce(F.col("key"), F.lit(-2 ** 63)).alias("key"))
    taken = F.col("whole") + F.when(F.col("bar").isNotNull() & (here <= F.col("bar")), 1).otherwise(0)
    return (found.withColumn("taken", taken).where("taken > 0")
            .select("row", "domain", "tokens", F.explode(F.sequence(F.lit(0), F.col("taken").cast("int") - 1)).alias("epoch")))
