"""Row numbers and average ranks without sorting a whole group in one task.

Values are dealt to ordered buckets; a bucket's offset is the number of rows in the buckets
before it, summed over a small table of bucket counts, and only rows of one bucket are
sorted together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

QUANTILES = 64


def numbered(df: DataFrame, keys: list[str], order: str, out: str = "idx", prefix: int = 3) -> DataFrame:
    """Number the rows of each group from 0 by ``order``, a column of hex hashes.

    Buckets are the first ``prefix`` digits, so there are at most 16 ** prefix per group."""
    d = df.withColumn("_b", F.substring(F.col(order), 1, prefix))
    counts = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*keys, "_b", before.alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(order)) - 1
    return d.join(offsets, [*keys, "_b"]).withColumn(out, (F.col("_before") + inside).cast("long")).drop("_b", "_before")


def average_rank(df: DataFrame, part: list[str], value: str, out: str, digits: int = 12) -> DataFrame:
    """Average (mid) rank of ``value`` within ``part``, ties share the mean rank; no rank for nulls.

    Values are compared after rounding to ``digits`` decimals so that equal quantities reached
    through different summation orders still tie.  Buckets are cut at approximate quantiles, so
    equal values share one."""
    d = df.withColumn("_v", F.round(F.col(value), digits) + F.lit(0.0))
    ranks = _placed(d.filter(F.col("_v").isNotNull()), part).select(*part, "_v", (F.col("_first") + (F.col("_c") + 1) / 2.0).alias(out))
    return d.join(ranks, [*part, "_v"], "left").select(*df.columns, out)


def counted_rank(df: DataFrame, part: list[str], value: str, rows: str, out: str) -> DataFrame:
    """Average rank within ``part`` of the ``rows`` rows that each row of ``df`` stands for, and the number of
    rows of its value (``_c``).  Values are compared as they are; none is null."""
    placed = _placed(df.withColumnRenamed(value, "_v"), part, F.sum(rows)).select(*part, F.col("_v").alias(value), "_c", (F.col("_first") + (F.col("_c") + 1) / 2.0).alias(out))
    return df.join(placed, [*part, value])


def _placed(d: DataFrame, part: list[str], rows: Column | None = None) -> DataFrame:
    """(part, _v, _c, _b, _before, _first): each distinct value, its number of rows, its bucket, and how many rows come
    before the bucket and before the value.  Counts are taken per value first, so a value that fills a group is one row.
    ``rows`` adds up the rows that a row stands for, where it is more than itself."""
    cuts = d.groupBy(*part).agg(F.percentile_approx("_v", [i / QUANTILES for i in range(1, QUANTILES)]).alias("_cuts"))
    sizes = (d.groupBy(*part, "_v").agg((F.count(F.lit(1)) if rows is None else rows).alias("_c"))
             .join(cuts, part).withColumn("_b", F.size(F.filter("_cuts", lambda x: x < F.col("_v")))).drop("_cuts"))
    buckets = sizes.groupBy(*part, "_b").agg(F.sum("_c").alias("_n"))
    upto = W.unboundedPreceding, -1
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*part).orderBy("_b").rowsBetween(*upto)), F.lit(0)))
    inside = F.coalesce(F.sum("_c").over(W.partitionBy(*part, "_b").orderBy("_v").rowsBetween(*upto)), F.lit(0))
    return sizes.join(buckets.drop("_n"), [*part, "_b"]).withColumn("_first", F.col("_before") + inside)


def values_at(df: DataFrame, part: list[str], value: str, wanted: DataFrame, at: str, out: str) -> DataFrame:
    """Add to ``wanted`` (part, ``at``, others) the value at position ``at`` (from 0) of its sorted group.

    Neither the values nor the wanted positions of a group meet in one task: both go to the group's buckets of
    values, and a pass in order of positions carries each value on to the positions that it covers."""
    placed = _placed(df.select(*part, F.col(value).alias("_v")).filter(F.col("_v").isNotNull()), part)
    starts = placed.groupBy(*part).agg(F.sort_array(F.collect_set(F.struct("_before", "_b"))).alias("_starts"))  # QUANTILES at most
    found = F.filter("_starts", lambda s: s["_before"] <= F.col(at))
    asked = wanted.join(starts, part).withColumn("_b", F.element_at(found, -1)["_b"]).drop("_starts")
    others = [c for c in wanted.columns if c not in (*part, at)]
    rows = placed.select(*part, "_b", F.col("_first").alias(at), F.lit(0).alias("_ask"), F.col("_v"), *[F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in others])
    both = rows.unionByName(asked.withColumns({"_ask": F.lit(1), "_v": F.lit(None).cast(rows.schema["_v"].dataType)}))
    carried = F.last("_v", ignorenulls=True).over(W.partitionBy(*part, "_b").orderBy(at, "_ask"))
    return both.withColumn(out, carried).filter("_ask = 1").select(*wanted.columns, out)
