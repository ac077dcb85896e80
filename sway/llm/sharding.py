"""Reproducible shuffle and sharding by a Feistel permutation with cycle walking.

Every row gets its global number (ascending key), the permutation sends the number to a
position below the row count, and position ``p`` is slot ``p div shards`` of shard
``p mod shards``.  Shard sizes differ by one at most, slots have no gaps, and the place of
any row can be computed from its number alone, without the other rows.

The permutation works on pairs of ``Z_a x Z_b`` with ``a * b >= n``: six rounds add a hash
of one half to the other half, modulo its size.  ``a`` is chosen so that ``a * b - n`` is
tiny.  A position of ``n`` or more is walked on until it falls below ``n``; a walk passes each of
the ``a * b - n`` positions outside at most once, which bounds its length exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sway.llm.common import range_bounds, range_of, shuffle_partitions

ROUNDS = 6
#: Values of ``a`` tried when the domain is fitted to the row count.
TRIES = 2048


def domain(n: int) -> tuple[int, int]:
    """Sides (a, b) of the smallest domain of at least ``n`` pairs among near-square ones."""
    root = math.isqrt(max(n, 1) - 1) + 1
    return min(((a, -(-max(n, 1) // a)) for a in range(root, root + min(TRIES, root + 1))),
               key=lambda ab: (ab[0] * ab[1], ab[0]))


def _rounds(x: Column, a: int, b: int, seed: int) -> Column:
    right = F.pmod(x, F.lit(b))
    left = ((x - right) / F.lit(b)).cast("long")  # the quotient is whole: exact below 2^53
    for i in range(ROUNDS):
        key = F.lit(seed * ROUNDS + i).cast("long")
        if i % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(right, key), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, key), F.lit(b)), F.lit(b))
    return left * F.lit(b) + right


def permuted(x: Column, n: int, seed: int = 0) -> Column:
    """Position of row number ``x`` (0 to n - 1) under the seeded permutation of 0 to n - 1."""
    a, b = domain(n)
    outside = a * b - n
    first = _rounds(x.cast("long"), a, b, seed)
    if not outside:
        return first
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(outside)), first,
        lambda at, _: F.when(at < n, at).otherwise(_rounds(at, a, b, seed)))
    return F.when(first < n, first).otherwise(walked)


def row_numbers(df: DataFrame, key: str, ties: list[str], out: str = "row_no") -> DataFrame:
    """Number all rows from 0 by ascending ``key`` (nulls first), ties by ``ties``.

    Rows go to ranges of the key; a range's offset is the number of rows in the ranges before
    it, so no window spans more than one range.  Rows that agree in all of these columns may
    swap numbers."""
    bounds = range_bounds(df, key, 4 * shuffle_partitions(df.sparkSession))
    ranged = df.withColumn("__range", range_of(F.col(key), bounds))
    offsets, total = [0] * max(1, len(bounds)), 0
    counts = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()}
    for i in range(len(offsets)):
        offsets[i], total = total, total + counts.get(i, 0)
    order = Window.partitionBy("__range").orderBy(F.col(key).asc_nulls_first(), *ties)
    start = F.get(F.lit(offsets).cast("array<bigint>"), F.col("__range"))
    return (ranged.withColumn(out, F.row_number().over(order).cast("long") - 1 + start)
            .drop("__range"))


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16,
          seed: int = 0) -> DataFrame:
    """Shard and slot of every row.

    Returns (key, size, text_crc32, row_no, position, shard, slot).  Only the key, the size and
    hashes of the text are shuffled.  A null text has no bytes; a null key sorts first; repeated
    rows get places of their own; an empty table gives no rows; other columns are not read."""
    shards = max(1, shards)
    content = F.coalesce(F.col(text), F.lit(""))
    slim = df.select(F.col(key).alias("doc_id"),
                     (F.octet_length(content) + 1).cast("long").alias("size"),
                     F.crc32(content.cast("binary")).alias("text_crc32"),
                     F.xxhash64(content).alias("text_hash"))
    n = slim.count()
    placed = (row_numbers(slim, "doc_id", ["size", "text_crc32", "text_hash"])
              .withColumn("position", permuted(F.col("row_no"), n, seed)))
    return placed.select("doc_id", "size", "text_crc32", "row_no", "position",
                         F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
                         ((F.col("position") - F.pmod("position", F.lit(shards))) / shards)
                         .cast("long").alias("slot"))
