"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sway.session import checkpoint_dir, configure
from sway.sources.tables import read_table

#: Rows and bytes of one Arrow batch handed to Python: texts can be long, so a batch stays small.
ARROW_ROWS, ARROW_BYTES = 256, 32 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of this package: the library's defaults and small Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(prepare(spark), sf_dir, name)


def shared_table(df: DataFrame, hint: str) -> DataFrame:
    """Write ``df`` as Parquet in the folder of ``spark.checkpoint.dir`` and read it back.

    This cuts lineage: readers need only the shared files, so a lost executor costs no
    recomputation.  The folder is removed when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{hint}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """Ascending values of ``key`` that cut the table into about ``parts`` equal ranges.

    Every bound occurs in the table and the first is the smallest key, so no range is
    empty.  The driver receives at most ``parts`` numbers.  Nulls have no say; an empty or
    all-null column gives no bounds."""
    parts = max(1, parts)
    found = df.select(F.percentile_approx(key, [i / parts for i in range(parts)], max(10_000, 20 * parts))
                      .alias("b")).first()["b"]
    return sorted(set(found or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """Index of the range of ``range_bounds`` that holds ``key`` (0 for null), by binary search."""
    if len(bounds) < 2:
        return F.lit(0)
    steps, s = [], 1
    while s < len(bounds):
        steps.append(s)
        s *= 2
    edges = F.array(*[F.lit(int(b)) for b in bounds]) if len(bounds) <= 16 else F.lit([int(b) for b in bounds])
    found = F.aggregate(
        F.array(*[F.lit(x) for x in reversed(steps)]), F.lit(0),
        lambda at, step: F.when((at + step < len(bounds))
                                & (F.get(edges, at + step) <= key), at + step).otherwise(at))
    return F.coalesce(found, F.lit(0))
