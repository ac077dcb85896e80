"""Readers for the driver tables (one parquet file or folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; callers project the columns they need so Catalyst prunes the read."""
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows out by ``keys`` where a scan has fewer splits than the session has cores.

    A file with a single row group is read by one task, which would also run every costly expression on its
    rows.  A scan with enough splits, as of any large table, is left as it is and not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores, *keys) if df.rdd.getNumPartitions() < cores else df
