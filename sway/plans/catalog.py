"""Registry of named queries: a Spark builder plus (optionally) a DuckDB oracle.

Each builder takes (spark, sf_dir) and returns a lazy DataFrame over the
driver tables.  Double columns are rounded to 6 digits at the edge so the
oracle comparison is not sensitive to summation order; the oracle SQL
rounds the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sway.plans.oracle import with_fixtures
from sway.session import configure

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None


REGISTRY: dict[str, Query] = {}


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its oracle SQL."""
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def built(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)  # fills unset defaults and the checkpoint folder; idempotent
            return round_doubles(fn(spark, sf_dir))

        built.__name__ = fn.__name__
        built.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, built, with_fixtures(sql) if sql else None)
        return fn
    return deco


def load_all() -> dict[str, Query]:
    """Import every query module so their registrations run."""
    from sway.plans import (  # noqa: F401
        q_evidence, q_files, q_grid, q_judge, q_omind, q_order, q_pages, q_parse, q_resample, q_shares,
        q_shift, q_stream, q_text,
    )
    return REGISTRY
