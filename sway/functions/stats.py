"""Vectorised (Arrow) UDFs for test statistics.

Each is applied after aggregation, to one row per group, so the Python
worker sees a handful of rows regardless of the fact-table size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from sway.functions import dist


def _nan_to_none(a: np.ndarray) -> pd.Series:
    s = pd.Series(a, dtype="float64")
    return s.where(np.isfinite(s) | np.isinf(s), None)


@pandas_udf(DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _nan_to_none(dist.t_two_sided_p(t.to_numpy(float), df.to_numpy(float)))


@pandas_udf(DoubleType())
def t_quantile_975(df: pd.Series) -> pd.Series:
    return _nan_to_none(dist.t_quantile(np.full(len(df), 0.975), df.to_numpy(float)))


@pandas_udf(DoubleType())
def binom_p_half(k: pd.Series, n: pd.Series) -> pd.Series:
    return _nan_to_none(dist.binom_two_sided_half(k.to_numpy(float), n.to_numpy(float)))


@pandas_udf(DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _nan_to_none(dist.fisher_exact(*(x.to_numpy(dtype=float, na_value=np.nan) for x in (a, b, c, d))))


@pandas_udf(DoubleType())
def fisher_less(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _nan_to_none(dist.fisher_exact(*(x.to_numpy(dtype=float, na_value=np.nan) for x in (a, b, c, d)),
                                          alternative="less"))


@pandas_udf(DoubleType())
def mann_whitney_p(u1: pd.Series, n1: pd.Series, n2: pd.Series, tie_sum: pd.Series) -> pd.Series:
    return _nan_to_none(dist.mann_whitney_p(*(x.to_numpy(dtype=float, na_value=np.nan) for x in (u1, n1, n2, tie_sum))))


def paired_t_p(mean: Column, sd: Column, n: Column) -> Column:
    """Two-sided p of a one-sample t test on paired differences (mean, sd, n)."""
    t = F.try_divide(mean, sd / F.sqrt(n.cast("double")))
    # sd = 0: infinite t (p = 0) unless the mean is 0 too (undefined)
    t = F.when(sd == 0, F.when(mean == 0, F.lit(None)).otherwise(F.lit(float("inf")))).otherwise(t)
    return F.when(n > 1, t_two_sided_p(t, (n - 1).cast("double")))


def t_margin(sd: Column, n: Column) -> Column:
    """Half-width of the 95 % t interval; 0 when n <= 1."""
    return F.when(n <= 1, F.lit(0.0)).otherwise(
        t_quantile_975((n - 1).cast("double")) * sd / F.sqrt(n.cast("double")))


Z975 = 1.959963984540054


def wilson(k: Column, n: Column, z: float = Z975) -> tuple[Column, Column]:
    """Wilson score interval for k successes of n, as column expressions."""
    nd = n.cast("double")
    p = F.try_divide(k.cast("double"), nd)
    denom = 1 + z * z / nd
    centre = (p + z * z / (2 * nd)) / denom
    half = z * F.sqrt(p * (1 - p) / nd + z * z / (4 * nd * nd)) / denom
    return centre - half, centre + half


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL (not an ANSI error) when a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    n = F.count(xx)
    sxy = F.sum(xx * yy) - F.sum(xx) * F.sum(yy) / n
    sxx = F.sum(xx * xx) - F.sum(xx) * F.sum(xx) / n
    syy = F.sum(yy * yy) - F.sum(yy) * F.sum(yy) / n
    return F.try_divide(sxy, F.sqrt(sxx * syy))


def p_marker(p: Column, alpha: float = 0.05, ns: str = "ns") -> Column:
    """Star marker of a p-value; NULL/NaN -> '' ; ``ns`` for not significant ('' in one variant)."""
    return (F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "***").when(p < 0.01, "**")
            .when(p < alpha, "*").otherwise(ns))
