"""Cross-section and sample statistics, safe under ANSI and free of NaN."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def corr(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; null for constant columns."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def rounded_half_up(c: Column, digits: int) -> Column:
    """floor(c * 10^digits + 0.5) / 10^digits in doubles. F.floor gives a long, which ends at 9.2e18; from 2^52 on a double has no fraction to cut."""
    unit = float(10**digits)
    up = c * unit + 0.5
    return F.when(F.abs(up) < 2.0**52, F.floor(up)).otherwise(up) / unit


def settled(c: Column, digits: int = 10) -> Column:
    """Rounded to so many digits, in arithmetic that every engine does alike: values that should tie do, whatever order their sums were made in."""
    return rounded_half_up(c, digits)


def average_rank(c: str, *keys: str) -> Column:
    """Rank within keys, from 1; ties get their mean rank."""
    # ties are the rows of the same place in one order: no second shuffle by value
    w = Window.partitionBy(*keys).orderBy(c)
    return F.rank().over(w) + (F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2


def correlation(df: DataFrame, a: str, b: str, keys: list[str], method: str = "rank", least: int = 3, large: bool = False) -> DataFrame:
    """keys, n and corr of a and b per key: Spearman for method "rank", else Pearson; null below `least` rows.

    Ranks are of values settled to 10 digits. large: a key may hold any number of
    rows, and its ranks go over many tasks; else each key is ranked in one.
    """
    df = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    if method == "rank":
        df = df.select(*keys, settled(F.col(a)).alias("_a"), settled(F.col(b)).alias("_b"))
        if large:
            df = scan.average_rank(df, "_a", keys, "_ra", label="rank-a")
            df = scan.average_rank(df, "_b", keys, "_rb", label="rank-b")
        else:
            df = df.select(*keys, average_rank("_a", *keys).alias("_ra"), average_rank("_b", *keys).alias("_rb"))
        a, b = "_ra", "_rb"
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), corr(a, b).alias("corr"))
    return out.withColumn("corr", F.when(F.col("n") >= least, F.col("corr")))


def quantile_groups(df: DataFrame, value: str, keys: list[str], n_groups: int, out: str = "grp") -> DataFrame:
    """df with out: 1 (low) to n_groups by interpolated quantile edges of the key's values.

    Equal edges are dropped and the groups numbered anew; a key with one
    distinct edge gets null groups. Values are settled first. The edges of a key are one aggregate, joined back.
    """
    df = df.withColumn("_v", settled(F.col(value)))
    share = F.array(*[F.lit(k / n_groups) for k in range(n_groups + 1)])
    edges = df.groupBy(*keys).agg(F.array_distinct(F.percentile("_v", share)).alias("_e"))
    df = df.join(edges, keys)
    below = F.size(F.filter("_e", lambda e: e < F.col("_v")))
    return df.withColumn(out, F.when(F.size("_e") > 1, F.greatest(below, F.lit(1)))).drop("_e", "_v")


def in_top_quantile(value: str, keys: list[str], quantiles: int, tie: str = "symbol") -> Column:
    """Whether a row is in the top quantile of its key by rank of settled values, ties by `tie`: r * q > (q - 1) * (n - 1), r from 0."""
    w = Window.partitionBy(*keys)
    r, n = F.row_number().over(w.orderBy(settled(F.col(value)), tie)) - 1, F.count(F.lit(1)).over(w)
    return r * quantiles > (quantiles - 1) * (n - 1)


def ranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1 of a cross-section, ties get their mean rank."""
    order = np.argsort(v, kind="stable")
    s = v[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[first, len(s)])
    out = np.empty(len(v))
    out[order] = np.repeat(first + (size + 1) / 2, size)
    return out


def pearson(a: np.ndarray, b: np.ndarray) -> float | None:
    """Correlation of two columns; None if one is constant."""
    a, b = a - a.mean(), b - b.mean()
    both = float(np.sqrt((a @ a) * (b @ b)))
    return float(a @ b) / both if both else None


def group_means(v: np.ndarray, ret: np.ndarray, n_groups: int, spread: int) -> list[float | None] | None:
    """Mean of ret over `spread` in the quantile groups of v, as quantile_groups() makes them; None if v has one distinct edge."""
    s, at = np.sort(v), np.array([k / n_groups for k in range(n_groups + 1)]) * (len(v) - 1)
    low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
    edges = np.unique(np.where((low == high) | (s[low] == s[high]), s[low], (high - at) * s[low] + (at - low) * s[high]))
    if len(edges) < 2:
        return None
    grp = np.maximum(np.searchsorted(edges, v, "left"), 1) - 1
    n, total = np.bincount(grp, minlength=n_groups), np.bincount(grp, ret, n_groups)
    return [float(x / k / spread) if k else None for x, k in zip(total, n)]


def _beta_fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d, c = np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            d = 1 / d
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


def incomplete_beta(x, a, b) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    x, a, b = (np.atleast_1d(np.asarray(v, float)) for v in np.broadcast_arrays(x, a, b))
    inside = np.clip(x, 1e-300, 1 - 1e-16)
    lg = np.vectorize(math.lgamma)
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(inside) + b * np.log1p(-inside))
    low = inside < (a + 1) / (a + b + 2)
    left = front * _beta_fraction(np.where(low, inside, 0.5), a, b) / a
    right = 1 - front * _beta_fraction(np.where(low, 0.5, 1 - inside), b, a) / b
    out = np.where(low, left, right)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def two_sided_p(t, df) -> np.ndarray:
    """P(|T| >= |t|) of Student's t distribution."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


def p_value(t: Column, df: Column) -> Column:
    """Two-sided p value; null for a null t or df below 1. Spark has no t distribution, and rows are one per report line."""

    @F.pandas_udf("double")
    def run(t: pd.Series, df: pd.Series) -> pd.Series:
        ok = t.notna() & df.notna() & (df > 0)
        out = pd.Series(np.nan, index=t.index)
        if ok.any():
            out[ok] = two_sided_p(t[ok].to_numpy(float), df[ok].to_numpy(float))
        return out.astype(object).where(ok, None)

    return run(t, df)
