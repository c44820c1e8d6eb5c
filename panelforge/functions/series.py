"""Scalar and array mathematics on columns; everything here stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_of(series: Column) -> Column:
    return F.aggregate(series, F.lit(0.0), lambda s, x: s + x) / F.size(series)


def std_of(series: Column) -> Column:
    """Population standard deviation of an array."""
    return F.sqrt(F.aggregate(F.transform(series, lambda x: (x - mean_of(series)) * (x - mean_of(series))), F.lit(0.0), lambda s, x: s + x) / F.size(series))


def percent_change(v: Column, mean: Column) -> Column:
    return (v - mean) / F.nullif(mean, F.lit(0.0)) * 100


def zscore(v: Column, mean: Column, std: Column) -> Column:
    return (v - mean) / F.nullif(std, F.lit(0.0))


def guarded_corr(a, b) -> Column:
    """Pearson correlation as an aggregate; 0 where a side is constant."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)), F.lit(0.0))


def tukey(pos: Column, length: int, alpha: float = 0.75) -> Column:
    """Value of a cosine taper at `pos`: all ones for alpha 0 or less, a Hann window for 1 or more."""
    x = pos / float(max(1, length - 1))
    if alpha <= 0:
        return F.lit(1.0) + 0 * x
    if alpha >= 1:
        return 0.5 * (1 - F.cos(2 * math.pi * x))
    rise, half = 2 * math.pi / alpha, alpha / 2
    return F.when(x < half, 0.5 * (1 + F.cos(rise * (x - half)))).when(x >= 1 - half, 0.5 * (1 + F.cos(rise * (x - 1 + half)))).otherwise(1.0)


def fisher_z(r: Column) -> Column:
    """Null at |r| = 1."""
    return F.when(F.abs(r) < 1, 0.5 * F.ln((1 + r) / (1 - r)))


def corr_distance(r: Column) -> Column:
    return F.sqrt(2 * (1 - r))


def gauss(x: Column, a: float, mu: float, sigma: float) -> Column:
    return a * F.exp(-((x - mu) * (x - mu)) / (2 * sigma * sigma))


def power_grid(base: float, exponents: Column) -> Column:
    return F.transform(exponents, lambda e: F.pow(F.lit(float(base)), e))


def edge_index(i: Column, j: Column, n: Column | int, k: int = 1) -> Column:
    """Place of (i, j) in the upper triangle of an n x n matrix, with its diagonal for k = 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return (i * (n - k) - (i * (i - 1) / 2).cast("int") + (j - i - k)).cast("int")


def rounded(c, digits: int = 6) -> Column:
    """Rounded for comparison; never a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def seeded(seed: int, key: str) -> Column:
    """The order that random operators use: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
