"""Confidence bands of group means by a bootstrap that moves no rows.

Each row counts in each replicate as often as a Poisson variate of mean 1, which
a hash of the row's key, the replicate and the seed gives, so a row is drawn alike
wherever and however often it is read.  A replicate's sums are partial sums; a
group of any size leaves one row per replicate.  The skew that the BCa bands need
is that of leaving out one row at a time, which for a mean is a matter of the sums
of the first three powers.

Defined cases: null values and NaN don't count; a group without values has no
row; one value, or equal ones, have bands of no width; a replicate that drew no
row is left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Draws of one row above this many are one in 10**10.
MOST = 12
KINDS = ("percentile", "bca", "studentised")


def draws(key: Column, replicate: Column, seed: int) -> Column:
    """How often a row counts in a replicate: the number of steps of the Poisson distribution below a uniform number from 52 bits of a hash."""
    return _steps(_hashed(key, replicate, seed))


def _hashed(key: Column, replicate: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("_", F.lit(str(seed)), replicate.cast("string"), key.cast("string")))


def _steps(hexed: Column) -> Column:
    out, below, chance = None, 0.0, math.exp(-1)
    for k in range(MOST):
        below += chance / math.factorial(k)
        # the first 13 hex digits order as their number does, so the hash is compared as it is, and never made a number
        under = hexed < f"{math.ceil(below * (1 << 52)):013x}" if below < 1 else F.lit(True)
        out = F.when(under, F.lit(k)) if out is None else out.when(under, F.lit(k))
    return out.otherwise(F.lit(MOST))


def replicates(rows: DataFrame, group: Sequence[str], key: str, value: str, count: int, seed: int = 0) -> DataFrame:
    """(group columns, replicate, n, mean, deviation) of ``count`` replicates: how many draws, their mean, and its standard error."""
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*group, F.col(key).alias("_key"), F.col(value).cast("double").alias("_v"))
    # each row is hashed ``count`` times, so rows are dealt out first; no filter of the draws, for which Spark would draw twice
    each = spread(good, "_key").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("_h", _hashed(F.col("_key"), F.col("replicate"), seed)).withColumn("_w", _steps(F.col("_h")))
    sums = each.groupBy(*group, "replicate").agg(F.sum("_w").alias("n"), F.sum(F.col("_w") * F.col("_v")).alias("_1"), F.sum(F.col("_w") * F.col("_v") * F.col("_v")).alias("_2")).where("n > 0")
    mean = F.col("_1") / F.col("n")
    around = F.greatest(F.lit(0.0), F.col("_2") / F.col("n") - mean * mean)
    return sums.select(*group, "replicate", "n", mean.alias("mean"), F.sqrt(around / F.col("n")).alias("deviation"))


def _quantile(values: np.ndarray, q: float) -> float:
    return float(np.quantile(values, min(max(q, 0.0), 1.0)))


def _band(kind: str, level: float, mean: float, error: float, skew: float, means: np.ndarray, deviations: np.ndarray) -> tuple[float, float]:
    low, high = (1 - level) / 2, (1 + level) / 2
    if kind == "percentile":
        return _quantile(means, low), _quantile(means, high)
    if kind == "studentised":
        moved = means - mean
        ratio = np.divide(moved, deviations, out=np.zeros(len(means)), where=deviations > 0)
        return mean - _quantile(ratio, high) * error, mean - _quantile(ratio, low) * error
    normal = NormalDist()
    share = (float((means < mean).sum()) + float((means == mean).sum()) / 2) / len(means)
    shift = normal.inv_cdf(min(max(share, 0.5 / len(means)), 1 - 0.5 / len(means)))

    def corrected(q: float) -> float:
        z = shift + normal.inv_cdf(q)
        return normal.cdf(shift + z / (1 - skew * z))

    return _quantile(means, corrected(low)), _quantile(means, corrected(high))


def bands(rows: DataFrame, group: Sequence[str], key: str, value: str, count: int = 200, level: float = 0.9, kind: str = "percentile", seed: int = 0) -> DataFrame:
    """(group columns, n, mean, lower, upper): each group's mean and its band; ``key`` tells rows apart, ``kind`` is percentile, bca or studentised."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of band: {kind}")
    if not 0 < level < 1 or count < 1:
        raise ValueError("the level must be between 0 and 1, and the count 1 or more")
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).withColumn("_v", F.col(value).cast("double"))
    whole = good.groupBy(*group).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.var_pop("_v").alias("_var"), F.skewness("_v").alias("_skew"))
    # of leaving out one row at a time, the third moment over the spread's power: with equal weights the values' skewness by 6 roots of n
    whole = whole.withColumn("_a", F.coalesce(F.nanvl(F.col("_skew"), F.lit(0.0)), F.lit(0.0)) / (6 * F.sqrt("n"))).withColumn("_error", F.sqrt(F.col("_var") / F.col("n")))
    drawn = replicates(rows, group, key, value, count, seed).groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("replicate", "mean", "deviation"))).alias("_r"))  # ``count`` at most
    right = drawn.select(*[F.col(c).alias(f"_g{c}") for c in group], F.transform("_r", lambda r: r["mean"]).alias("_means"), F.transform("_r", lambda r: r["deviation"]).alias("_deviations"))
    both = whole.join(right, [F.col(c).eqNullSafe(F.col(f"_g{c}")) for c in group], "left")

    @F.pandas_udf("lower double, upper double")
    def band(mean: pd.Series, error: pd.Series, skew: pd.Series, means: pd.Series, deviations: pd.Series) -> pd.DataFrame:
        got = [(m, m) if x is None or not len(x) else _band(kind, level, m, e, a, np.asarray(x, float), np.asarray(y, float)) for m, e, a, x, y in zip(mean, error, skew, means, deviations, strict=True)]
        return pd.DataFrame(got, columns=["lower", "upper"])

    return both.withColumn("_b", band("mean", "_error", "_a", "_means", "_deviations")).select(*group, "n", "mean", "_b.lower", "_b.upper")
