"""Cuts on clusters and triggers, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of a cut string's functions that Spark writes otherwise.
RENAMED = {"max": "greatest", "min": "least"}


def from_text(cut: str) -> Column:
    """A boolean expression as a column: SQL operators and functions only, ``and/or/not/==`` as usual; nothing is evaluated in Python."""
    import re

    if ";" in cut or "__" in cut:
        raise ValueError(f"not a cut: {cut}")
    sql = re.sub(r"&&|&", " AND ", re.sub(r"\|\||\|", " OR ", cut.replace("==", "=")))
    for old, new in RENAMED.items():
        sql = re.sub(rf"\b{old}\s*\(", f"{new}(", sql)
    return F.expr(f"({sql})")


def all_cuts(df: DataFrame, cuts: list[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [from_text(c) for c in cuts], F.lit(True)))


def status(value: Column, least: float) -> Column:
    """1 (rejected) below the threshold, else 0."""
    return F.when(value < least, F.lit(1)).otherwise(F.lit(0))


def rejection(reasons: dict[str, Column]) -> Column:
    """The names of the conditions that hold, joined by ";"; empty for an accepted row."""
    return F.concat_ws(";", *[F.when(c, F.lit(name)) for name, c in reasons.items()])


def sub_network(suball: Column, submra: Column, rho: Column, energy: Column, reference: Column, subnet: float, subrho: float, subnorm: float) -> Column:
    return (F.least(suball, submra) > subnet) & (rho > subrho) & (energy > subnorm * reference)


def sky_patch(theta: Column, phi: Column, theta0: float, phi0: float, radius: float) -> Column:
    """Points within a circle on the sky (degrees)."""
    from ..functions.geo import separation

    return separation(theta, phi, F.lit(theta0), F.lit(phi0)) <= radius


def rolling_median(df: DataFrame, key: list[str], order: str, value: str, half: int) -> DataFrame:
    """Median of the rows around each one; windows are cut at the edges."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-half, half)
    return df.withColumn("median", F.percentile(value, 0.5).over(w))


def rolling_median_whole(df: DataFrame, key: list[str], order: str, value: str, half: int) -> DataFrame:
    """The same with windows of full length: at an edge the window is moved inwards, so a series' first rows share one window, and its last."""
    by = Window.partitionBy(*key)
    ordered = by.orderBy(order)
    place, n = F.row_number().over(ordered) - 1, F.count("*").over(by)

    rows = df.withColumn("_p", place).withColumn("_n", n).withColumn("_m", F.percentile(value, 0.5).over(ordered.rowsBetween(-half, half)))
    whole = F.percentile(value, 0.5).over(by)
    rows = rows.withColumn("_all", whole)
    first = F.max(F.when(F.col("_p") == half, F.col("_m"))).over(by)
    last = F.max(F.when(F.col("_p") == F.col("_n") - 1 - half, F.col("_m"))).over(by)
    out = F.when(F.col("_n") <= 2 * half + 1, F.col("_all")).when(F.col("_p") < half, first).when(F.col("_p") > F.col("_n") - 1 - half, last).otherwise(F.col("_m"))
    return rows.withColumn("median", out).drop("_p", "_n", "_m", "_all")


def bands(waves: DataFrame, column: str, level: float = 0.9) -> DataFrame:
    """Per sample the median and the central band of many waveforms of one length."""
    lo = (1 - level) / 2
    each = waves.select(F.posexplode(column).alias("sample", "x"))
    return each.groupBy("sample").agg(F.percentile("x", [lo, 0.5, 1 - lo]).alias("q")).select("sample", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("lower", "median", "upper"))])
