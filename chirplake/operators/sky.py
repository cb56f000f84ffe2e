"""Draws on the sky and in time for injections."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph
from .selection import hash_order


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone, so a lost task draws the same again."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 13), 16, 10).cast("double") / float(16**13)


def all_sky(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds ra and dec in radians, uniform over the sphere."""
    return df.withColumn("ra", uniform(seed, key) * (2 * math.pi)).withColumn("dec", F.asin(2 * uniform(seed + 1, key) - 1))


def patch(df: DataFrame, key: str, ra: float, dec: float, radius: float, seed: int = 0) -> DataFrame:
    """Uniform by area within a circle (radians)."""
    c = 1 - uniform(seed, key) * (1 - math.cos(radius))
    s, a = F.sqrt(1 - c * c), uniform(seed + 1, key) * (2 * math.pi)
    z = c * math.sin(dec) + s * F.cos(a) * math.cos(dec)
    y, x = s * F.sin(a), c * math.cos(dec) - s * F.cos(a) * math.sin(dec)
    return df.withColumn("dec", F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)))).withColumn("ra", F.pmod(F.lit(ra) + F.atan2(y, x), F.lit(2 * math.pi)))


def fixed(df: DataFrame, ra: float, dec: float) -> DataFrame:
    return df.withColumn("ra", F.lit(ra)).withColumn("dec", F.lit(dec))


def weighted(df: DataFrame, key: str, pixels: DataFrame, seed: int = 0) -> DataFrame:
    """Pixels (ra, dec, value) drawn by their non-negative values: a draw finds its pixel on the axis of their running sum, by cells of it, as many as pixels."""
    good = pixels.where("value > 0").select("ra", "dec", F.col("value").cast("double").alias("value"))
    got = good.agg(F.sum("value").alias("t"), F.count("*").alias("n")).first()  # one row
    if not got["t"]:
        raise ValueError("the map has no positive pixel")
    axis = graph.running(good, "ra", ["ra", "dec"], F.col("value"), "_lo").withColumn("_hi", F.col("_lo") + F.col("value"))
    cell = got["t"] / got["n"]
    axis = axis.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / cell).cast("long"), F.floor(F.col("_hi") / cell).cast("long")))).drop("value")
    drawn = df.withColumn("_at", uniform(seed, key) * got["t"]).withColumn("_cell", F.floor(F.col("_at") / cell).cast("long"))
    return drawn.join(axis, "_cell").where((F.col("_lo") <= F.col("_at")) & (F.col("_at") < F.col("_hi"))).drop("_cell", "_at", "_lo", "_hi")


def repeated(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def poisson_times(spark: SparkSession, rate: float, start: float, end: float, seed: int = 0) -> DataFrame:
    """Times with exponential gaps: sequential by definition, drawn on the driver; their number is rate x length."""
    rng, at, out = np.random.default_rng(seed), start, []
    while True:
        at += rng.exponential(1 / rate)
        if at >= end:
            break
        out.append((len(out), float(at)))
    return spark.createDataFrame(out, "number long, gps_time double")
