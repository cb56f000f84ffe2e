"""Exact order statistics of groups of any size, and the energy threshold that rests on two of them.

A rank is found without a sort: each pass counts the values of each group in bins
between its bounds, with the least and the largest value of each bin; the bin
that holds the rank gives the next pass's bounds.  A bin's bounds are values of
the group, so a pass never leaves the same two bounds, and ends when they meet.
Counts are partial sums, so a group that holds all rows is in no one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoints

BINS = 1024
#: Ranks that are broadcast.
FEW = 10_000


def largest(rows: DataFrame, group: Sequence[str], value: str, ranks: DataFrame) -> DataFrame:
    """The ``k``-th largest value (from 1) of each group for each row (group columns, k) of ``ranks``: that row with ``found``.

    Null and NaN values don't count; ``found`` is null where the group has fewer
    than k values or k is below 1; equal values have a rank each.
    """
    checkpoints(rows.sparkSession)
    keys = [f"_g{i}" for i in range(len(group))] + ["_all"]
    named = [F.col(c).alias(k) for c, k in zip(group, keys, strict=False)] + [F.lit(0).alias("_all")]
    data = rows.select(*named, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    asked = ranks.select(*named, F.col("k").cast("long").alias("k")).distinct()
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    bounds = data.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    # what is open: k of the group's values from lo to hi
    state = asked.join(bounds, same(asked, bounds)).select(*[asked[k] for k in keys], asked["k"], asked["k"].alias("left"), "lo", "hi", "n").where("k BETWEEN 1 AND n").drop("n").checkpoint()
    done = state.where("lo = hi").select(*keys, "k", F.col("lo").alias("found"))
    state = state.where("lo < hi")
    while not state.isEmpty():
        ask = state.select(*[F.col(k).alias(f"_{k}") for k in keys], "k", "left", "lo", "hi")
        # few ranks are sent to the rows, so that no group's rows meet in a task; of many ranks the groups are small, and meet theirs by a shuffle
        ask = F.broadcast(ask) if state.count() <= FEW else ask
        met = data.join(ask, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).where("v BETWEEN lo AND hi")
        # of bounds very far apart the difference may overflow, so both are halved
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        which = F.when(F.col("v") == F.col("hi"), F.lit(BINS - 1)).when(F.col("v") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 2)))
        bins = met.groupBy(*keys, "k", "left", which.cast("int").alias("_bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        above = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "k").orderBy(F.col("_bin").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # BINS rows a rank
        chosen = bins.withColumn("_above", above).where("_above < left AND left <= _above + n").select(*keys, "k", (F.col("left") - F.col("_above")).alias("left"), "lo", "hi").checkpoint()
        done = done.unionByName(chosen.where("lo = hi").select(*keys, "k", F.col("lo").alias("found")))
        state = chosen.where("lo < hi")
    out = done.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("k").alias("_k"), "found")
    beside = ranks.withColumns({k: F.col(c) for c, k in zip(group, keys, strict=False)} | {"_all": F.lit(0)})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("k").cast("long") == F.col("_k")]
    return beside.join(out, on, "left").select(*ranks.columns, "found")


def upper_share(shape: float, x: float) -> float:
    """The regularised upper incomplete gamma function, by its series below the mean and its continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1 / shape
        n = shape
        while term > total * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    # evaluated forwards: a ratio of numerators and denominators, each made from the last two
    tiny = 1e-300
    b = x + 1 - shape
    c, d = 1 / tiny, 1 / b
    out, i = d, 0
    while True:
        i += 1
        a = -i * (i - shape)
        b += 2
        d = a * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + a / c
        c = c if abs(c) > tiny else tiny
        out *= c * d
        if abs(c * d - 1) < 1e-15 or i > 10_000:
            return out * scale


def inverse_upper_share(shape: float, p: float) -> float:
    """x where ``upper_share`` is p, by bisection."""
    p, low, high = min(max(p, 1e-12), 1 - 1e-12), 0.0, max(shape, 1.0)
    while upper_share(shape, high) > p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if upper_share(shape, middle) > p else (low, middle)
    return (low + high) / 2


#: Fixed values of the threshold's rule: values above the first count as filled, of those above the second a gamma shape is fitted; the bulk is the loudest fifth; a step of the shape; the weight of the sum.
FILLED, POSITIVE, BULK, STEP, WEIGHT = 1e-4, 1e-3, 0.2, 0.01, 0.3


def _by_bulk(detectors: int, rate: float, tail: float, bulk: float) -> float:
    shape, share = 1.0, 0.0
    while share < BULK:
        share = upper_share(detectors * shape, bulk)
        shape += STEP
    if shape > 1 + STEP:
        shape -= STEP
    return WEIGHT * (inverse_upper_share(detectors * shape, rate) + tail) + detectors * math.log(shape)


def _by_shape(rate: float, packet: float, mean: float, mean_log: float) -> float:
    gap = math.log(mean) - mean_log
    if gap <= 0:  # all values equal
        return mean / 2
    fitted = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    return mean * inverse_upper_share(fitted, rate * fitted / packet) / fitted / 2


def energy_threshold(pixels: DataFrame, group: Sequence[str], energy: str, detectors: int, rate: float, packet: float | None = None) -> DataFrame:
    """Per group the energy that noise passes with the chance ``rate``: group columns, n, filled, and ``threshold``.

    Without ``packet``, from the values at the shares ``rate`` and a fifth of the
    filled values (``tail`` and ``bulk``) and the gamma distribution of
    ``detectors`` degrees that fits the bulk; with it, from a gamma distribution
    fitted to all positive values by their mean and mean logarithm, the rate
    scaled by the shape of a packet.  Values are cut to 0 and 100 a detector;
    a group without a positive value has the threshold 0, null values don't count.
    """
    if detectors < 1 or not 0 < rate < 1:
        raise ValueError("detectors must be 1 or more, and the rate between 0 and 1")
    if not group:
        return energy_threshold(pixels.withColumn("_whole", F.lit(0)), ["_whole"], energy, detectors, rate, packet).drop("_whole")
    cut = pixels.where(F.col(energy).isNotNull() & ~F.isnan(F.col(energy).cast("double"))).withColumn("_e", F.greatest(F.lit(0.0), F.least(F.lit(100.0 * detectors), F.col(energy).cast("double"))))
    positive: Column = F.when(F.col("_e") > POSITIVE, F.col("_e"))
    sums = cut.groupBy(*group).agg(F.count("*").alias("n"), F.count(F.when(F.col("_e") > FILLED, 1)).alias("filled"), F.avg(positive).alias("_mean"), F.avg(F.log(positive)).alias("_log"), F.count(positive).alias("_positive"))
    if packet is not None:

        @F.pandas_udf("double")
        def fitted(mean: pd.Series, mean_log: pd.Series) -> pd.Series:
            return pd.Series([0.0 if pd.isna(m) else _by_shape(rate, packet, m, x) for m, x in zip(mean, mean_log, strict=True)])

        return sums.withColumn("threshold", fitted("_mean", "_log")).drop("_mean", "_log", "_positive")
    checkpoints(pixels.sparkSession)
    sums = sums.checkpoint()
    at = {name: F.floor(F.lit(share) * F.col("filled")).cast("long") + 1 for name, share in (("tail", rate), ("bulk", BULK))}
    ranks = sums.select(*group, F.explode(F.array(*[F.struct(F.lit(name).alias("which"), k.alias("k")) for name, k in at.items()])).alias("r")).select(*group, "r.which", "r.k")
    found = largest(cut.select(*group, "_e"), group, "_e", ranks)
    both = found.groupBy(*group).agg(*[F.max(F.when(F.col("which") == name, F.col("found"))).alias(name) for name in at])
    names = [f"_b{i}" for i in range(len(group))]
    both = both.withColumnsRenamed(dict(zip(group, names, strict=True)))
    joined = sums.join(both, [F.col(c).eqNullSafe(F.col(b)) for c, b in zip(group, names, strict=True)]).drop(*names)

    @F.pandas_udf("double")
    def bulk_rule(tail: pd.Series, bulk: pd.Series, positive_values: pd.Series) -> pd.Series:
        return pd.Series([_by_bulk(detectors, rate, t, b) if k else 0.0 for t, b, k in zip(tail, bulk, positive_values, strict=True)])

    return joined.withColumn("threshold", bulk_rule("tail", "bulk", "_positive")).drop("_mean", "_log", "_positive")
