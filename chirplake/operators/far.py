"""False-alarm rates: binned curves, rates above thresholds, significance, per-event values.

Reverse cumulative counts run over bins, of which there are boundedly many, not
over triggers; counts of the background above each foreground value go through
range buckets, so neither side is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import YEAR
from .graph import BUCKETS


def _cumulated(bins: DataFrame, key: str, n: str) -> Column:
    return F.sum(n).over(Window.orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0))


def far_curve(triggers: DataFrame, value: str, lo: float, width: float, bins: int, livetime: float) -> DataFrame:
    """Per bin (half-open, the last closed): count, count of it and all above, and that per year of live time; empty bins too."""
    hi = lo + width * bins
    i = F.when(F.col(value) == hi, F.lit(bins - 1)).otherwise(F.floor((F.col(value) - lo) / width)).cast("long")
    counts = triggers.where(F.col(value).between(lo, hi)).groupBy(i.alias("bin")).agg(F.count("*").alias("n"))
    grid = triggers.sparkSession.range(bins).withColumnRenamed("id", "bin")
    full = grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    cum = _cumulated(full, "bin", "n")
    years = max(livetime / YEAR, 1e-10)
    return full.select("bin", (F.lit(lo) + (F.col("bin") + 0.5) * width).alias("center"), "n", cum.alias("n_above"), (cum / F.lit(years)).alias("far"))


def cumulative_rate(triggers: DataFrame, value: str, thresholds: list[float], livetime: float) -> DataFrame:
    """Events at or above each threshold, their rate and its square-root error; thresholds ascend."""
    if livetime <= 0:
        raise ValueError("live time must be positive")
    edges = F.array(*[F.lit(float(x)) for x in thresholds])
    # the number of thresholds an event reaches; then sums over at most that many rows
    reached = F.size(F.filter(edges, lambda x: x <= F.col(value)))
    counts = triggers.groupBy(reached.alias("k")).agg(F.count("*").alias("n"))
    grid = triggers.sparkSession.createDataFrame([(i + 1, float(x)) for i, x in enumerate(thresholds)], "k int, threshold double")
    full = grid.join(counts, "k", "left").select("k", "threshold", F.coalesce("n", F.lit(0)).alias("n"))
    cum = _cumulated(full, "k", "n")
    return full.select("threshold", cum.alias("n_above"), (cum / livetime).alias("rate"), (F.sqrt(cum) / livetime).alias("rate_error"))


def attach_far(events: DataFrame, value: str, curve: DataFrame, livetime: float) -> DataFrame:
    """far, ifar_years and significance of each event, from the curve's bin at or below its value (clipped at both ends).

    The curve is a bounded table of bins, one array as a scalar subquery; the bin
    is found by counting the array's bins, not by a join.
    """
    least = F.min(F.when(F.col("far") > 0, F.col("far")))
    one = curve.agg(F.struct(F.sort_array(F.collect_list(F.struct("center", "far"))).alias("bins"), least.alias("least")).alias("c"))
    out = events.withColumn("_curve", one.scalar()).withColumn("bins", F.col("_curve.bins")).withColumn("least", F.col("_curve.least")).drop("_curve")
    at = F.greatest(F.size(F.filter("bins", lambda b: b["center"] <= F.col(value))) - 1, F.lit(0))
    far = F.greatest(F.get("bins", at)["far"], F.col("least"))
    out = out.withColumn("far", far).drop("bins", "least")
    mu = F.col("far") * (livetime / YEAR)
    p = F.lit(1.0) - F.exp(-mu)
    return out.withColumn("ifar_years", 1.0 / F.greatest("far", F.lit(1e-30))).withColumn("significance", -F.log10(F.greatest(p, F.lit(1e-300))))


def count_at_least(events: DataFrame, background: DataFrame, value: str, bkg_value: str) -> DataFrame:
    """``n_above``: the background values at or above each event's value; null for an event without a value.

    Background is counted per distinct value in BUCKETS ranges, cut at its quantiles.  An event adds the ranges above
    its own (a running sum over ranges) and the values above it inside its range, by a join on the range.
    """
    kinds = background.where(F.col(bkg_value).isNotNull()).groupBy(F.col(bkg_value).alias("_v")).agg(F.count("*").alias("_n"))
    edges = sorted(set(kinds.approxQuantile("_v", [i / BUCKETS for i in range(1, BUCKETS)], 0.2 / BUCKETS)))  # BUCKETS values
    places = F.array(*[F.lit(x) for x in edges]) if edges else F.array().cast("array<double>")
    bucket = lambda c: F.size(F.filter(places, lambda x: x <= F.col(c))).cast("long")
    kinds = kinds.withColumn("_b", bucket("_v"))
    per_bucket = kinds.groupBy("_b").agg(F.sum("_n").alias("_in"))
    wanted = events.where(F.col(value).isNotNull()).select(value).distinct().withColumn("_b", bucket(value))
    # running sums inside a bucket, by value: both sides in one order, the background first among equals
    both = kinds.select("_b", F.col("_v").alias("v"), "_n", F.lit(0).alias("ask")).unionByName(wanted.select("_b", F.col(value).alias("v"), F.lit(0).cast("long").alias("_n"), F.lit(1).alias("ask")))
    inside = both.withColumn("_here", F.sum("_n").over(Window.partitionBy("_b").orderBy(F.col("v").desc(), "ask").rowsBetween(Window.unboundedPreceding, 0))).where("ask = 1")
    slots = per_bucket.select("_b", "_in").unionByName(wanted.select("_b").distinct().withColumn("_in", F.lit(0).cast("long"))).groupBy("_b").agg(F.sum("_in").alias("_in"))
    above = slots.withColumn("_over", F.coalesce(F.sum("_in").over(Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # BUCKETS rows
    counted = inside.join(above.select("_b", "_over"), "_b").select(F.col("v").alias(value), (F.col("_here") + F.col("_over")).alias("n_above"))
    return events.join(counted, value, "left")


def per_event_ifar(events: DataFrame, background: DataFrame, value: str, livetime: float) -> DataFrame:
    """n_above, far_hz = n / live time, ifar_s = live time / n (null where nothing is as loud); all null for an event without a value."""
    out = count_at_least(events, background, value, value)
    return out.withColumn("far_hz", F.col("n_above") / max(livetime, 1.0)).withColumn("ifar_s", F.when(F.col("n_above") > 0, F.lit(livetime) / F.col("n_above")))


def interpolate(events: DataFrame, value: str, points: list[tuple[float, float]]) -> Column:
    """Linear interpolation in ascending points, clamped at the ends."""
    xs = [p[0] for p in points]
    out = F.when(F.col(value) <= xs[0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(F.col(value) <= x1, y0 + (F.col(value) - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(F.lit(points[-1][1]))
