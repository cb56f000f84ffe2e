"""Interval algebra on rows (key, start, end), half-open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_cells(df: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    """A row for each cell of ``width`` that an interval touches, for range joins on an equal cell."""
    return df.withColumn("_cell", F.explode(F.sequence(F.floor(start / width).cast("long"), F.floor(end / width).cast("long"))))


def intersect(a: DataFrame, b: DataFrame, key: Sequence[str], width: float | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Overlaps of both sides' intervals per key, with columns of the first side to keep; touching ones do not overlap.

    ``width`` adds cells of that length to the join key; a pair is taken in the
    cell where its overlap starts, so it comes once.
    """
    x = a.select(*key, *keep, F.col("start").alias("s1"), F.col("end").alias("e1"))
    y = b.select(*key, F.col("start").alias("s2"), F.col("end").alias("e2"))
    on = list(key)
    if width:
        x, y, on = with_cells(x, F.col("s1"), F.col("e1"), width), with_cells(y, F.col("s2"), F.col("e2"), width), [*key, "_cell"]
    lo, hi = F.greatest("s1", "s2"), F.least("e1", "e2")
    out = x.join(y, on).where((F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1")))
    if width:
        out = out.where(F.floor(lo / width) == F.col("_cell"))
    return out.select(*key, *keep, lo.alias("start"), hi.alias("end"))


def padded_union(df: DataFrame, key: Sequence[str], half: float, least: float = 1.0) -> DataFrame:
    """Windows of ``half`` on either side of the times ``at``, ``least`` long at least, joined where they touch."""
    half = max(half, least / 2)
    return union(df.select(*key, (F.col("at") - half).alias("start"), (F.col("at") + half).alias("end")), key)


def live_outside(segments: DataFrame, windows: DataFrame, key: Sequence[str], width: float) -> DataFrame:
    """Per key, the length of the segments and what windows leave of it."""
    gone = total(union(intersect(segments, windows, key, width), key), key).withColumnRenamed("livetime", "vetoed")
    return total(segments, key).join(gone, list(key), "left").select(*key, "livetime", (F.col("livetime") - F.coalesce("vetoed", F.lit(0.0))).alias("livetime_left"))


def union(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Intervals joined where one starts no later than an earlier one ends (gaps and islands)."""
    w = Window.partitionBy(*key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_new", new).withColumn("_island", island).groupBy(*key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def clip(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """The parts inside [lo, hi); intervals without any go."""
    out = df.withColumn("start", F.greatest("start", lo)).withColumn("end", F.least("end", hi))
    return out.where("end > start")


def shift_circular(df: DataFrame, shift: Column, duration: Column) -> DataFrame:
    """Intervals in [0, duration) moved by a shift and wrapped: one piece, or two."""
    s = F.pmod(F.col("start") + shift, duration)
    length = F.col("end") - F.col("start")
    whole = F.array(F.struct(F.lit(0).cast("double").alias("start"), duration.cast("double").alias("end")))
    one = F.array(F.struct(s.cast("double").alias("start"), (s + length).cast("double").alias("end")))
    two = F.array(F.struct(s.cast("double").alias("start"), duration.cast("double").alias("end")), F.struct(F.lit(0).cast("double").alias("start"), (s + length - duration).cast("double").alias("end")))
    pieces = F.when(length >= duration, whole).when(s + length <= duration, one).otherwise(two)
    return df.withColumn("_p", F.explode(pieces)).withColumn("start", F.col("_p.start")).withColumn("end", F.col("_p.end")).drop("_p").where("end > start")


def total(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.sum(F.col("end") - F.col("start")).alias("livetime"))


def gaps(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Holes between intervals of a key, by the running maximum of their ends."""
    w = Window.partitionBy(*key).orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_b", before).where(F.col("start") > F.col("_b")).select(*key, F.col("_b").alias("start"), F.col("start").alias("end"))


def max_overlap(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The most intervals that hold one point, per key: a sweep over starts (+1) and ends (-1, first among equals)."""
    ends = df.select(*key, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("x")).select(*key, "x.*")
    w = Window.partitionBy(*key).orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0)
    return ends.withColumn("_k", F.sum("d").over(w)).groupBy(*key).agg(F.max("_k").alias("max_overlap"))
