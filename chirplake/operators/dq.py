"""Data quality: lists of segments by detector and category, brought together, and the jobs they leave."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals, jobs


def common(df: DataFrame, key: Sequence[str], source: Sequence[str], n: Column) -> DataFrame:
    """Stretches inside intervals of ``n`` different sources, per key: a sweep over starts and ends, ends first where they touch."""
    own = intervals.union(df.select(*key, *source, "start", "end"), [*key, *source])
    points = own.join(_counted(df, key, n), list(key)) if key else own.withColumn("_n", n)
    points = points.select(*key, "_n", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("x")).select(*key, "_n", "x.*")
    w = Window.partitionBy(*key).orderBy("at", "d")
    swept = points.withColumn("_k", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_to", F.lead("at").over(w))
    pieces = swept.where((F.col("_k") >= F.col("_n")) & (F.col("_to") > F.col("at")))
    return intervals.union(pieces.select(*key, F.col("at").alias("start"), F.col("_to").alias("end")), key)


def _counted(df: DataFrame, key: Sequence[str], n: Column) -> DataFrame:
    return df.groupBy(*key).agg(F.first(n).alias("_n"))


def up_to_category(segments: DataFrame, files: DataFrame, category: str) -> DataFrame:
    """Per detector, what all of its lists up to a category (in the order of their names) have in common.

    ``files`` names each list (ifo, category, file), also one without a segment, which leaves nothing; ``segments`` has their rows.
    """
    wanted = files.where(F.col("category") <= category).groupBy("ifo").agg(F.count_distinct("file").alias("_files"))
    rows = segments.join(files.where(F.col("category") <= category).select("file", "ifo"), ["file", "ifo"]).join(wanted, "ifo")
    return common(rows, ["ifo"], ["file"], F.col("_files"))


def shifted(df: DataFrame, shifts: DataFrame) -> DataFrame:
    """Segments moved by their detector's shift (0 without one)."""
    out = df.join(shifts.select("ifo", F.col("shift").alias("_s")), "ifo", "left")
    s = F.coalesce("_s", F.lit(0.0))
    return out.withColumn("start", F.col("start") + s).withColumn("end", F.col("end") + s).drop("_s")


def veto_windows(segments: DataFrame, files: DataFrame, category: str, n_ifo: int, shifts: DataFrame | None = None) -> DataFrame:
    """What all detectors' lists up to a category have in common, each detector moved by its shift."""
    rows = segments if shifts is None else shifted(segments, shifts)
    return common(up_to_category(rows, files, category), [], ["ifo"], F.lit(n_ifo))


def even_length(df: DataFrame, rate: float) -> DataFrame:
    """A second less where a job has an odd number of samples at a rate."""
    odd = F.floor((F.col("end") - F.col("start")) * rate + 0.001).cast("long") % 2 == 1
    return df.withColumn("end", F.when(odd, F.col("end") - 1).otherwise(F.col("end")))


def jobs_of(live: DataFrame, length: float, least: float, edge: float, rate: float, overlap: float = 0.0, slags: Sequence[Sequence[float]] = ((0.0,),), windows: DataFrame | None = None) -> DataFrame:
    """Jobs of live intervals for each superlag, numbered, of even length, prolonged by the overlap, with their part of the veto windows.

    Superlags are a configured list, so a generator makes the jobs' copies.
    """
    out = jobs.split_jobs(live.select("start", "end"), length, least, edge)
    out = even_length(out, rate).withColumn("end", F.col("end") + overlap)
    lists = F.array(*[F.struct(F.lit(i).alias("slag_idx"), F.array(*[F.lit(float(x)) for x in s]).alias("shift")) for i, s in enumerate(slags)])
    out = out.withColumn("_s", F.explode(lists)).select("_s.slag_idx", "_s.shift", "start", "end")
    if windows is None:
        return out
    inside = intervals.intersect(out.select("slag_idx", "start", "end", F.struct("slag_idx", "start").alias("job")), windows.select("start", "end").withColumn("slag_idx", F.explode(F.array(*[F.lit(i) for i in range(len(slags))]))), ["slag_idx"], width=max(length, 1.0), keep=["job"])
    kept = inside.groupBy("job").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("windows"))  # windows of one job
    return out.withColumn("job", F.struct("slag_idx", "start")).join(kept, "job", "left").drop("job")
