"""Injections in time: at a rate or as a Poisson process, in jobs' intervals or in one GPS range.

Draws depend on the seed and the row's keys alone, so a task that runs again draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoints, spread
from . import graph, intervals, jobs
from .sky import uniform


def usable(job_rows: DataFrame, windows: DataFrame | None = None, width: float = 1000.0) -> DataFrame:
    """(start, end, job_id): what may hold injections of each job, its analysed time clipped to its veto windows, numbered by start."""
    rows = job_rows.select("job_id", F.col("analyze_start").alias("start"), F.col("analyze_end").alias("end"))
    if windows is not None:
        rows = intervals.intersect(rows, windows.select("job_id", "start", "end"), ["job_id"], width)
    return graph.numbered(rows.where("end > start"), "start", ["start", "job_id"], "interval_id")


def jittered(placed: DataFrame, jitter: float, rate: float, key: str, seed: int = 0, at: str = "gps_time") -> DataFrame:
    """Times moved by up to ``jitter`` either way, and kept within their interval (start, end) where the rows have one."""
    if jitter > 1 / (2 * rate):
        raise ValueError("the jitter is more than half the distance of two injections")
    moved = F.col(at) + (uniform(seed, key) * 2 - 1) * jitter
    if {"start", "end"} <= set(placed.columns):
        moved = F.greatest(F.col("start"), F.least(F.col("end"), moved))
    return placed.withColumn(at, moved)


def in_range_at_rate(injections: DataFrame, rate: float, start: float, end: float, key: str, count: int, edge: float = 0.0, repeat: bool = True) -> DataFrame:
    """Evenly spaced times between start and end; what does not fit goes to further trials.  ``key`` numbers the ``count`` injections from 0."""
    room = end - start - 2 * edge
    if 1 / rate > room or (count / rate > room and not repeat):
        raise ValueError("not enough time for the rate")
    each = count if count / rate <= room else int(room * rate)
    first, last = start + 1 / (2 * rate), end - 1 / (2 * rate)
    step = (last - first) / (each - 1) if each > 1 else 0.0
    i = F.col(key)
    return injections.withColumn("trial_idx", F.floor(i / each).cast("long")).withColumn("gps_time", F.lit(first) + (i % each) * F.lit(step))


def _arrivals(rate: float, seed: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for trial, interval, start, end in zip(pdf["trial_idx"], pdf["interval_id"], pdf["start"], pdf["end"], strict=True):
                rng = np.random.default_rng([seed, int(trial), int(interval)])
                n = max(int((end - start) * rate + 6 * math.sqrt((end - start) * rate) + 10), 1)
                at = start + np.cumsum(rng.exponential(1 / rate, n))
                while at[-1] < end:
                    at = np.append(at, at[-1] + np.cumsum(rng.exponential(1 / rate, n)))
                out.append(at[at < end])
            yield pdf.assign(times=out)

    return run


def _drawn(rows: DataFrame, trials: int, rate: float, seed: int) -> DataFrame:
    """The arrivals of each interval in each trial."""
    slots = rows.select("interval_id", "start", "end").withColumn("trial_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trials - 1).cast("long"))))
    return spread(slots, "interval_id", "trial_idx").mapInPandas(_arrivals(rate, seed), "interval_id long, start double, end double, trial_idx long, times array<double>")


def in_intervals_poisson(injections: DataFrame, rate: float, rows: DataFrame, key: str, count: int, seed: int = 0, most_trials: int | None = None) -> DataFrame:
    """Injections, numbered from 0 by ``key``, on the arrivals of a Poisson process in each trial's intervals (interval_id, start, end), trial after trial until none is left.

    Each interval of each trial draws its own arrivals; they are numbered by running sums of their counts.
    Where the first trials have too few arrivals, more are drawn; with ``most_trials``, what finds no arrival in them is left out.
    """
    checkpoints(rows.sparkSession)
    total = rows.agg(F.sum(F.col("end") - F.col("start")).alias("t")).first()["t"] or 0.0  # one row
    if total <= 0:
        raise ValueError("there is no live time")
    per = rate * total
    trials = max(1, math.ceil((count + 8 * math.sqrt(count + 1) + 8) / per))
    while True:
        trials = min(trials, most_trials) if most_trials else trials
        drawn = _drawn(rows, trials, rate, seed).checkpoint()  # read four times
        arrivals = drawn.agg(F.sum(F.size("times")).alias("n")).first()["n"] or 0  # one row
        if arrivals >= count or trials == most_trials:
            break
        trials += max(1, math.ceil(2 * (count - arrivals) / per))
    drawn = drawn.withColumn("_axis", F.col("trial_idx") + F.col("interval_id") / F.lit(1e15))
    first = graph.running(drawn, "_axis", ["trial_idx", "interval_id"], F.size("times"), "_first")
    each = first.select("trial_idx", "interval_id", "_first", F.posexplode("times").alias("_k", "gps_time")).select("trial_idx", "interval_id", "gps_time", (F.col("_first") + F.col("_k")).cast("long").alias("_i"))
    # Spark takes the arrivals for as few as their intervals, and would send all of them through the driver as a broadcast
    return injections.join(each.where(F.col("_i") < count).hint("merge"), injections[key] == each["_i"]).drop("_i")


def in_range_poisson(spark: SparkSession, injections: DataFrame, rate: float, start: float, end: float, key: str, count: int, edge: float = 0.0, seed: int = 0, most_trials: int | None = None) -> DataFrame:
    """The same in one GPS range."""
    whole = spark.createDataFrame([(0, start + edge, end - edge)], "interval_id long, start double, end double")
    return in_intervals_poisson(injections, rate, whole, key, count, seed, most_trials)


def schedule(injections: DataFrame, rows: DataFrame, rate: float, key: str, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """At a fixed rate over the jobs' intervals, with jitter."""
    out = jobs.schedule_at_rate(injections, rows, rate, key)
    if not jitter:
        return out
    return jittered(out.join(rows.select("interval_id", "start", "end"), "interval_id"), jitter, rate, key, seed).drop("start", "end")


def routed(injections: DataFrame, job_rows: DataFrame) -> DataFrame:
    """Injections with their owner's row; an unknown job_id is an error."""
    lost = injections.join(job_rows.select("job_id"), "job_id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no job {lost[0]['job_id']}")
    return injections.join(job_rows, "job_id")


def flags(points: DataFrame, segments: DataFrame, cat0: DataFrame | None, cat2: DataFrame | None, at: str, cell: float) -> DataFrame:
    """Each injection's segment and veto flags: outside all CAT0 windows, outside every segment, outside the veto windows; null where a list is not there.

    ``across``: the injection's two ends (real_start, real_end) lie in different segments, or one in none.
    """
    out = jobs.own_segment(points, segments, at, cell)
    out = out.withColumn("vetoed_cat1", F.col("segment_idx").isNull())
    for name, windows in (("vetoed_cat0", cat0), ("vetoed_cat2", cat2)):
        if windows is None:
            out = out.withColumn(name, F.lit(None).cast("boolean"))
        else:
            out = jobs.in_windows(out, windows, at, cell, "_in").withColumn(name, ~F.col("_in")).drop("_in")
    ends = []
    for end in ("real_start", "real_end"):
        out = jobs.own_segment(out.withColumnRenamed("segment_idx", "_own"), segments, end, cell).withColumnsRenamed({"segment_idx": f"_{end}", "_own": "segment_idx"})
        ends.append(F.col(f"_{end}"))
    across: Column = ~ends[0].eqNullSafe(ends[1])
    return out.withColumn("across_segments", across).drop("_real_start", "_real_end")
