"""From data-quality intervals to jobs, superlags and injection schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import graph

#: Of interval starts, for running sums over all intervals.
BUCKETS = 256


def split_jobs(intervals: DataFrame, length: float, least: float, edge: float) -> DataFrame:
    """Jobs of each live interval: whole lengths, and a rest that is halved where both halves are long enough.

    One generator per interval row; nothing moves but the jobs' numbering per interval.
    """
    a, b = F.ceil("start") + F.lit(float(edge)), F.floor("end") - F.lit(float(edge))
    live = intervals.withColumn("_a", a.cast("double")).withColumn("_b", b.cast("double")).withColumn("_l", F.col("_b") - F.col("_a")).where("_l > 0")
    live = live.withColumn("_n", F.floor(F.col("_l") / length).cast("int"))
    seg = lambda s, e: F.struct(s.cast("double").alias("start"), e.cast("double").alias("end"))
    a, b, n, ln = F.col("_a"), F.col("_b"), F.col("_n"), F.col("_l")
    none = F.array().cast("array<struct<start:double,end:double>>")
    half = F.floor(ln / 2)
    short = F.when(ln >= least, F.array(seg(a, b))).otherwise(none)
    single = F.when((ln > length) & (half >= least), F.array(seg(a, a + half), seg(a + half, b))).when(ln > length, F.array(seg(a, a + length))).otherwise(F.array(seg(a, b)))
    body = F.when(n >= 2, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: seg(a + i * length, a + (i + 1) * length))).otherwise(none)
    at = a + (n - 1) * length
    rest = F.floor((b - at) / 2)
    tail = F.when(rest >= least, F.array(seg(at, at + rest), seg(at + rest, b))).otherwise(F.array(seg(at, at + length)))
    jobs = F.when(n == 0, short).when(n == 1, single).otherwise(F.concat(body, tail))
    keep = [c for c in intervals.columns if c not in ("start", "end")]
    return live.select(*keep, F.posexplode(jobs).alias("piece", "j")).select(*keep, "piece", "j.start", "j.end")


def superlags(spark: SparkSession, n_ifo: int, most: int, lo: int = 0, hi: int | None = None, off: int = 0, size: int | None = None) -> DataFrame:
    """Shift tuples: the zero tuple, and tuples of distinct non-zero shifts in [-most, most] with 0 first, by (sum of sizes, tuple).

    Tuples are made by nested generators from one row per first shift.
    """
    out = spark.range(-most, most + 1).select(F.array(F.lit(0).cast("long"), "id").alias("shift"))
    for _ in range(n_ifo - 2):
        out = out.select("shift", F.explode(F.sequence(F.lit(-most).cast("long"), F.lit(most).cast("long"))).alias("s")).select(F.concat("shift", F.array("s")).alias("shift"))
    rest = F.slice("shift", 2, n_ifo - 1)
    zero = F.forall(rest, lambda x: x == 0)
    distinct = F.forall(rest, lambda x: x != 0) & (F.size(F.array_distinct(rest)) == n_ifo - 1)
    distance = F.aggregate(rest, F.lit(0).cast("long"), lambda a, x: a + F.abs(x))
    out = out.where(zero | distinct).withColumn("distance", distance).where(F.col("distance") >= lo)
    if hi is not None:
        out = out.where(F.col("distance") <= hi)
    out = out.orderBy("distance", "shift")
    if off:
        out = out.offset(off)
    return out.limit(size) if size is not None else out


def lag_shifts(n_lags: int, step: float, detector: int) -> Column:
    """One row per lag: its number and the detector's shift."""
    return F.explode(F.transform(F.sequence(F.lit(0), F.lit(n_lags - 1)), lambda i: F.struct(i.alias("lag_idx"), (i * step * detector).alias("shift"))))


def by_trial(jobs: DataFrame) -> DataFrame:
    """A row per job and trial (array column ``trials``), renumbered in (job, trial) order."""
    flat = jobs.withColumn("trial_idx", F.explode(F.array_distinct("trials"))).drop("trials")
    return graph.numbered(flat, "job_id", ["job_id", "trial_idx"], "index").withColumn("index", (F.col("index") + 1).cast("int"))


def schedule_at_rate(injections: DataFrame, intervals: DataFrame, rate: float, key: str, count: int | None = None) -> DataFrame:
    """Injections on evenly spaced places of the concatenated live time; more than fit are spread over further trials.

    Intervals (start, end, interval_id) get their range of the concatenated axis
    by a running sum over ``BUCKETS`` of their starts and then inside one of
    them; a place finds its interval by cells of that axis, as many as intervals.
    """
    size = F.col("end") - F.col("start")
    got = intervals.agg(F.sum(size).alias("t"), F.min("start").alias("lo"), F.max("start").alias("hi"), F.count("*").alias("n")).first()  # one row
    total = got["t"]
    if not total or 1 / rate > total:
        raise ValueError("the rate leaves no place in the live time")
    capacity = int(total * rate)
    first, last = 1 / (2 * rate), total - 1 / (2 * rate)
    step = (last - first) / (capacity - 1) if capacity > 1 else 0.0
    bucket = F.least(F.floor((F.col("start") - got["lo"]) / max((got["hi"] - got["lo"]) / BUCKETS, 1e-9)), F.lit(BUCKETS - 1))
    dealt = intervals.withColumn("_b", bucket.cast("long"))
    per = dealt.groupBy("_b").agg(F.sum(size).alias("_s"))
    before = per.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    w = Window.partitionBy("_b").orderBy("start", "interval_id").rowsBetween(Window.unboundedPreceding, 0)
    # a broadcast of BUCKETS rows at most
    axis = dealt.withColumn("_in", F.sum(size).over(w)).join(F.broadcast(before), "_b").withColumn("_hi", F.col("_before") + F.col("_in")).withColumn("_lo", F.col("_hi") - size)
    numbered = injections.withColumn("_i", F.col(key) if count is None else F.pmod(F.col(key), F.lit(count)))
    placed = numbered.withColumn("trial_idx", F.floor(F.col("_i") / capacity).cast("long")).withColumn("_pos", F.lit(first) + F.pmod(F.col("_i"), F.lit(capacity)) * F.lit(step))
    cell = max(total / max(got["n"], 64), 1e-9)
    axis = axis.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / cell).cast("long"), F.floor(F.col("_hi") / cell).cast("long"))))
    out = placed.withColumn("_cell", F.floor(F.col("_pos") / cell).cast("long")).join(axis.select("_cell", "_lo", "_hi", "start", "interval_id"), "_cell")
    out = out.where((F.col("_pos") >= F.col("_lo")) & (F.col("_pos") < F.col("_hi")))
    return out.withColumn("gps_time", F.col("start") + F.col("_pos") - F.col("_lo")).drop("_i", "_pos", "_cell", "_lo", "_hi", "start")


def own_segment(points: DataFrame, segments: DataFrame, at: str, cell: float) -> DataFrame:
    """Each point with the first (smallest index) segment that holds it, null if none does.  Equal points have equal segments, and nulls are values like others."""
    s = segments.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / cell).cast("long"), F.floor(F.col("end") / cell).cast("long"))))
    hits = points.withColumn("_cell", F.floor(F.col(at) / cell).cast("long")).join(s, "_cell").where((F.col("start") <= F.col(at)) & (F.col(at) < F.col("end")))
    owned = hits.groupBy(F.col(at).alias("_at")).agg(F.min("segment_idx").alias("segment_idx"))  # a segment depends on the time alone
    return points.join(owned, F.col(at) == F.col("_at"), "left").drop("_at")


def in_windows(points: DataFrame, windows: DataFrame, at: str, cell: float, name: str) -> DataFrame:
    """Flags points that lie in any window (a null time in none); what else the points hold does not matter."""
    w = windows.select(F.col("start").alias("_s"), F.col("end").alias("_e")).withColumn("_c", F.explode(F.sequence(F.floor(F.col("_s") / cell).cast("long"), F.floor(F.col("_e") / cell).cast("long"))))
    times = points.select(F.col(at).alias("_at")).distinct().withColumn("_cell", F.floor(F.col("_at") / cell).cast("long"))
    inside = times.join(w, (F.col("_cell") == F.col("_c")) & (F.col("_at") >= F.col("_s")) & (F.col("_at") < F.col("_e")), "left_semi").select("_at").withColumn(name, F.lit(True))
    return points.join(inside, F.col(at) == F.col("_at"), "left").drop("_at").withColumn(name, F.coalesce(name, F.lit(False)))
