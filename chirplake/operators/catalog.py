"""The trigger catalogue and its progress table: keep-last rows, stale rows, live time, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("job_id", "id", "trial_idx", "lag_idx")
#: Fixed value: seconds of a (Julian) year.
YEAR = 86400 * 365.25


def keep_last(df: DataFrame, key: Sequence[str] = KEY, order: str = "_seq") -> DataFrame:
    """Of rows with one key (columns that are there), the last in ingest order; a null order comes first, and equal ones go by the rows' hash.

    A maximum per key with partial sums before the shuffle, not a window, so a
    key with very many rows is no single group.
    """
    key = [k for k in key if k in df.columns]
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest))).alias("_row"))
    return last.select(*key, "_row.*").select(*df.columns)


def remove_stale(triggers: DataFrame, completed: DataFrame, job: Column) -> DataFrame:
    """Drops triggers of the chosen jobs whose (job, trial, lag) was not completed; other jobs stay."""
    keys = [k for k in ("job_id", "trial_idx", "lag_idx") if k in completed.columns]
    done = completed.select(*keys).distinct()
    return triggers.where(~job).unionByName(triggers.where(job).join(done, keys, "left_semi"))


def completed_lags(progress: DataFrame, status: str = "completed") -> DataFrame:
    by = [k for k in ("job_id", "trial_idx") if k in progress.columns]
    return progress.where(F.col("status") == status).groupBy(*by).agg(F.count_distinct("lag_idx").alias("n_lags"))


def live_time(progress: DataFrame, where: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Summed live time of the progress rows that a condition lets through, in all or per key."""
    rows = progress if where is None else progress.where(where)
    return rows.groupBy(*by).agg(F.sum("livetime").alias("livetime"), F.count("*").alias("n_rows"))


def live_time_from_jobs(jobs: DataFrame, n_lags: int) -> DataFrame:
    """The fallback without a progress table: each job's length for each of its lags, made by a generator, not a join."""
    return jobs.withColumn("lag_idx", F.explode(F.sequence(F.lit(0), F.lit(n_lags - 1)))).withColumn("livetime", F.col("analyze_end") - F.col("analyze_start"))


def progress_by_job(progress: DataFrame, done: str = "completed") -> DataFrame:
    is_done = F.col("status") == done
    return progress.groupBy("job_id").agg(
        F.sum(is_done.cast("long")).alias("n_done"),
        F.sum((~is_done).cast("long")).alias("n_skipped"),
        F.sum("livetime").alias("livetime"),
        F.max("timestamp").alias("last_seen"),
    )


def combine_summaries(parts: DataFrame) -> DataFrame:
    """Summaries of fragments to one per job."""
    return parts.groupBy("job_id").agg(F.sum("n_done").alias("n_done"), F.sum("n_skipped").alias("n_skipped"), F.sum("livetime").alias("livetime"), F.max("last_seen").alias("last_seen"))


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """Catalogues of several runs, by column name, each row with its run."""
    frames = [df.withColumn("run", F.lit(name)) for name, df in runs.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, min, median, max of each column, a row per column."""
    one = df.agg(*[F.struct(F.count(c).alias("n"), F.min(c).cast("double").alias("lo"), F.percentile(c, 0.5).alias("median"), F.max(c).cast("double").alias("hi")).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}.n").alias("n"), F.col(f"{c}.lo").alias("lo"), F.col(f"{c}.median").alias("median"), F.col(f"{c}.hi").alias("hi")) for c in columns])).alias("x")).select("x.*")


def histogram(df: DataFrame, value: str, lo: float, width: float, bins: int) -> DataFrame:
    """Counts per bin; bins are half-open, the last closed; values outside are left out."""
    hi = lo + width * bins
    i = F.when(F.col(value) == hi, F.lit(bins - 1)).otherwise(F.floor((F.col(value) - lo) / width))
    return df.where(F.col(value).between(lo, hi)).groupBy(i.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def binned_max(df: DataFrame, x: str, y: str, lo: float, width: float) -> DataFrame:
    """Maximum of y and count per right-closed bin of x; the least value belongs to the first bin."""
    i = F.greatest(F.ceil((F.col(x) - lo) / width) - 1, F.lit(0))
    return df.where(F.col(x) >= lo).groupBy(i.cast("long").alias("bin")).agg(F.max(y).alias("y_max"), F.count("*").alias("n"))


def rank_top(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    """The n largest with their rank: a bounded report; ranks are given to those n only."""
    top = df.orderBy(F.col(by).desc(), tie).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col(by).desc(), F.col(tie))).cast("long"))
