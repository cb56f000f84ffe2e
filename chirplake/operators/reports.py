"""Composite reports as tables, and the summaries that they are made of."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import catalog, efficiency, far

# The presets of inverse false-alarm rates, in seconds.
IFAR_PRESETS = {"10yr": 315576000, "1yr": 31557600, "6mo": 15778800, "1mo": 2592000, "1wk": 604800, "1day": 86400}


def status_counts(progress: DataFrame) -> DataFrame:
    return progress.groupBy("status").agg(F.count("*").alias("n"))


def interval_summary(progress: DataFrame, by: Sequence[str]) -> DataFrame:
    """Live time, rows and different jobs per key, such as (shift, lag)."""
    return progress.groupBy(*by).agg(F.sum("livetime").alias("livetime"), F.count("*").alias("n_rows"), F.count_distinct("job_id").alias("n_jobs"))


def live_summary(progress: DataFrame, nominal: Column | float) -> DataFrame:
    """One row: live time in seconds, days and years, its range, rows that equal or fall short of a nominal length, jobs."""
    t, nominal = F.col("livetime"), nominal if isinstance(nominal, Column) else F.lit(float(nominal))
    total = F.sum(t)
    return progress.agg(F.count("*").alias("n_rows"), total.alias("livetime"), (total / 86400).alias("days"), (total / catalog.YEAR).alias("years"), F.min(t).alias("least"), F.max(t).alias("most"), F.count_if(F.abs(t - nominal) <= 1e-8 + 1e-5 * F.abs(nominal)).alias("n_equal"), F.count_if(t < nominal - 1e-9).alias("n_less"), F.count_if(t == 0).alias("n_zero"), F.count_distinct(t).alias("n_values"), F.count_distinct("job_id").alias("n_jobs"))


def slag_summary(progress: DataFrame, slag: Column) -> DataFrame:
    return progress.groupBy(slag.alias("slag"), "lag_idx").agg(F.count("*").alias("n_rows"), F.sum("livetime").alias("livetime"))


def matched_profile(matched: DataFrame) -> DataFrame:
    """One row: different simulations, recovered ones, waveforms and the range of their strengths."""
    return matched.agg(F.count_distinct("sim_sim_idx").alias("n_sims"), F.count("id").alias("n_recovered"), F.count_distinct("sim_name").alias("n_waveforms"), F.min("sim_hrss").alias("hrss_min"), F.max("sim_hrss").alias("hrss_max"))


def best_per_event(rows: DataFrame, by: Sequence[str], value: str, tie: str) -> DataFrame:
    """Per key the row of the largest value (null counts below all), of equal ones the smallest tie; a partial aggregate."""
    rank = F.struct(F.coalesce(F.col(value).cast("double"), F.lit(float("-inf"))).alias("v"), (-F.col(tie)).alias("t"))
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(*by, "r.*")


def angle_summary(rows: DataFrame, by: Sequence[str], degrees: str, within: Sequence[float]) -> DataFrame:
    """Per run: events, median, mean, 90th percentile and largest angular error, and the shares within given angles."""
    shares = [F.avg((F.col(degrees) <= x).cast("double")).alias(f"within_{x:g}") for x in within]
    return rows.groupBy(*by).agg(F.count(degrees).alias("n"), F.percentile(degrees, 0.5).alias("median"), F.avg(degrees).alias("mean"), F.percentile(degrees, 0.9).alias("p90"), F.max(degrees).alias("largest"), *shares)


def consistency(rows: DataFrame, by: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Per injection: the runs that have it, the spread of a value between them, and whether that is within a tolerance."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("lo"), (F.max(value) - F.min(value)).alias("spread"))
    return out.withColumn("consistent", F.col("spread") <= tolerance)


def histogram_2d(df: DataFrame, x: str, y: str, lo: tuple[float, float], width: tuple[float, float]) -> DataFrame:
    i, j = (F.floor((F.col(c) - a) / w).cast("long") for c, a, w in zip((x, y), lo, width, strict=True))
    return df.groupBy(i.alias("i"), j.alias("j")).agg(F.count("*").alias("n"))


def auto_histogram(df: DataFrame, value: str, bins: int, sigmas: float | None = None) -> DataFrame:
    """Counts over the values' own range, or over it padded by so many standard deviations."""
    got = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("s")).first()  # one row
    if got["lo"] is None:
        return catalog.histogram(df, value, 0.0, 1.0, bins)
    pad = (sigmas or 0.0) * got["s"]
    lo, hi = float(got["lo"]) - pad, float(got["hi"]) + pad
    hi = hi if hi > lo else lo + 1
    return catalog.histogram(df, value, lo, (hi - lo) / bins, bins)


def poisson_significance(events: DataFrame, rate: float) -> DataFrame:
    """p-value and -log10 of it that a Poisson process of ``rate`` per event counted here gives one."""
    p = 1 - F.exp(-F.count("*") * rate)
    return events.agg(p.alias("p_value"), (-F.log10(F.greatest(p, F.lit(1e-300)))).alias("significance"))


def ifar_threshold(background: DataFrame, value: str, livetime: float, ifar: float) -> float:
    """The quietest value of a given inverse false-alarm rate: of the n loudest that it allows; above all if it allows none."""
    allowed = int(math.floor(livetime / ifar + 1e-12))
    top = background.where(F.col(value).isNotNull()).agg(F.max(value)).first()[0]
    if allowed == 0:
        return float(np.nextafter(float(top), np.inf)) if top is not None else float("inf")
    return float(background.where(F.col(value).isNotNull()).orderBy(F.col(value).desc()).limit(allowed).agg(F.min(value)).first()[0])


def hrss50_by_ifar(simulations: DataFrame, ranking: str, thresholds: dict[str, float], key: str = "name") -> DataFrame:
    """Per waveform and IFAR the strength at which half of the injections rank at or above that IFAR's threshold.

    ``simulations`` has key, hrss and the ranking of the matched trigger (null: missed).  The few thresholds become rows by a generator.
    """
    table = F.array(*[F.struct(F.lit(n).alias("ifar"), F.lit(float(t)).alias("least")) for n, t in thresholds.items()])
    each = simulations.withColumn("_t", F.explode(table)).select("*", "_t.ifar", "_t.least")
    curve = efficiency.by_group(each, [key, "ifar", "hrss"], F.coalesce(F.col(ranking) >= F.col("least"), F.lit(False)))
    return efficiency.crossing(curve, [key, "ifar"]).withColumnRenamed("crossing", "hrss50")


def _ppf(shares: Sequence[float]):
    """Poisson quantiles of each mean: the smallest count whose distribution function reaches the share."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for mu in pdf["mu"].to_numpy(float):
                most = int(mu + 12 * math.sqrt(mu) + 30)
                k = np.arange(most)
                logs = np.concatenate([[0.0], np.cumsum(np.log(np.maximum(mu, 1e-300)) - np.log(k[1:]))]) - mu
                out.append(np.searchsorted(np.cumsum(np.exp(logs)), np.array(shares) - 1e-12).astype(float))
            yield pdf.assign(bands=out)

    return run


def foreground_counts(events: DataFrame, ifar: str, years: float, points: int = 100) -> tuple[DataFrame, DataFrame]:
    """Events at or above each inverse false-alarm rate (years), and the Poisson bands of 1, 2 and 3 sigma at ``points`` of them.

    Counts go over logarithmic bins, of which there are ``points``; rates beyond 10^6 live times are left out.
    """
    good = events.where((F.col(ifar) > 0) & (F.col(ifar) <= max(years * 1e6, 1e10)))
    got = good.agg(F.min(ifar).alias("lo"), F.max(ifar).alias("hi")).first()  # one row
    spark = events.sparkSession
    if got["lo"] is None:
        return spark.createDataFrame([], "ifar double, n_above long"), spark.createDataFrame([], "ifar double, mu double, bands array<double>")
    lo, hi = math.log10(max(got["lo"], 1e-10)), math.log10(max(got["hi"], 1e-10)) + 1e-9
    width = max((hi - lo) / points, 1e-9)
    i = F.least(F.floor((F.log10(ifar) - lo) / width), F.lit(points - 1)).cast("long")
    counts = spark.range(points).toDF("bin").join(good.groupBy(i.alias("bin")).agg(F.count("*").alias("n")), "bin", "left")
    above = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0))
    at = F.pow(F.lit(10.0), F.lit(lo) + F.col("bin") * width)
    curve = counts.select(at.alias("ifar"), above.alias("n_above"))
    tails = (1 - 0.997300, 1 - 0.954499, 1 - 0.682689)
    shares = [*[t / 2 for t in tails], *[1 - t / 2 for t in reversed(tails)]]
    bands = spark.range(points).select(F.pow(F.lit(10.0), F.lit(lo) + F.col("id") * width).alias("ifar")).withColumn("mu", F.lit(years) / F.col("ifar"))
    return curve, bands.mapInPandas(_ppf(shares), "ifar double, mu double, bands array<double>")


def background_report(triggers: DataFrame, value: str, livetime: float, lo: float, width: float, bins: int, top: int = 100, zero_lag: DataFrame | None = None, curve: DataFrame | None = None, tie: str = "id") -> dict[str, DataFrame]:
    """The tables of a background report: the false-alarm curve (or a given one), the loudest events with rank and rate, and, given zero-lag events, those with their rates."""
    curve = far.far_curve(triggers, value, lo, width, bins, livetime) if curve is None else curve
    loudest = catalog.rank_top(triggers, value, tie, top).withColumn("far", F.col("rank") / max(livetime / catalog.YEAR, 1e-10))
    out = {"curve": curve, "loudest": loudest}
    if zero_lag is not None:
        out["zero_lag"] = far.attach_far(zero_lag, value, curve, livetime)
    return out


def zero_lag_report(events: DataFrame, background: DataFrame, value: str, livetime: float, zero_livetime: float) -> dict[str, DataFrame]:
    """Zero-lag events with their own inverse false-alarm rate, and the counts above each with Poisson bands."""
    rated = far.per_event_ifar(events, background, value, livetime).withColumn("ifar_years", F.col("ifar_s") / catalog.YEAR)
    curve, bands = foreground_counts(rated, "ifar_years", zero_livetime / catalog.YEAR)
    return {"events": rated, "counts": curve, "bands": bands}


def write_csv(rows: DataFrame, path: str) -> None:
    """A bounded report as one CSV file with a header; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
