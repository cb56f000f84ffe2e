"""Noise, simple waveforms and thresholds: what a test of a search injects, as columns and seeded kernels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def psd_on_grid(rows: DataFrame, step: float, bins: int) -> DataFrame:
    """(bin, psd): the square of an amplitude spectrum (freq, asd) on a uniform grid, linear between its rows and zero outside.

    Each row fills the grid up to the next one by a generator.
    """
    from pyspark.sql import Window

    w = Window.orderBy("freq")  # a spectrum is one bounded list
    pairs = rows.select("freq", "asd").withColumn("f2", F.lead("freq").over(w)).withColumn("a2", F.lead("asd").over(w)).where("f2 > freq")
    first, last = F.ceil(F.col("freq") / step), F.ceil(F.col("f2") / step) - 1
    each = pairs.where(first <= last).withColumn("bin", F.explode(F.sequence(first, last)))
    end = rows.agg(F.max_by(F.struct("freq", "asd"), "freq").alias("e")).select((F.col("e.freq") / step).alias("b"), F.col("e.asd").alias("a")).where("b = floor(b)")
    asd = F.col("asd") + (F.col("a2") - F.col("asd")) * (F.col("bin") * step - F.col("freq")) / (F.col("f2") - F.col("freq"))
    known = each.select("bin", asd.alias("a")).union(end.select(F.col("b").cast("long"), "a"))
    grid = rows.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return grid.join(known, "bin", "left").select("bin", F.coalesce(F.col("a") * F.col("a"), F.lit(0.0)).alias("psd"))


def coloured(n: int, rate: float, psd: np.ndarray, step: float, rng: np.random.Generator) -> np.ndarray:
    """Gaussian noise of n samples with a one-sided spectrum given every ``step`` Hz; no power at zero frequency."""
    f = np.fft.rfftfreq(n, 1 / rate)
    level = np.sqrt(np.interp(f, np.arange(len(psd)) * step, psd, right=0.0) * n * rate / 4)
    z = level * (rng.standard_normal(len(f)) + 1j * rng.standard_normal(len(f)))
    z[0] = 0
    if n % 2 == 0:
        z[-1] = z[-1].real * math.sqrt(2)
    return np.fft.irfft(z, n)


def noise(jobs: DataFrame, seconds: float, rate: float, psd: list[float], step: float, seed: int = 0) -> DataFrame:
    """Jobs (job_id, ifo) with ``strain``: noise that the seed, the job and the detector's name determine."""
    n, level = int(seconds * rate), np.asarray(psd, float)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(strain=[coloured(n, rate, level, step, np.random.default_rng([seed, int(j), *i.encode()])) for j, i in zip(pdf["job_id"], pdf["ifo"], strict=True)])

    return jobs.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in jobs.dtypes) + ", strain array<double>")


def sine_gaussian(frequency: Column, quality: Column, hrss: Column, seconds: float, rate: float) -> tuple[Column, Column]:
    """Both polarisations of a sine-Gaussian around the middle of the stretch, of root-sum-square ``hrss`` together."""
    n = int(seconds * rate)
    times = F.sequence(F.lit(0), F.lit(n - 1))
    tau = quality / (math.sqrt(2) * math.pi * frequency)
    t = lambda i: i / rate - seconds / 2
    envelope = lambda i: F.exp(-F.pow(t(i) / tau, F.lit(2.0)))
    raw = [F.transform(times, lambda i: envelope(i) * F.sin(2 * math.pi * frequency * t(i))), F.transform(times, lambda i: envelope(i) * F.cos(2 * math.pi * frequency * t(i)))]
    power = F.aggregate(F.zip_with(*raw, lambda a, b: a * a + b * b), F.lit(0.0), lambda a, x: a + x) / rate
    scale = hrss / F.sqrt(power)
    return F.transform(raw[1], lambda x: x * scale), F.transform(raw[0], lambda x: x * scale)


def projected(plus: Column, cross: Column, f_plus: Column, f_cross: Column) -> Column:
    """A detector's strain from both polarisations and its patterns."""
    return F.zip_with(plus, cross, lambda p, c: p * f_plus + c * f_cross)


def upper_gamma(n: int, x: float) -> float:
    """The regularised upper incomplete gamma function of a whole n: the chance that n or more arrivals have not come."""
    term, total = 1.0, 1.0
    for k in range(1, n):
        term *= x / k
        total += term
    return math.exp(-x) * total


def inverse_upper_gamma(n: int, p: float) -> float:
    """x where upper_gamma(n, x) is p, by bisection."""
    low, high = 0.0, 1.0
    while upper_gamma(n, high) > p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if upper_gamma(n, mid) > p else (low, mid)
    return (low + high) / 2


def pair_threshold(amplitude: float, n_ifo: int) -> float:
    """The energy that n - 1 detectors exceed as often as n exceed an amplitude each; with one detector the amplitude itself."""
    if n_ifo == 1:
        return max(0.0, amplitude)
    p = min(max(upper_gamma(n_ifo, amplitude * amplitude * n_ifo), 1e-12), 1 - 1e-12)
    return inverse_upper_gamma(n_ifo - 1, p)


def csr(rows: Column) -> Column:
    """An array of arrays as its values one after the other and their offsets."""
    sizes = F.transform(rows, lambda r: F.size(r))
    offsets = F.transform(F.sequence(F.lit(0), F.size(rows)), lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, x: a + x))
    return F.struct(F.flatten(rows).alias("values"), offsets.alias("offsets"))


def from_csr(packed: Column) -> Column:
    at = packed["offsets"]
    return F.transform(F.sequence(F.lit(1), F.size(at) - 1), lambda i: F.slice(packed["values"], F.get(at, i - 1) + 1, F.get(at, i) - F.get(at, i - 1)))


def lag_ids(n_ifo: int, size: int, most: int, offset: int = 0, seed: int = 13, tries: int = 1_000_000) -> list[list[int]]:
    """Different shift vectors, the zero one first: shifts of different detectors differ, and the smallest of each vector is 0."""
    rng, seen, out = np.random.default_rng(seed), {(0,) * n_ifo}, [[0] * n_ifo]
    for _ in range(tries):
        if len(out) >= offset + size:
            break
        ids = [0, *rng.integers(-most, most + 1, n_ifo - 1).tolist()]
        if len(set(ids)) < n_ifo:
            continue
        ids = [i - min(ids) for i in ids]
        if tuple(ids) not in seen:
            seen.add(tuple(ids))
            out.append(ids)
    return out[offset:]
