"""Dense kernels on arrays and grouped pixels, as Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsample(x: np.ndarray, times: int = 4) -> np.ndarray:
    """Zero-padding of the spectrum."""
    n = len(x)
    return np.fft.irfft(np.fft.rfft(x), n * times) * times if n else x


def segment_maxima(x: np.ndarray) -> np.ndarray:
    """Largest |x| of each stretch of one sign, zero being a sign of its own; the first two stretches count as one, and one change is none."""
    sign = np.sign(x)
    stretch = np.concatenate([[0], np.cumsum(sign[1:] != sign[:-1])]) if len(x) else np.zeros(1, int)
    changes = int(stretch[-1])
    out = np.zeros(changes if changes > 1 else 0)
    if changes > 1:
        np.maximum.at(out, np.maximum(stretch, 1) - 1, np.abs(x))
    return out


#: Fixed value: peaks below this part of the largest don't count.
PEAK_SHARE = 1 / 7.58859


def q_veto(wave: np.ndarray) -> tuple[float, float]:
    """Energy away from the largest peak over that in and beside it, and the quality factor from the neighbours' heights."""
    a = segment_maxima(upsample(np.asarray(wave, float)))
    if not len(a):
        return 0.0, 0.0
    top = int(a.argmax())
    away = np.abs(np.arange(len(a)) - top) > 1
    near = (a[~away] ** 2).sum()
    veto = float((a[away & (a > a[top] * PEAK_SHARE)] ** 2).sum() / near) if near > 0 else 0.0
    if top == 0 or top == len(a) - 1 or a[top] <= 0:
        return veto, 0.0
    r = (a[top - 1] + a[top + 1]) / (2 * a[top])
    if r <= 0 or r >= 1:
        return veto, 0.0
    return veto, float(np.sqrt(-np.pi**2 / (2 * np.log(r))))


@F.pandas_udf(T.StructType([T.StructField("qveto", T.DoubleType()), T.StructField("qfactor", T.DoubleType())]))
def q_veto_udf(waves: pd.Series) -> pd.DataFrame:
    got = [q_veto(w) if w is not None and len(w) else (0.0, 0.0) for w in waves]
    return pd.DataFrame(got, columns=["qveto", "qfactor"])


def label_grid(f: np.ndarray, t: np.ndarray, kf: int, kt: int) -> np.ndarray:
    """Components of pixels within kf rows and kt columns of each other, numbered by first occurrence (union-find over sorted columns)."""
    n = len(f)
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    order = np.lexsort((f, t))
    start = 0
    for pos in range(n):
        i = order[pos]
        while t[i] - t[order[start]] > kt:
            start += 1
        for back in range(start, pos):
            j = order[back]
            if abs(int(f[i]) - int(f[j])) <= kf:
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    roots = np.array([find(i) for i in range(n)], int)
    _, label = np.unique(roots, return_inverse=True)
    return label


def cluster_pixels(pixels: DataFrame, group: list[str], kf: int = 3, kt: int = 2) -> DataFrame:
    """Adds ``cluster_id`` to pixels (freq, time) per group, one job, lag and resolution: a unit of analysis of bounded size."""
    schema = ", ".join(f"`{c}` {t}" for c, t in pixels.dtypes) + ", cluster_id long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["time", "freq"], kind="stable")
        return pdf.assign(cluster_id=label_grid(pdf["freq"].to_numpy(), pdf["time"].to_numpy(), kf, kt))

    return pixels.groupBy(*group).applyInPandas(one, schema)


def cluster_statistics(pixels: DataFrame, group: list[str]) -> DataFrame:
    """Likelihood-weighted centre, size and energy of each cluster; native partial sums.  A cluster of likelihood 0 has no centre (NaN)."""
    w = F.col("likelihood")
    # without weight there is no centre: NaN, as a quotient of doubles has it
    centre = lambda c: F.coalesce(F.try_divide(F.sum(w * F.col(c)), F.sum(w)), F.when(F.sum(w) == 0, F.lit(float("nan"))))
    return pixels.groupBy(*group, "cluster_id").agg(F.count("*").alias("size"), F.sum(w).alias("likelihood"), centre("time").alias("time"), centre("freq").alias("freq"))


def whiten(x: np.ndarray, block: int = 64) -> np.ndarray:
    """Divided by the noise level: the median of |x| over blocks, joined linearly."""
    x = np.asarray(x, float)
    n = len(x) // block
    if n == 0:
        return x
    level = np.median(np.abs(x[: n * block]).reshape(n, block), axis=1) / 0.6745
    at = np.arange(n) * block + block / 2
    noise = np.interp(np.arange(len(x)), at, np.maximum(level, 1e-30))
    return x / noise


def resample(x: np.ndarray, old: float, new: float) -> np.ndarray:
    """To another rate through the spectrum."""
    n = int(round(len(x) * new / old))
    return np.fft.irfft(np.fft.rfft(np.asarray(x, float)), n) * (n / len(x)) if n else np.zeros(0)


def map_waves(df: DataFrame, column: str, kernel, out: str) -> DataFrame:
    """A kernel from array to array over a column, batch by batch."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{out}` array<double>"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(**{out: [None if x is None else kernel(x) for x in pdf[column]]})

    return df.mapInPandas(run, schema)


def sky_grid(points: int) -> np.ndarray:
    """Directions (theta, phi in radians) spread evenly over the sphere along a spiral."""
    i = np.arange(points) + 0.5
    return np.stack([np.arccos(1 - 2 * i / points), np.pi * (1 + 5**0.5) * i % (2 * np.pi)], 1)


def sky_scan(data: np.ndarray, grid: np.ndarray) -> tuple[int, float]:
    """The direction whose pattern fits a network's amplitudes best (of equal ones the last), and its statistic, 0 at least."""
    k = data.shape[-1]
    pattern = np.stack([np.cos(grid[:, 1] + j) * np.sin(grid[:, 0] + j) for j in range(k)], 1)
    norm = np.sqrt((pattern**2).sum(1)) + 1e-12
    stat = (pattern @ data) ** 2 / norm**2
    best = len(stat) - 1 - int(stat[::-1].argmax())
    return best, float(max(stat[best], 0.0))


def scan_events(df: DataFrame, column: str, points: int = 512) -> DataFrame:
    """sky_idx and sky_stat of each row's amplitude array."""
    grid = sky_grid(points)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", sky_idx long, sky_stat double"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = [sky_scan(np.asarray(x, float), grid) for x in pdf[column]]
            yield pdf.assign(sky_idx=[g[0] for g in got], sky_stat=[g[1] for g in got])

    return df.mapInPandas(run, schema)
