"""Detection efficiency of injected signals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoints


def by_group(sims: DataFrame, key: Sequence[str], detected: Column) -> DataFrame:
    """Simulations, detected ones and their ratio per group."""
    return sims.groupBy(*key).agg(F.count("*").alias("n_sims"), F.sum(detected.cast("long")).alias("n_detected")).withColumn("efficiency", F.col("n_detected") / F.col("n_sims"))


def merge_chunks(chunks: list[DataFrame], key: Sequence[str]) -> DataFrame:
    """Counts of several chunks, for the keys that all of them have."""
    out = None
    for c in chunks:
        out = c if out is None else out.unionByName(c)
    summed = out.groupBy(*key).agg(F.sum("n_detected").alias("n_detected"), F.sum("n_sims").alias("n_sims"), F.count("*").alias("_k"))
    return summed.where(F.col("_k") == len(chunks)).drop("_k").withColumn("efficiency", F.col("n_detected") / F.col("n_sims"))


def crossing(curve: DataFrame, key: Sequence[str], x: str = "hrss", y: str = "efficiency", level: float = 0.5) -> DataFrame:
    """Where each curve first crosses the level, linear in log10(x); its first x if it is above throughout, its last if below."""
    w = Window.partitionBy(*key).orderBy(x)
    nxt = curve.withColumn("_x", F.lead(x).over(w)).withColumn("_y", F.lead(y).over(w))
    brackets = ((F.col(y) <= level) & (F.col("_y") >= level)) | ((F.col(y) >= level) & (F.col("_y") <= level))
    flat = F.abs(F.col("_y") - F.col(y)) < 1e-12
    at = F.when(flat, F.col(x).cast("double")).otherwise(F.pow(F.lit(10.0), F.log10(x) + (F.lit(level) - F.col(y)) / F.when(~flat, F.col("_y") - F.col(y)) * (F.log10("_x") - F.log10(x))))
    out = nxt.groupBy(*key).agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"), F.min(x).alias("_first"), F.max(x).alias("_last"), F.min_by(F.when(brackets, at), F.when(brackets, F.col(x))).alias("_at"))
    return out.select(*key, F.when(F.col("_lo") > level, F.col("_first").cast("double")).when(F.col("_hi") < level, F.col("_last").cast("double")).otherwise(F.col("_at")).alias("crossing"))


#: Fixed value: erfc(-t) / 2 is 0.1 or 0.9 at t = -/+ this.
TENTH = 0.9061938


def _erfc_curve(x: np.ndarray, mid: float, width: float) -> np.ndarray:
    return np.array([0.5 * math.erfc(-(np.log10(v) - mid) / max(width, 1e-6)) for v in x])


def fit_sigmoid(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Middle (log10) and width of an erfc curve, by a weighted grid search that is refined around its best point."""
    lx = np.log10(x)
    lo, hi, wide = lx.min() - 1, lx.max() + 1, 2.0
    mid, width = (lo + hi) / 2, 1.0
    span, wspan = (hi - lo) / 2, wide
    for _ in range(12):
        mids = np.linspace(mid - span, mid + span, 17)
        widths = np.clip(np.linspace(width - wspan, width + wspan, 17), 1e-3, None)
        cost = [((n * (_erfc_curve(x, m, w) - y) ** 2).sum(), m, w) for m in mids for w in widths]
        _, mid, width = min(cost)
        span, wspan = span / 3, wspan / 3
    return float(mid), float(width)


def sigmoid(curves: DataFrame, key: str) -> DataFrame:
    """Fitted x at 10, 50 and 90 percent per curve; a curve has boundedly many points (one per strength)."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        mid, width = fit_sigmoid(pdf["hrss"].to_numpy(float), pdf["efficiency"].to_numpy(float), pdf["n_sims"].to_numpy(float))
        at = [10 ** (mid + t * width) for t in (-TENTH, 0.0, TENTH)]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "hrss10": [at[0]], "hrss50": [at[1]], "hrss90": [at[2]]})

    return curves.groupBy(key).applyInPandas(one, f"{key} {dict(curves.dtypes)[key]}, hrss10 double, hrss50 double, hrss90 double")


@F.pandas_udf(T.DoubleType())
def _half_erfc(u: pd.Series) -> pd.Series:
    """erfc(-u) / 2."""
    return u.map(lambda v: 0.5 * math.erfc(-v))


#: Passes of the fit at most, and the step below which a group is done.
PASSES, SETTLED = 60, 1e-10


def sigmoids(trials: DataFrame, key: Sequence[str], x: str, detected: Column) -> DataFrame:
    """Per group the erfc curve of log10(x) that makes its detections likeliest: key columns, n, middle, width, hrss10, hrss50, hrss90, settled.

    All groups are fitted at once: a pass gives each group's sums of the score and
    of the information at its curve, over its distinct strengths, and a step for
    each; groups that moved no more stay as they are.  Defined cases: strengths that
    are null or not positive don't count, a null detection is a miss; a group that
    one strength separates, or without both hits and misses, or with one strength
    alone, has no likeliest curve: its values are null and it isn't settled.
    """
    checkpoints(trials.sparkSession)
    points = trials.where(F.col(x) > 0).groupBy(*key, F.log10(F.col(x).cast("double")).alias("_l")).agg(F.count("*").alias("_n"), F.sum(F.coalesce(detected, F.lit(False)).cast("long")).alias("_k")).checkpoint()
    hit, missed = F.col("_k") > 0, F.col("_k") < F.col("_n")
    start = points.groupBy(*key).agg(F.sum("_n").alias("n"), F.avg("_l").alias("_m"), F.stddev_pop("_l").alias("_s"), F.max(F.when(missed, F.col("_l"))).alias("_miss"), F.min(F.when(hit, F.col("_l"))).alias("_hit"), F.min(F.when(missed, F.col("_l"))).alias("_miss0"), F.max(F.when(hit, F.col("_l"))).alias("_hit1"))
    # hits and misses must overlap, else a step as steep as one likes is ever likelier
    fits = (F.col("_miss") > F.col("_hit")) & (F.col("_hit1") > F.col("_miss0"))
    state = start.select(*key, "n", F.coalesce(fits, F.lit(False)).alias("_open"), (-F.col("_m") / F.when(F.col("_s") > 0, F.col("_s"))).alias("_a"), (1 / F.when(F.col("_s") > 0, F.col("_s"))).alias("_b"), F.lit(False).alias("settled")).checkpoint()
    names = [f"_k{i}" for i in range(len(key))]
    for _ in range(PASSES):
        moving = state.where("_open AND NOT settled")
        if moving.isEmpty():
            break
        at = moving.select(*[F.col(c).alias(n) for c, n in zip(key, names, strict=True)], "_a", "_b")
        rows = points.join(at, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(key, names, strict=True)]).withColumn("_u", F.col("_a") + F.col("_b") * F.col("_l")).withColumn("_p", _half_erfc("_u"))
        p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("_p")))
        slope = F.exp(-F.col("_u") * F.col("_u")) / math.sqrt(math.pi)
        score, weight = (F.col("_k") - F.col("_n") * p) * slope / (p * (1 - p)), F.col("_n") * slope * slope / (p * (1 - p))
        sums = rows.groupBy(*names).agg(F.sum(score).alias("_g"), F.sum(score * F.col("_l")).alias("_h"), F.sum(weight).alias("_w"), F.sum(weight * F.col("_l")).alias("_x"), F.sum(weight * F.col("_l") * F.col("_l")).alias("_y"))
        det = F.col("_w") * F.col("_y") - F.col("_x") * F.col("_x")
        step_a, step_b = (F.when(det > 0, e / det) for e in (F.col("_y") * F.col("_g") - F.col("_x") * F.col("_h"), F.col("_w") * F.col("_h") - F.col("_x") * F.col("_g")))
        steps = sums.select(*names, step_a.alias("_da"), step_b.alias("_db"))
        both = state.join(steps, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(key, names, strict=True)], "left")
        least = 1 / F.greatest(F.lit(1.0), F.abs("_da"), F.abs("_db"))  # a step is no longer than 1
        moved = F.col("_da").isNotNull()
        state = both.select(*key, "n", "_open", *[F.when(moved, F.col(v) + F.col(d) * least).otherwise(F.col(v)).alias(v) for v, d in (("_a", "_da"), ("_b", "_db"))], F.when(moved, F.greatest(F.abs("_da"), F.abs("_db")) < SETTLED).otherwise(F.col("settled")).alias("settled")).checkpoint()
    good = F.col("_open") & F.col("settled")
    at = lambda t: F.when(good, F.pow(F.lit(10.0), (F.lit(t) - F.col("_a")) / F.col("_b")))
    return state.select(*key, "n", F.when(good, -F.col("_a") / F.col("_b")).alias("middle"), F.when(good, 1 / F.col("_b")).alias("width"), at(-TENTH).alias("hrss10"), at(0.0).alias("hrss50"), at(TENTH).alias("hrss90"), good.alias("settled"))


def clean(matched: DataFrame, vetoes: Sequence[str]) -> DataFrame:
    """Recovered simulations without a veto; an unknown veto counts as none."""
    keep = F.col("sim_idx").isNotNull() & F.col("id").isNotNull()
    for v in vetoes:
        keep = keep & ~F.coalesce(F.col(v), F.lit(False))
    return matched.where(keep)
