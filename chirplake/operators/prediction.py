"""Linear prediction of long series that lie in blocks: each sample from those before it, by least squares over the whole series.

The normal equations need the sums of x[t - i] * x[t - j] alone.  A block adds its
own, with the last samples of the block before it beside it, so borders count like
any other place; the sums of a group are partial sums over its blocks, and what is
solved per group is a matrix of the order's size.  No series is in one task.

Defined cases: a group with fewer samples than twice the order, or whose equations
have no single solution, has the shortest of the best solutions (zeros where
nothing is known); a gap in the blocks' numbers ends one stretch and begins
another, and a stretch's first ``order`` samples are predicted by none; null
samples count as 0; of blocks with one number in a group the largest stays; a
block shorter than the order, but the last of a stretch, is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_halo(series: DataFrame, group: Sequence[str], order: int) -> DataFrame:
    """Blocks (group columns, block, samples) with ``before``, the last samples of the block before, by an equal block number: null without one."""
    x = F.transform("samples", lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    rows = series.where("block IS NOT NULL AND samples IS NOT NULL AND size(samples) > 0").select(*group, F.col("block").cast("long").alias("block"), x.alias("samples"))
    tail = F.when(F.size("samples") >= order, F.slice("samples", -order, order)).otherwise(F.array(F.lit(float("nan"))))
    own = rows.select(*group, "block", "samples", F.lit(None).cast("array<double>").alias("before"))
    seen = rows.select(*group, (F.col("block") + 1).alias("block"), F.lit(None).cast("array<double>").alias("samples"), tail.alias("before"))
    return own.unionByName(seen).groupBy(*group, "block").agg(F.max("samples").alias("samples"), F.max("before").alias("before")).where("samples IS NOT NULL")


def _joined(before, samples, order: int) -> np.ndarray:
    x = np.asarray(samples, float)
    if before is None:
        return x
    if len(before) != order:
        raise ValueError("a block is shorter than the order")
    return np.concatenate([np.asarray(before, float), x])


def coefficients(series: DataFrame, group: Sequence[str], order: int) -> DataFrame:
    """(group columns, n, coefficients): x[t] is best predicted by the sum of coefficients[i] * x[t - 1 - i]; ``n`` counts the samples that were predicted."""
    if order < 1:
        raise ValueError("the order must be 1 or more")
    width = order + 1

    @F.pandas_udf("array<double>")
    def products(before: pd.Series, samples: pd.Series) -> pd.Series:
        out = []
        for b, s in zip(before, samples, strict=True):
            x = _joined(b, s, order)
            n = max(len(x) - order, 0)
            moved = np.stack([x[order - i : order - i + n] for i in range(width)]) if n else np.zeros((width, 0))
            out.append([float(n), *(moved @ moved.T).ravel().tolist()])
        return pd.Series(out)

    @F.pandas_udf("array<double>")
    def solved(sums: pd.Series) -> pd.Series:
        out = []
        for one in sums:
            r = np.asarray(one, float)[1:].reshape(width, width)
            out.append(np.linalg.lstsq(r[1:, 1:], r[1:, 0], rcond=1e-12)[0].tolist())
        return pd.Series(out)

    each = _with_halo(series, group, order).select(*group, F.posexplode(products("before", "samples")).alias("place", "value"))
    sums = each.groupBy(*group, "place").agg(F.sum("value").alias("value"))
    whole = sums.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda s: s["value"]).alias("_s"))  # width * width + 1 numbers a group
    return whole.select(*group, F.get("_s", F.lit(0)).cast("long").alias("n"), solved("_s").alias("coefficients"))


def residuals(series: DataFrame, fitted: DataFrame, group: Sequence[str], order: int) -> DataFrame:
    """(group columns, block, residuals): each block's samples less their prediction; a stretch's first samples as they are."""

    @F.pandas_udf("array<double>")
    def left(before: pd.Series, samples: pd.Series, by: pd.Series) -> pd.Series:
        out = []
        for b, s, a in zip(before, samples, by, strict=True):
            x = _joined(b, s, order)
            rest = x.copy()
            for i, c in enumerate(a):
                rest[order:] -= c * x[order - 1 - i : len(x) - 1 - i]
            out.append((rest if b is None else rest[order:]).tolist())
        return pd.Series(out)

    rows = _with_halo(series, group, order)
    right = fitted.select(*[F.col(c).alias(f"_f{c}") for c in group], "coefficients")
    both = rows.join(right, [F.col(c).eqNullSafe(F.col(f"_f{c}")) for c in group])
    return both.select(*group, "block", left("before", "samples", "coefficients").alias("residuals"))
