"""Zero-lag and time-slide predicates as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: shifts up to this count as zero.
TOLERANCE = 1e-12


def is_zero(df: DataFrame, name: str) -> Column:
    """Whether a number, or each of a list, is zero; null counts as zero."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.coalesce(F.forall(col, lambda x: F.coalesce(F.abs(x) <= TOLERANCE, F.lit(True))), F.lit(True))
    return F.coalesce(F.abs(col.cast("double")) <= TOLERANCE, F.lit(True))


def unshifted_jobs(jobs: DataFrame) -> DataFrame:
    """job_id of jobs whose shift is null or zero in every element."""
    return jobs.where(is_zero(jobs, "shift")).select("job_id").distinct()


def zero_lag(df: DataFrame, unshifted: Column | None = None) -> Column:
    """The zero-lag condition.

    ``unshifted`` tells whether the row's job is unshifted; None means that this
    is unknown, and then the row's own shift columns must be zero too.
    """
    names, parts = df.columns, []
    if unshifted is not None:
        parts.append(unshifted)
    lag = next((n for n in ("lag_idx", "lag") if n in names), None)
    if lag:
        parts.append(F.coalesce(F.col(lag).cast("double") == 0, F.lit(True)))
    heads = ["time_lag"] + ([] if unshifted is not None else ["segment_lag", "segment_shift", "shift"])
    parts += [is_zero(df, n) for n in names if n == "time_lag" or any(n.startswith(h + ("_" if h == "time_lag" else "")) for h in heads)]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def nonzero_lag(df: DataFrame, unshifted: Column | None = None) -> Column:
    return ~zero_lag(df, unshifted)
