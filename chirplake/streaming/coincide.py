"""Triggers of two detectors at nearly one time, on tables and on streams.

Both sides meet in cells of time twice as long as the tolerance.  The right side
is seen by each cell that its tolerance touches, the left one stays in its own,
so a left trigger is one row, with each of its partners once, or with none.  On
streams both sides have watermarks, and the tolerance bounds what is held of
each; a left trigger is given out without a partner when the right watermark
says that none can come, so a silent detector holds nothing back for ever as
long as its clock goes on.

Defined cases: a null time has no partner, and is given out alone on the left
side of a table; equal rows are triggers of their own; ``key`` columns must be
equal; empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coincident(left: DataFrame, right: DataFrame, time: str, milliseconds: int, how: str = "inner", key: Sequence[str] = (), late: int = 60) -> DataFrame:
    """Left triggers with right ones at most so far apart: the left columns, and the right ones as ``other_*``.  ``how`` is inner or left; ``time`` is a TIMESTAMP on both sides."""
    if how not in ("inner", "left"):
        raise ValueError(f"unknown kind of join: {how}")
    if left.isStreaming != right.isStreaming:
        raise ValueError("both sides must be streams, or both tables")
    if left.isStreaming:
        left, right = left.withWatermark(time, f"{late} seconds"), right.withWatermark(time, f"{late} seconds")
    width = 2000 * max(milliseconds, 1)
    cell = lambda add: F.floor((F.unix_micros(time) + add) / width).cast("long")
    at = f"other_{time}"
    a = left.withColumn("_cell", cell(0))
    b = right.withColumn("_seen", F.explode(F.array_distinct(F.array(cell(-1000 * milliseconds), cell(1000 * milliseconds))))).withColumnsRenamed({c: f"other_{c}" for c in right.columns})
    reach = F.expr(f"INTERVAL {milliseconds / 1000:.3f} SECONDS")
    near = [a["_cell"] == b["_seen"], a[time] >= b[at] - reach, a[time] <= b[at] + reach, *(a[k] == b[f"other_{k}"] for k in key)]
    return a.join(b, reduce(lambda x, y: x & y, near), how).drop("_cell", "_seen")
