"""Session merging with late events: every version that a user's sessions went through, batch by batch.

Events come in batches.  After each batch, a user's events so far form sessions:
neighbours in time at most ``GAP`` apart share one.  A session that holds an
event of the batch is a new version, and retracts the standing ones that it
contains.

Each user is replayed: batches ascending, against a sorted list of disjoint
sessions in which the places of a new event are found by bisection; the sessions
within the gap are spliced into one, and what they stood for is logged as
retracted.  No user is replayed in one piece:

* Events of one user, batch and cell of time (``GAP`` long, so all of a cell are
  within the gap of each other) always share a session, and are one row by
  partial sums.  However many events a user has, a cell has one row per batch.
* Where all of a user's events leave a gap, no batch before had a session across
  it.  These stretches are replayed apart; they are numbered by their first cell
  in blocks of ``BLOCK`` cells, each with the last cell of the block before it,
  and a stretch that began in an earlier block takes its number from there, by
  pointers that double until none is open.

A stretch's rows stream through its replay, sorted; it holds one row for each
``GAP`` of a user's unbroken activity and batch.

Defined cases: events without a user, time or batch are left out; equal rows are
events of their own; an empty table gives no rows; times and batches may be
negative; times are whole numbers; ``value`` is summed, null as 0; further
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, bounded_batches

GAP, BLOCK = 240, 64
ROWS_OUT = 1 << 14
VERSIONS = "user long, batch long, start_s long, end_s long, n_events long, n_new long, n_retracted long, h_sum long, retracted_batch long, retracted_start_s long"
_NAMES = [c.split()[0] for c in VERSIONS.split(", ")]


class Replay:
    """The sessions of one stretch of a user's time.  A session is [start, end, events, sum, its standing version or None]; a version is a row of VERSIONS without the user, as a list."""

    def __init__(self, gap: int):
        self.gap, self.starts, self.ends, self.sessions = gap, [], [], []

    def batch(self, number: int, parts: list[tuple[int, int, int, int]]) -> list[list]:
        """Applies a batch's parts (first, last, events, sum), each within the gap of itself; gives out the versions that it retracts."""
        changed: dict[int, list] = {}  # by identity: sessions with a part of this batch, what they retract, their new events
        for first, last, events, total in parts:
            low, high = bisect_left(self.ends, first - self.gap), bisect_right(self.starts, last + self.gap)
            met = self.sessions[low:high]
            gone, new = [], events
            for one in met:
                held = changed.pop(id(one), None)
                if held is None:
                    gone.append(one[4])
                else:
                    gone += held[1]
                    new += held[2]
            one = [min([first, *(m[0] for m in met)]), max([last, *(m[1] for m in met)]), events + sum(m[2] for m in met), total + sum(m[3] for m in met), None]
            self.starts[low:high], self.ends[low:high], self.sessions[low:high] = [one[0]], [one[1]], [one]
            changed[id(one)] = [one, gone, new]
        out = []
        for one, gone, new in changed.values():
            for version in gone:
                version[7], version[8] = number, one[0]
                out.append(version)
            one[4] = [number, one[0], one[1], one[2], new, len(gone), one[3], None, None]
        return out

    def standing(self) -> list[list]:
        return [one[4] for one in self.sessions]


def _replay(gap: int):
    """Rows (user, stretch, batch, first, last, n, h), sorted by the first four, to versions."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        user = stretch = batch = replay = None
        parts: list[tuple] = []

        def give() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)

        def close(whole: bool) -> None:
            nonlocal parts
            if replay is not None:
                out.extend([user, *v] for v in replay.batch(batch, parts))
                if whole:
                    out.extend([user, *v] for v in replay.standing())
            parts = []

        for rows in it:
            for u, s, b, first, last, n, h in zip(*(rows.column(c).to_pylist() for c in ("user", "stretch", "batch", "first", "last", "n", "h")), strict=True):
                if (u, s) != (user, stretch):
                    close(True)
                    user, stretch, batch, replay = u, s, b, Replay(gap)
                elif b != batch:
                    close(False)
                    batch = b
                parts.append((first, last, n, h))
            if len(out) >= ROWS_OUT:
                yield give()
        close(True)
        if out:
            yield give()

    return run


def _stretches(cells: DataFrame, gap: int, scratch: Scratch) -> DataFrame:
    """Rows (user, cell, batch, first, last, ..) with ``stretch``, the first cell of the unbroken stretch of cells that each is in."""
    block = _div(F.col("cell"), BLOCK)
    last_of_block = F.pmod("cell", F.lit(BLOCK)) == BLOCK - 1
    # a block's last cell is also seen by the next block, as what comes before its first
    seen = cells.withColumn("block", F.explode(F.when(last_of_block, F.array(block, block + 1)).otherwise(F.array(block))))
    by = Window.partitionBy("user", "block").orderBy("cell")
    before, own = F.max("last").over(by.rangeBetween(-1, -1)), F.min("first").over(by.rangeBetween(0, 0))
    begins = before.isNull() | (own - before > gap)
    marked = seen.withColumn("_begins", F.when(begins, F.col("cell"))).withColumn("stretch", F.max(F.when(block == F.col("block"), F.col("_begins"))).over(by.rangeBetween(Window.unboundedPreceding, 0)))
    rows = scratch.write(marked.where(block == F.col("block")).drop("_begins"), "cells")

    open_rows = rows.where("stretch IS NULL")
    begun = rows.groupBy("user", "block").agg(F.max("stretch").alias("to"))
    step = 1
    begun = scratch.write(begun, "blocks-0")
    while not begun.where("to IS NULL").isEmpty():  # blocks without a beginning: their stretch is older than they are
        back = begun.select("user", (F.col("block") + step).alias("block"), F.col("to").alias("_to"))
        begun = scratch.write(begun.join(back, ["user", "block"], "left").select("user", "block", F.coalesce("to", "_to").alias("to")), f"blocks-{step}")
        step *= 2
    earlier = begun.select("user", (F.col("block") + 1).alias("block"), F.col("to"))
    found = open_rows.join(earlier, ["user", "block"]).withColumn("stretch", F.col("to")).drop("to")
    return rows.where("stretch IS NOT NULL").unionByName(found).drop("block")


def versions(events: DataFrame, scratch: Scratch, gap: int = GAP, user: str = "user", time: str = "time", batch: str = "batch", value: str = "value") -> DataFrame:
    """All versions of all sessions, see VERSIONS: start_s and end_s are the first and last event's time, n_new the events of the version's batch, n_retracted the standing versions that it replaced, h_sum the sum of ``value``; retracted_batch and retracted_start_s name the version that replaced it, null where it still stands."""
    bounded_batches(events.sparkSession)
    rows = events.select(*[F.col(c).cast("long").alias(n) for c, n in ((user, "user"), (time, "time"), (batch, "batch"), (value, "value"))]).dropna(subset=["user", "time", "batch"])
    cell = _div(F.col("time"), gap)
    cells = rows.groupBy("user", cell.alias("cell"), "batch").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0)).alias("h"))
    dealt = _stretches(cells, gap, scratch).repartition("user", "stretch").sortWithinPartitions("user", "stretch", "batch", "first")
    return dealt.select("user", "stretch", "batch", "first", "last", "n", "h").mapInArrow(_replay(gap), VERSIONS)


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """Turns of conversations as events (user, time, batch, value): checksums of a conversation's and a turn's number spread them over users, time and late batches.  A row without a turn is none."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn")).where("turn IS NOT NULL")
    crc = lambda text: F.crc32(text.cast("binary"))
    c, h = crc(F.col("conv").cast("string")), crc(F.concat_ws(":", F.col("conv").cast("string"), F.col("turn").cast("string")))
    rows = rows.where("conv IS NOT NULL").select("conv", "turn", c.alias("c"), h.alias("h")).withColumn("g", _div(F.col("h"), 600))
    seconds = F.pmod(_div(F.col("c"), 2), F.lit(7200)) + 300 * F.col("turn") + F.col("h") % 600
    late = F.when(F.col("g") % 3 == 0, F.col("g") % 4).otherwise(F.lit(0))
    rows = rows.withColumn("time", seconds)
    return rows.select((2 * _div(F.col("conv"), 8) + F.col("c") % 2).alias("user"), "time", (_div(F.col("time"), 1800) + late).alias("batch"), F.col("h").alias("value"))


def _div(a: Column, b: int) -> Column:
    """Whole part of a quotient, rounded down."""
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("long")
