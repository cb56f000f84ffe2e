"""Analysis windows cut from chunks of samples that arrive in any order, whole or not at all; on tables and on streams.

A detector's chunks (``start`` in seconds, ``samples`` at one rate) are held until
all of a window's samples are there; the window is then given out, once.  A
window across a gap never is.  On a stream, what is held of a detector is its
chunks of the time that may still complete a window: chunks that the watermark
has passed are late and are left out, and a timer drops those that no window
waits for.  On a table the same windows come from a grouping by window.

Defined cases: of chunks with one start the first to come stays (on a table, the
one of the smallest samples); chunks must not overlap otherwise; a chunk without
start or samples is none; detectors are apart; starts are rounded to whole
samples; windows begin at multiples of the stride; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOWS = "detector string, start double, samples array<double>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_samples(duration: float, stride: float, rate: float) -> tuple[int, int]:
    size, step = round(duration * rate), round(stride * rate)
    if size < 1 or step < 1:
        raise ValueError("a window and its stride must hold a sample")
    return size, step


def windows(chunks: DataFrame, duration: float, stride: float, rate: float) -> DataFrame:
    """All whole windows of a table of chunks (detector, start, samples); see WINDOWS."""
    size, step = _in_samples(duration, stride, rate)
    at, n = F.round(F.col("start") * rate).cast("long"), F.size("samples")
    rows = chunks.where("start IS NOT NULL AND samples IS NOT NULL AND size(samples) > 0").select(F.col("detector").cast("string").alias("detector"), at.alias("at"), F.col("samples").cast("array<double>").alias("samples"))
    rows = rows.groupBy("detector", "at").agg(F.min("samples").alias("samples"))
    first, last = F.floor((F.col("at") - size) / step).cast("long") + 1, F.floor((F.col("at") + n - 1) / step).cast("long")
    dealt = rows.withColumn("_w", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))).withColumn("_w", F.col("_w") * step)
    # a window's parts are at most as many as its samples
    part = F.slice("samples", F.greatest(F.col("_w") - F.col("at"), F.lit(0)).cast("int") + 1, F.least(n, (F.col("_w") + size - F.col("at")).cast("int")) - F.greatest(F.col("_w") - F.col("at"), F.lit(0)).cast("int"))
    whole = dealt.select("detector", "_w", "at", part.alias("p")).groupBy("detector", "_w").agg(F.sum(F.size("p")).alias("n"), F.sort_array(F.collect_list(F.struct("at", "p"))).alias("parts")).where(F.col("n") == size)
    return whole.select("detector", (F.col("_w") / F.lit(float(rate))).alias("start"), F.flatten(F.transform("parts", lambda x: x["p"])).alias("samples"))


class Buffer(StatefulProcessor):
    """The chunks held of one detector, as one value: by their first sample, ascending."""

    def __init__(self, size: int, step: int, rate: float):
        self.size, self.step, self.rate = size, step, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at array<bigint>, samples array<array<double>>")

    def _chunks(self) -> dict[int, list[float]]:
        found = self.held.get()
        return {} if found is None else dict(zip(found[0], map(list, found[1]), strict=True))

    def _hold(self, chunks: dict[int, list[float]]) -> None:
        """Keeps chunks, and one timer, for the first of them that no window will wait for."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if not chunks:
            self.held.clear()
            return
        order = sorted(chunks)
        self.held.update((order, [chunks[at] for at in order]))
        self.handle.registerTimer(min(self._ends(at, len(chunks[at])) for at in order))

    def _ends(self, at: int, n: int) -> int:
        """Milliseconds from which no window waits for a chunk."""
        return int((at + n + self.size) * 1000 / self.rate) + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        chunks = self._chunks()
        new = []
        for pdf in rows:
            for start, samples in zip(pdf["start"], pdf["samples"], strict=True):
                if samples is None or not len(samples) or pd.isna(start):
                    continue
                at = round(start * self.rate)
                if at in chunks or (at + len(samples)) * 1000 / self.rate < mark:
                    continue
                chunks[at] = [float(x) for x in samples]
                new.append(at)
        begins = sorted({w for at in new for w in range(-((self.size - 1 - at) // self.step) * self.step, at + len(chunks[at]), self.step)})
        order = sorted(chunks)
        out = []
        for w in begins:
            found: list[float] = []
            for at in order[max(bisect_right(order, w) - 1, 0) :]:
                inside = w + len(found) - at
                if len(found) >= self.size or not 0 <= inside < len(chunks[at]):
                    break
                found += chunks[at][inside:]
            if len(found) >= self.size:
                out.append((key[0], w / self.rate, found[: self.size]))
        self._hold({at: x for at, x in chunks.items() if self._ends(at, len(x)) > mark})
        if out:
            yield pd.DataFrame(out, columns=["detector", "start", "samples"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        self._hold({at: x for at, x in self._chunks().items() if self._ends(at, len(x)) > mark})
        yield from ()

    def close(self) -> None:
        pass


def streamed_windows(chunks: DataFrame, time: str, duration: float, stride: float, rate: float, late: int) -> DataFrame:
    """The same of a stream of chunks, whose ``time`` is the TIMESTAMP of their last sample; chunks up to ``late`` seconds behind the latest count."""
    size, step = _in_samples(duration, stride, rate)
    chunks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = chunks.withWatermark(time, f"{late} seconds").select(F.col("detector").cast("string").alias("detector"), time, F.col("start").cast("double").alias("start"), F.col("samples").cast("array<double>").alias("samples"))
    return rows.groupBy("detector").transformWithStateInPandas(statefulProcessor=Buffer(size, step, rate), outputStructType=WINDOWS, outputMode="Append", timeMode="EventTime")
