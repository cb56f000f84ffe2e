"""Clusters of pixels on a plane of time and frequency that no task holds whole.

The plane is dealt in tiles.  A tile also sees the pixels of later tiles that its
own can touch, in time, in frequency and at the corner, so every pair of touching
pixels meets in one tile.  Inside a tile, pixels get the label of the first one
they reach; a pixel that several tiles saw says that its labels there are one,
and the components of those few pairs join clusters across borders.

A tile holds at most its area of distinct places, whatever the number of pixels:
pixels of one place are one cluster and take part once.

Defined cases: a pixel without a place keeps a null cluster; equal places share a
cluster; groups are apart, null being one of them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoints
from . import graph

#: Places of a tile in each direction.
TILE = 256


def labels(time: np.ndarray, freq: np.ndarray, kt: int, kf: int) -> np.ndarray:
    """For places sorted by time and frequency, no two equal, the number of the first that each reaches by steps of at most kt and kf."""
    wide = int(freq.max() - freq.min()) + 2 * kf + 1 if len(freq) else 1
    key = (time - (time.min() if len(time) else 0)) * wide + freq - (freq.min() if len(freq) else 0)
    left, right = [], []
    for dt in range(kt + 1):
        for df in range(1 if dt == 0 else -kf, kf + 1):
            at = np.minimum(np.searchsorted(key, key + dt * wide + df), max(len(key) - 1, 0))
            met = np.flatnonzero((time[at] - time == dt) & (freq[at] - freq == df)) if len(key) else at
            left.append(met)
            right.append(at[met])
    a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
    label = np.arange(len(key))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def clusters(pixels: DataFrame, group: Sequence[str], kf: int = 3, kt: int = 2, time: str = "time", freq: str = "freq") -> DataFrame:
    """Pixels with ``cluster_time`` and ``cluster_freq``: the first place, by time and then frequency, of the cluster that each is in; per group."""
    checkpoints(pixels.sparkSession)
    g = [f"_g{i}" for i in range(len(group))]
    places = pixels.where(F.col(time).isNotNull() & F.col(freq).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(group, g, strict=True)], F.col(time).cast("long").alias("t"), F.col(freq).cast("long").alias("f")).distinct()
    own = {c: F.floor(F.col(c) / TILE).cast("long") for c in "tf"}
    seen_by = {c: F.when(F.pmod(c, F.lit(TILE)) < k, F.array(own[c], own[c] - 1)).otherwise(F.array(own[c])) for c, k in (("t", kt), ("f", kf))}
    dealt = places.withColumn("_tt", F.explode(seen_by["t"])).withColumn("_tf", F.explode(seen_by["f"]))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["t", "f"])
        first = labels(rows["t"].to_numpy(), rows["f"].to_numpy(), kt, kf)
        return rows.assign(_lt=rows["t"].to_numpy()[first], _lf=rows["f"].to_numpy()[first])

    kinds = dict(dealt.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in dealt.columns) + ", _lt long, _lf long"
    local = dealt.groupBy(*g, "_tt", "_tf").applyInPandas(run, schema).checkpoint()
    name = lambda t, f: F.struct(*g, F.col(t).alias("t"), F.col(f).alias("f"))
    named = local.withColumn("_place", name("t", "f")).withColumn("_label", name("_lt", "_lf"))
    several = named.groupBy("_place").agg(F.collect_set("_label").alias("l")).where(F.size("l") > 1)  # four at most
    pairs = several.select(F.array_min("l").alias("a"), F.explode("l").alias("b"))
    joined = graph.components(pairs)
    mine = named.where((own["t"] == F.col("_tt")) & (own["f"] == F.col("_tf")))
    whole = mine.join(joined.withColumnRenamed("node", "_label"), "_label", "left").select(F.col("_place").alias("_p"), F.coalesce("label", "_label").alias("_l"))
    place = F.struct(*[F.col(c).alias(n) for c, n in zip(group, g, strict=True)], F.col(time).cast("long").alias("t"), F.col(freq).cast("long").alias("f"))
    out = pixels.withColumn("_p", place).join(whole.withColumnRenamed("_p", "_q"), F.col("_p").eqNullSafe(F.col("_q")), "left")
    return out.withColumn("cluster_time", F.col("_l.t")).withColumn("cluster_freq", F.col("_l.f")).drop("_p", "_q", "_l")
