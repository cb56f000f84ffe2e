"""Outliers by isolation trees, and rows of a series replaced by their nearest inlier.

Trees are grown on a bounded sample, as the method asks: ``POOL`` rows with the
smallest hash of their key, and of these ``size`` for each tree.  All trees grow
at once, level by level: each node's bounds choose its feature and its cut by a
seeded hash of tree and node, so a forest is the same on any machines.  Rows are
dealt by tree once; no level shuffles again.  The forest (at most ``trees`` times
``2 * size`` nodes) goes to the tasks, which walk all trees for a batch of rows.

Depths are whole millionths, so sums don't depend on their order.  Rows with a
null or NaN feature are in no sample, have no depth and are no outliers; equal
rows have equal depths.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoints, spread
from . import ranks

TREES, SIZE = 100, 256
#: Rows that samples are drawn from.
POOL = 8192
#: Depths are counted in parts of one.
UNIT = 1_000_000
#: Places of a series that are looked at together.
CELL = 4096


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("_", *parts)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def left_over(n: int) -> float:
    """The mean depth of a search that ends without a find in a tree of ``n`` rows."""
    return 0.0 if n < 2 else 2 * sum(1 / i for i in range(1, n)) - 2 * (n - 1) / n


def height(size: int) -> int:
    return max(1, math.ceil(math.log2(size)))


def _whole(df: DataFrame, columns: Sequence[str]) -> Column:
    some = F.lit(True)
    for c in columns:
        some &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return some


def samples(df: DataFrame, key: str, columns: Sequence[str], trees: int = TREES, size: int = SIZE, seed: int = 0) -> DataFrame:
    """(tree, x): the features of each tree's rows."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.where(_whole(df, columns)).select(F.col(key).cast("string").alias("id"), x.alias("x"), uniform(F.lit(str(seed)), F.col(key).cast("string")).alias("u"))
    n = df.count()
    # twice as many as are wanted pass, so the sort and its one task see a bounded number
    pool = rows.where(F.col("u") < 2 * POOL / n) if n > 2 * POOL else rows
    pool = pool.orderBy("u", "id", "x").limit(POOL)
    each = pool.select("id", "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    w = Window.partitionBy("tree").orderBy(uniform(F.lit(str(seed)), F.col("tree").cast("string"), "id"), "id", "x")
    return each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= size).select("tree", "x")


def grown(sample: DataFrame, features: int, size: int = SIZE, seed: int = 0) -> DataFrame:
    """(tree, node, n, feature, cut): node 1 is the root, 2i and 2i + 1 are the sides of node i; leaves have neither feature nor cut."""
    rows = sample.withColumns({"node": F.lit(1).cast("long"), "path": F.array().cast("array<struct<node:bigint,n:bigint,feature:int,cut:double>>")})
    w = Window.partitionBy("tree", "node")
    top = height(size)
    for _ in range(top + 1):
        at = [F.get("x", F.lit(i)) for i in range(features)]
        rows = rows.withColumns({"n": F.count("*").over(w)} | {f"lo{i}": F.min(at[i]).over(w) for i in range(features)} | {f"hi{i}": F.max(at[i]).over(w) for i in range(features)})
        rows = rows.withColumn("open", F.array_compact(F.array(*[F.when(F.col(f"hi{i}") > F.col(f"lo{i}"), F.lit(i)) for i in range(features)])))
        place = [F.lit(str(seed)), F.col("tree").cast("string"), F.col("node").cast("string")]
        chosen = F.get("open", F.floor(uniform(*place, F.lit("feature")) * F.size("open")).cast("int"))
        rows = rows.withColumn("feature", F.when((F.col("node") < 1 << top) & (F.size("open") > 0), chosen))
        lo, hi = (F.get(F.array(*[F.col(f"{b}{i}") for i in range(features)]), F.col("feature")) for b in ("lo", "hi"))
        rows = rows.withColumn("cut", lo + (hi - lo) * uniform(*place, F.lit("cut")))
        rows = rows.withColumn("path", F.concat("path", F.array(F.struct("node", "n", "feature", "cut"))))
        right = (F.get("x", F.col("feature")) > F.col("cut")).cast("long")
        rows = rows.withColumn("node", F.coalesce(2 * F.col("node") + right, "node")).select("tree", "x", "node", "path")
    return rows.select("tree", F.inline("path")).distinct()


def depths(df: DataFrame, forest: DataFrame, columns: Sequence[str], trees: int = TREES, size: int = SIZE) -> DataFrame:
    """The rows with ``depth``: the sum over all trees, in parts of ``UNIT``; and ``score``, near 1 for rows that few cuts set apart."""
    nodes = forest.collect()  # at most 2 * size a tree
    many = 2 << height(size)
    feature = np.full((trees, many), -1, np.int64)
    cut = np.zeros((trees, many))
    value = np.tile(np.array([UNIT * max(0, i.bit_length() - 1) for i in range(many)], np.int64), (trees, 1))
    for r in nodes:
        if r["feature"] is None:
            value[r["tree"], r["node"]] += round(UNIT * left_over(r["n"]))
        else:
            feature[r["tree"], r["node"]], cut[r["tree"], r["node"]] = r["feature"], r["cut"]
    used = max((r["n"] for r in nodes if r["node"] == 1), default=0)

    @F.pandas_udf("long")
    def walked(x: pd.Series) -> pd.Series:
        if x.empty:
            return pd.Series([], dtype="int64")
        points = np.stack(x.to_numpy())
        out = np.zeros(len(points), np.int64)
        some = np.arange(len(points))
        for tree in range(trees):
            node = np.ones(len(points), np.int64)
            for _ in range(height(size)):
                f = feature[tree, node]
                node = np.where(f < 0, node, 2 * node + (points[some, f] > cut[tree, node]))
            out += value[tree, node]
        return pd.Series(out)

    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    out = df.withColumn("depth", F.when(_whole(df, columns), walked(x)))
    scale = UNIT * trees * left_over(used)
    return out.withColumn("score", F.when(F.col("depth").isNotNull(), F.pow(F.lit(2.0), -F.col("depth") / scale) if scale else F.lit(0.5)))


def outliers(df: DataFrame, key: str, columns: Sequence[str], share: float = 0.15, trees: int = TREES, size: int = SIZE, seed: int = 0) -> DataFrame:
    """The rows with ``depth``, ``score`` and ``outlier``: of the ``share`` that is set apart first, those with a feature above its median."""
    forest = grown(samples(df, key, columns, trees, size, seed), len(columns), size, seed)
    checkpoints(df.sparkSession)
    scored = depths(spread(df, key), forest, columns, trees, size).withColumn("_apart", -F.col("depth")).checkpoint()
    whole = scored.where("depth IS NOT NULL")
    n = whole.count()
    if not n:
        return scored.drop("_apart").withColumn("outlier", F.lit(False))

    def kth(column: str, *k: int) -> list[float]:
        asked = df.sparkSession.createDataFrame([(i,) for i in k], "k long")
        return [r["found"] for r in ranks.largest(whole, [], column, asked).collect()]

    edge = kth("_apart", math.ceil((n - 1) * share) + 1)[0]
    above = F.lit(False)
    for c in columns:
        middle = kth(c, (n + 1) // 2, n // 2 + 1)
        above |= F.col(c) > sum(middle) / 2
    return scored.withColumn("outlier", F.coalesce((F.col("_apart") > edge) & above, F.lit(False))).drop("_apart")


def nearest_inliers(df: DataFrame, series: Sequence[str], place: str, outlier: str = "outlier") -> DataFrame:
    """The rows with ``taken``: the place of the nearest row of their series that is no outlier, the earlier of two as near; an inlier takes itself, and where there is none, so does an outlier.

    A series goes in cells of ``CELL`` places; between cells only their first and last inliers count.
    """
    rows = df.withColumn("_cell", F.floor(F.col(place) / CELL)).withColumn("_in", F.when(~F.col(outlier), F.col(place)))
    by = [*series, "_cell"]
    cells = rows.groupBy(*by).agg(F.min("_in").alias("_first"), F.max("_in").alias("_last"))
    first, last = (Window.partitionBy(*series).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_cell").asc(), F.col("_cell").desc()))
    ends = cells.select(*by, F.max("_last").over(first).alias("_before"), F.min("_first").over(last).alias("_after"))
    beside = ends.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], "_before", "_after")
    # from both ends: a frame up to the last row would be summed anew for each row
    up, down = (Window.partitionBy(*by).orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.col(place).asc(), F.col(place).desc()))
    near = rows.withColumns({"_l": F.max("_in").over(up), "_r": F.min("_in").over(down)})
    met = near.join(beside, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], "left")
    left, right, at = F.coalesce("_l", "_before"), F.coalesce("_r", "_after"), F.col(place)
    taken = F.when(left.isNull() | (right - at < at - left), right).otherwise(left)
    return met.select(*df.columns, F.coalesce(taken, at).alias("taken"))
