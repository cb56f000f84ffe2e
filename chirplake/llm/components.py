"""Connected components of an edge table, distributed.

Alternates two steps until no edge changes: every node links its larger
neighbours to its smallest one, then its smaller neighbours and itself.  Both
are a partial minimum per node and a join of it back to the node's edges.  A
node that holds more than one in ``HUBS`` of all edge ends is a hub; there are
fewer than ``HUBS`` of them, so their minima are broadcast and their edges stay
where they are.  No other node's edges are many.  Each round is written to the
shared folder, which cuts the lineage.

Before and after each step the edges that a task holds are joined there, at most
``HELD`` at once, and go on as links to the smallest node of each piece.  This
changes no component, never makes an edge's ends larger, and takes most rounds
away.  Tasks and files of a round are as many as its edges ask for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, lean

HUBS = 4096
#: Edges that a task joins at once, and edges a task of a round.
HELD, EDGES = 1 << 20, 1 << 18


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of n nodes joined by edges (a, b): the smallest number of each component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


@lean
def _joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of a task, some at a time, as links of each node to the smallest that they join it to."""
    held, many = [], 0

    def close() -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        u, v = at.reshape(2, -1)
        least = nodes[forest(len(nodes), u, v)]
        other = least != nodes
        return pa.RecordBatch.from_arrays([pa.array(nodes[other], pa.int64()), pa.array(least[other], pa.int64())], names=["u", "v"])

    for batch in it:
        held.append(np.stack([batch.column("u").to_numpy(), batch.column("v").to_numpy()]))
        many += batch.num_rows
        if many >= HELD:
            yield close()
            held, many = [], 0
    if many:
        yield close()


def _links(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").mapInArrow(_joined, "u long, v long")


def _sign(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _with_least(rows: DataFrame, least: DataFrame, total: int, tasks: int) -> DataFrame:
    """Rows (u, v) with ``m`` of their u; ``least`` has u, m and the number n of the at most ``total`` edge ends that u holds."""
    hub = F.col("n") > total / HUBS
    hubs = F.broadcast(least.where(hub).select("u", "m").coalesce(tasks))  # fewer than HUBS rows
    return rows.join(hubs, "u").unionByName(rows.join(hubs, "u", "left_anti").join(least.where(~hub).select("u", "m"), "u"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label): the smallest node of its component, for every node that has an edge.  ``edges`` has longs a and b."""
    now = _links(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    now = scratch.write(now, f"{name}-0")
    sign, before, i = _sign(now), None, 0
    # no step makes an edge's ends larger, or adds one without a larger one that goes: what a whole round leaves as it is, each step does
    while sign != before:
        i += 1
        tasks = max(scratch.spark.sparkContext.defaultParallelism, -(-sign[0] // EDGES))
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # larger neighbours go to the smallest of the neighbourhood
        large = _with_least(both.where("v > u"), least, 2 * sign[0], tasks).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = scratch.write(_links(large.coalesce(tasks)), f"{name}-large-{i}")
        # smaller neighbours and the node itself go to the smallest one
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, down, 2 * sign[0], tasks).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        now, before = scratch.write(_links(small.coalesce(tasks)), f"{name}-{i}"), sign
        sign = _sign(now)
        scratch.drop(f"{name}-{i - 1}", f"{name}-large-{i}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
