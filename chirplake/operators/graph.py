"""Connected components and numbering over whole tables, without a single-task step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoints

BUCKETS = 256


#: A node with more than one in so many of all edge ends is a hub; there are fewer hubs than that.
HUBS = 4096


def _with_least(rows: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """Rows (u, v) with ``m``, the least neighbour of their u.  A hub's rows stay where they are and get its m by a broadcast of the hubs, so no task holds all of them."""
    hub = F.col("n") > ends / HUBS
    hubs = F.broadcast(least.where(hub).select("u", "m"))  # fewer than HUBS rows
    return rows.join(hubs, "u").unionByName(rows.join(hubs, "u", "left_anti").join(least.where(~hub).select("u", "m"), "u"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): the smallest node of its component.

    Two steps in turn, until no edge changes: each node links its larger
    neighbours to its smallest, and then its smaller neighbours and itself.  The
    edges end as stars, after about log n rounds for a chain of n nodes; each
    round is cut by a checkpoint in the shared folder.
    """
    checkpoints(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    sign = lambda: tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen, before = sign(), None
    while seen != before:  # each round makes some label smaller or is the last
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _with_least(both.where("v > u"), least, 2 * seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().checkpoint()
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, down, 2 * seen[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.union(down.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        seen, before = sign(), seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _place(value: Column, edges: list[float], step: int = 16) -> Column:
    """How many of the edges, which ascend, are no larger than a value: first of each ``step``-th, then within that part."""
    if not edges:
        return F.lit(0)
    parts = [edges[i : i + step] for i in range(0, len(edges), step)]
    part = F.size(F.filter(F.array(*[F.lit(p[0]) for p in parts]), lambda x: x <= value)) - 1
    inside = F.size(F.filter(F.get(F.array(*[F.array(*map(F.lit, p)) for p in parts]), part), lambda x: x <= value))
    return F.when(part < 0, F.lit(0)).otherwise(part * step + inside)


def running(df: DataFrame, by: str, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before each one, in an order that begins with the number ``by``.

    Rows are summed in BUCKETS ranges of ``by``, cut at its quantiles; the running sum goes over those, and then inside one.
    """
    edges = df.approxQuantile(by, [i / BUCKETS for i in range(1, BUCKETS)], 0.2 / BUCKETS)  # BUCKETS values: equal parts of the rows, however the values lie
    # the first edge above a value: nulls, which come first in the order, in a bucket of their own
    dealt = df.withColumn("__b", F.when(F.col(by).isNull(), F.lit(-1)).otherwise(_place(F.col(by), sorted(set(edges)))).cast("long")).withColumn("__v", value)
    per = dealt.groupBy("__b").agg(F.sum("__v").alias("__s"))
    before = per.select("__b", F.coalesce(F.sum("__s").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum("__v").over(Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a broadcast of BUCKETS rows at most
    return dealt.withColumn("__in", inside).join(F.broadcast(before), "__b").withColumn(name, F.col("__before") + F.col("__in")).drop("__b", "__v", "__in", "__before")


def numbered(df: DataFrame, by: str, order: list[Column | str], name: str = "number") -> DataFrame:
    """Adds each row's place, from 0, in an order that begins with the number ``by``."""
    return running(df, by, order, F.lit(1), name).withColumn(name, F.col(name).cast("long"))
