"""Selections by live time, disjoint splits and seeded samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def hash_order(seed: int, *keys: str) -> Column:
    """A fixed random order: the same rows come first on every run and any number of machines."""
    return F.md5(F.concat_ws("_", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(hash_order(seed, key), key).limit(n)


def select_by_livetime(jobs: DataFrame, target: Column | float, seed: int = 0, key: str = "job_id") -> DataFrame:
    """Jobs in a fixed random order until their live time reaches the target; the one that crosses it is in.

    Jobs are first summed in buckets of the order, so the running sum over all
    runs over the buckets, and the fine one inside one bucket.
    """
    ordered = jobs.withColumn("_h", hash_order(seed, key)).withColumn("_b", F.substring("_h", 1, 2))
    per = ordered.groupBy("_b").agg(F.sum("livetime").alias("_s"))
    before = per.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    inside = F.coalesce(F.sum("livetime").over(Window.partitionBy("_b").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # a broadcast of 256 buckets at most
    out = ordered.withColumn("_in", inside).join(F.broadcast(before.select("_b", "_before")), "_b")
    return out.where(F.col("_before") + F.col("_in") < target).drop("_h", "_b", "_in", "_before")


def split_by_livetime(keys: list[tuple], fractions: Sequence[float], seed: int = 0) -> list[list]:
    """Disjoint parts of (key, livetime) pairs by fractions of their sum: greedy, in a seeded random order, the last item of a part overshooting.

    Sequential by definition; keys are jobs or intervals, summed beforehand, of which there are few.
    """
    order = np.random.default_rng(seed).permutation(len(keys))
    total, at, parts = sum(k[-1] for k in keys), 0, []
    for fraction in fractions:
        part, got = [], 0.0
        while at < len(order) and got < fraction * total:
            part.append(keys[order[at]][0])
            got += keys[order[at]][-1]
            at += 1
        parts.append(part)
    return parts


def split_table(rows: DataFrame, fractions: Mapping[str, float], key: Sequence[str], seed: int = 0) -> DataFrame:
    """Rows (key, livetime) with the ``split`` each belongs to: in a fixed random order, each split takes rows until its share of the live time is reached; those behind the last split go.

    The order's running sum goes over 256 buckets; each split's end is then one value.
    """
    total_share = sum(fractions.values())
    if not 0 < total_share <= 1.000001:
        raise ValueError("the fractions' sum is not in (0, 1]")
    ordered = rows.withColumn("_h", hash_order(seed, *key)).withColumn("_b", F.conv(F.substring("_h", 1, 2), 16, 10).cast("long"))
    summed = graph.running(ordered, "_b", ["_h", *key], F.col("livetime").cast("double"), "_before").withColumn("_to", F.col("_before") + F.col("livetime"))
    total = rows.agg(F.sum("livetime")).first()[0] or 0.0  # one row
    at, tag = 0.0, F.lit(None).cast("string")
    for i, (name, share) in enumerate(fractions.items()):
        if i == len(fractions) - 1 and abs(total_share - 1) < 1e-9:
            end = float("inf")
        else:
            end = summed.where(F.col("_to") >= at + total * share).agg(F.min("_to")).first()[0]  # one value a split
            end = float("inf") if end is None else end
        tag = F.when(tag.isNotNull(), tag).when((F.col("_before") >= at) & (F.col("_before") < end), F.lit(name))
        at = end
    return summed.withColumn("split", tag).where("split is not null").drop("_h", "_b", "_before", "_to")


def write_splits(df: DataFrame, parts: Mapping[str, DataFrame], key: str | Sequence[str], path: str) -> None:
    """One tagged table, partitioned by split; a split without rows gets an empty file with the schema."""
    key = [key] if isinstance(key, str) else list(key)
    tags = None
    for name, keys in parts.items():
        one = keys.select(*key).distinct().withColumn("split", F.lit(name))
        tags = one if tags is None else tags.unionByName(one)
    out = df.join(tags, key)
    out.write.partitionBy("split").parquet(path)
    there = {r["split"] for r in df.sparkSession.read.parquet(path).select("split").distinct().collect()} if not out.isEmpty() else set()  # a row per split
    for name in set(parts) - there:
        out.where(F.lit(False)).drop("split").coalesce(1).write.mode("overwrite").parquet(f"{path}/split={name}")


def train_test(df: DataFrame, key: str, label: str, test: float = 0.1, seed: int = 0) -> DataFrame:
    """Adds ``is_test``: per class a fixed fraction, by a hash of the key."""
    bucket = F.pmod(F.conv(F.substring(hash_order(seed, label, key), 1, 8), 16, 10).cast("long"), F.lit(10_000))
    return df.withColumn("is_test", bucket < int(test * 10_000))
