"""Features of the ranking model, class balance, and a tree model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import hash_order


def cap(value: Column, most: float) -> Column:
    """At most ``most``; null stays null (least would skip it)."""
    return F.when(value > most, F.lit(most)).otherwise(value)


def derived(df: DataFrame, n_ifo: int) -> DataFrame:
    """Ratios and combinations of a trigger's statistics; s_snr_i and noise_i are the detectors' columns."""
    snr = [F.col(f"s_snr_{i}") for i in range(n_ifo)]
    noise = [F.col(f"noise_{i}") for i in range(n_ifo)]
    out = df.withColumns({
        "ecor_ratio": F.try_divide(F.col("ecor"), F.col("likelihood")),
        "area": F.col("duration") * F.col("bandwidth"),
        "shape": F.try_divide(F.col("bandwidth"), F.col("duration")),
        "m_snr": F.least(*snr) if n_ifo > 1 else snr[0],
        "noise": F.sqrt(F.try_divide(F.lit(1.0), reduce(lambda a, b: a + b, [F.try_divide(F.lit(1.0), x * x) for x in noise]))),
        "q_a": F.sqrt(F.greatest(F.col("qveto"), F.lit(0.0))),
        "q_p": F.try_divide(F.col("qfactor"), 2 * F.sqrt(F.log10(F.least(F.lit(200.0), F.col("ecor"))))),
        "rho0": F.sqrt(F.col("ecor") / (1 + F.col("penalty") * (F.greatest(F.lit(1.0), F.col("penalty")) - 1))),
    })
    return out.withColumn("m_snr_ratio", F.try_divide(F.col("m_snr"), F.col("likelihood")))


def balanced_tail(df: DataFrame, value: str, label: str, least: float, key: str, seed: int = 0) -> DataFrame:
    """Rows at or above ``least``, both classes down-sampled to the smaller count by a threshold on a fixed hash.

    The threshold of the larger class is its n-th smallest hash, found by counting
    hash buckets and then inside one bucket: no class is ever sorted as a whole.
    """
    tail = df.where(F.col(value) >= least).withColumn("_h", hash_order(seed, key))
    bucket = F.substring("_h", 1, 3)
    by: dict = {}
    for r in tail.groupBy(label, bucket.alias("b")).agg(F.count("*").alias("n")).collect():  # 4096 rows per class at most
        by.setdefault(r[label], {})[r["b"]] = r["n"]
    n = min((sum(c.values()) for c in by.values()), default=0)
    parts = []
    for klass, counts in by.items():
        rows, left, last = tail.where(F.col(label) == klass), n, None
        for b in sorted(counts):
            if counts[b] > left:
                last = b
                break
            left -= counts[b]
        if last is None:
            parts.append(rows)
            continue
        parts += [rows.where(bucket < last), rows.where(bucket == last).orderBy("_h", key).limit(left)]
    return reduce(DataFrame.unionByName, parts).drop("_h") if parts else tail.drop("_h")


def bulk_weights(df: DataFrame, value: str, label: str, edges: Sequence[float], a: float, q: float) -> DataFrame:
    """Weights of background rows (label 0) by bin: signal over background count, times a falling factor; edges are inclusive, later bins win."""
    from math import exp, log

    bins = len(edges) - 1
    at = F.coalesce(*[F.when((F.col(value) >= edges[i]) & (F.col(value) <= edges[i + 1]), F.lit(i)) for i in reversed(range(bins))])
    put = df.withColumn("bin", at)
    hist = put.where("bin is not null").groupBy("bin").agg(F.sum((F.col(label) == 1).cast("long")).alias("s"), F.sum((F.col(label) == 0).cast("long")).alias("b"))
    fall = F.element_at(F.array(*[F.lit(exp(log(a) * (1 - i / max(bins - 1, 1)) ** q)) for i in range(bins)]), F.col("bin") + 1)
    ratio = F.when((F.col("b") > 0) & (F.col("s") > 0), F.col("s") / F.col("b")).otherwise(F.lit(1.0))
    weights = hist.withColumn("weight", ratio * fall).select("bin", "weight")
    return put.join(F.broadcast(weights), "bin", "left").withColumn("weight", F.when(F.col(label) == 0, F.coalesce("weight", F.lit(1.0))).otherwise(F.lit(1.0)))


def train_trees(df: DataFrame, columns: Sequence[str], label: str, **options):
    """Gradient-boosted trees on the feature columns; null features become their column's mean."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    filled = [f"{c}_filled" for c in columns]
    steps = [Imputer(inputCols=list(columns), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), GBTClassifier(labelCol=label, seed=0, **({"maxIter": 10, "maxDepth": 4} | options))]
    return Pipeline(stages=steps).fit(df)


def score_trees(model, df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
