"""Links between pixels of different clusters, clusters merged by them, and the stages made of both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .kernels import cluster_statistics


def _pairs(pixels: DataFrame, group: Sequence[str], reach: float, columns: Sequence[str]) -> DataFrame:
    """Pairs of pixels of one group and different clusters, at most ``reach`` seconds apart, each once: a join on cells of that length."""
    cell = F.floor(F.col("time") / reach).cast("long")
    a = pixels.select(*group, *[F.col(c).alias(f"{c}_a") for c in columns], F.explode(F.array(cell, cell + 1)).alias("_cell"), cell.alias("_own"))
    b = pixels.select(*group, *[F.col(c).alias(f"{c}_b") for c in columns], cell.alias("_cell"))
    same = (F.col("_own") == F.col("_cell")) & ((F.col("time_b") > F.col("time_a")) | ((F.col("time_b") == F.col("time_a")) & (F.col("cluster_id_b") > F.col("cluster_id_a"))))
    near = (F.col("cluster_id_a") != F.col("cluster_id_b")) & (same | (F.col("_own") < F.col("_cell"))) & (F.col("time_b") - F.col("time_a") <= reach)
    return a.join(b, [*group, "_cell"]).where(near)


def _links(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    return pairs.select(*group, F.least("cluster_id_a", "cluster_id_b").alias("a"), F.greatest("cluster_id_a", "cluster_id_b").alias("b")).distinct()


def close_links(pixels: DataFrame, group: Sequence[str], gap: float) -> DataFrame:
    """Pairs of clusters (a < b) with pixels of rates within a factor of 3 whose distance in time and frequency, in units of their own sizes, is ``gap`` at most.

    Pixels have cluster_id, time (s), freq (Hz), rate and an array ``index`` of their times in each detector.
    """
    longest = pixels.agg(F.max(1 / F.col("rate")).alias("t")).first()["t"]  # one row
    if longest is None:
        return _links(_pairs(pixels, group, 1.0, ["cluster_id", "time"]), group)
    near = _pairs(pixels, group, longest * (1 + gap), ["cluster_id", "time", "freq", "rate", "index"])
    p, q = F.col("rate_a"), F.col("rate_b")
    both, width = p + q, 1 / p + 1 / q
    d_t = F.array_max(F.zip_with("index_a", "index_b", lambda x, y: F.abs(x - y))) - width / 2
    d_f = F.abs(F.col("freq_a") - F.col("freq_b")) - both / 2
    zero = F.lit(0.0)
    eps = F.greatest(d_t, zero) * both + F.greatest(d_f, zero) * width
    return _links(near.where((F.greatest(p, q) <= 3 * F.least(p, q)) & (eps <= gap)), group)


def fragment_links(pixels: DataFrame, group: Sequence[str], t_gap: float, f_gap: float) -> DataFrame:
    """Pairs of clusters with pixels closer than ``t_gap`` in every detector's time and than ``f_gap`` in frequency, both less the pixels' own sizes."""
    longest = pixels.agg(F.max(1 / F.col("rate")).alias("t")).first()["t"] or 0.0  # one row
    near = _pairs(pixels, group, t_gap + longest, ["cluster_id", "time", "freq", "rate", "index"])
    p, q = F.col("rate_a"), F.col("rate_b")
    d_t = F.array_max(F.zip_with("index_a", "index_b", lambda x, y: F.abs(x - y))) - (1 / p + 1 / q) / 2
    d_f = F.abs(F.col("freq_a") - F.col("freq_b")) - (p + q) / 2
    return _links(near.where((d_t < t_gap) & (d_f < f_gap)), group)


def merged(pixels: DataFrame, links: DataFrame, group: Sequence[str]) -> DataFrame:
    """The pixels with linked clusters as one: the smallest id of those reached; a cluster without a link keeps its own."""
    name = lambda c: F.struct(*group, F.col(c).alias("cluster_id"))
    labels = graph.components(links.select(name("a").alias("a"), name("b").alias("b")))
    known = labels.select(*[F.col(f"node.{g}").alias(g) for g in group], F.col("node.cluster_id").alias("cluster_id"), F.col("label.cluster_id").alias("_label"))
    out = pixels.join(known, [*group, "cluster_id"], "left")
    return out.withColumn("cluster_id", F.coalesce("_label", "cluster_id")).drop("_label").select(*pixels.columns)


def superclusters(pixels: DataFrame, group: Sequence[str], gap: float, least_pixels: int, keep: Column | None = None) -> DataFrame:
    """Clusters joined by close links, and their statistics; small ones, and those a condition on the statistics refuses, go."""
    stats = cluster_statistics(merged(pixels, close_links(pixels, group, gap), group), list(group)).where(F.col("size") >= least_pixels)
    return stats if keep is None else stats.where(keep)


def defragmented(pixels: DataFrame, group: Sequence[str], t_gap: float, f_gap: float) -> DataFrame:
    return merged(pixels, fragment_links(pixels, group, t_gap, f_gap), group)


def loudest_pixels(pixels: DataFrame, group: Sequence[str], n: int, value: str = "likelihood", tie: str = "pixel") -> DataFrame:
    """The n loudest pixels of each cluster, of equal ones the first, those without a value last: n of each of 64 parts of a cluster, then n of those.

    Spark drops what is beyond a part's n before it moves rows, so no cluster's pixels are gathered.
    """
    order = [F.col(value).desc_nulls_last(), F.col(tie)]
    rest = [c for c in pixels.columns if c not in (*group, "cluster_id")]
    place = lambda *by: F.row_number().over(Window.partitionBy(*group, "cluster_id", *by).orderBy(*order))
    some = pixels.withColumn("_part", F.pmod(F.xxhash64(tie), F.lit(64))).withColumn("_place", place("_part")).where(F.col("_place") <= n)
    top = some.withColumn("_place", place()).where(F.col("_place") <= n)
    return top.select(*group, "cluster_id", (F.col("_place") - 1).alias("place"), *rest)


def cross_talk(pixels: DataFrame, table: DataFrame, on: Sequence[str] = ("layer", "index")) -> DataFrame:
    """Coefficients of a catalogue of pixel pairs (layer_a, index_a, layer_b, index_b, coefficient) for the pairs within one cluster."""
    a = pixels.select("cluster_id", *[F.col(c).alias(f"{c}_a") for c in on], F.col("amplitude").alias("amplitude_a"))
    b = pixels.select("cluster_id", *[F.col(c).alias(f"{c}_b") for c in on], F.col("amplitude").alias("amplitude_b"))
    return a.join(table, [f"{c}_a" for c in on]).join(b, ["cluster_id", *[f"{c}_b" for c in on]])
