"""How well each direction of the sky explains the amplitudes of a network of detectors.

A source in a direction s reaches detector i by d_i(s) samples late and with the
patterns p_i(s), c_i(s).  Of the amplitudes a_i(layer, index + d_i(s)) at one
layer and index, the part that two polarisations can explain is a quadratic form
in them, with weights w_ij(s) that the patterns alone give.  Summed over all
layers and indices, the statistic of a direction is

    sum over i, j of w_ij(s) * C_ij(d_j(s) - d_i(s)),

where C_ij(lag) is the sum of a_i(layer, index) * a_j(layer, index + lag).  So
pixels never meet directions: pairs of pixels at most ``most`` samples apart meet
by an equal layer and block of indices and become partial sums per pair of
detectors and lag; those, a few per event, meet the directions by (i, j, lag).

Defined cases: pixels of one event, detector, layer and index are added up; null
amplitudes count as 0; a direction whose patterns all vanish has the statistic 0;
of equally good directions the last one is best; lags above ``most`` do not
occur, so a table of directions with larger ones is an error; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def correlations(pixels: DataFrame, event: Sequence[str], most: int) -> DataFrame:
    """(event columns, i, j, lag, product): sums over pixels (event columns, detector, layer, index, amplitude), lags from -most to most."""
    one = pixels.groupBy(*event, "detector", "layer", "index").agg(F.sum(F.coalesce("amplitude", F.lit(0.0))).alias("amplitude"))
    width = 2 * most + 1
    block = F.floor(F.col("index") / width).cast("long")
    # a window of width indices lies in two blocks at most
    first, last = (F.floor((F.col("index") + d) / width).cast("long") for d in (-most, most))
    a = one.select(*event, "layer", F.col("detector").alias("i"), F.col("index").alias("_at"), F.col("amplitude").alias("_a"), F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))).alias("_block"))
    b = one.select(*event, "layer", F.col("detector").alias("j"), F.col("index").alias("_bt"), F.col("amplitude").alias("_b"), block.alias("_block"))
    lag = F.col("_bt") - F.col("_at")
    met = a.join(b, [*event, "layer", "_block"]).where(F.abs(lag) <= most)
    return met.groupBy(*event, "i", "j", lag.cast("int").alias("lag")).agg(F.sum(F.col("_a") * F.col("_b")).alias("product"))


def directions(table: DataFrame) -> DataFrame:
    """(sky, i, j, lag, weight) of a table (sky, detector, delay, plus, cross): the weights of the projection onto what both polarisations can make."""
    by = Window.partitionBy("sky")
    pp, cc, pc = (F.sum(F.col(x) * F.col(y)).over(by) for x, y in (("plus", "plus"), ("cross", "cross"), ("plus", "cross")))
    rows = table.select("sky", "detector", "delay", "plus", "cross", pp.alias("_pp"), cc.alias("_cc"), pc.alias("_pc"))
    a = rows.withColumnRenamed("detector", "i").withColumnRenamed("delay", "_di")
    b = table.select(F.col("sky").alias("_s"), F.col("detector").alias("j"), F.col("delay").alias("_dj"), F.col("plus").alias("_p"), F.col("cross").alias("_c"))
    both = a.join(b, F.col("sky") == F.col("_s"))
    det = F.col("_pp") * F.col("_cc") - F.col("_pc") * F.col("_pc")
    two = (F.col("_cc") * F.col("plus") * F.col("_p") - F.col("_pc") * (F.col("plus") * F.col("_c") + F.col("cross") * F.col("_p")) + F.col("_pp") * F.col("cross") * F.col("_c")) / det
    one = (F.col("plus") * F.col("_p") + F.col("cross") * F.col("_c")) / (F.col("_pp") + F.col("_cc"))  # the patterns are parallel: one polarisation
    weight = F.when(F.col("_pp") + F.col("_cc") <= 0, F.lit(0.0)).when(det > 1e-12 * (F.col("_pp") + F.col("_cc")) * (F.col("_pp") + F.col("_cc")), two).otherwise(one)
    return both.select("sky", "i", "j", (F.col("_dj") - F.col("_di")).cast("int").alias("lag"), weight.alias("weight"))


def scan(pixels: DataFrame, table: DataFrame, event: Sequence[str], most: int) -> DataFrame:
    """(event columns, sky, statistic) for all directions."""
    weights = directions(table)
    if not weights.where(F.abs("lag") > most).isEmpty():
        raise ValueError(f"delays differ by more than {most} samples")
    met = correlations(pixels, event, most).join(weights, ["i", "j", "lag"])
    return met.groupBy(*event, "sky").agg(F.sum(F.col("product") * F.col("weight")).alias("statistic"))


def best_direction(pixels: DataFrame, table: DataFrame, event: Sequence[str], most: int, digits: int = 9) -> DataFrame:
    """Each event's best direction and its statistic (rounded, so that sums in any order tie alike), and ``energy``, the sum of its squared amplitudes."""
    stat = scan(pixels, table, event, most).withColumn("statistic", F.round("statistic", digits))
    best = stat.groupBy(*event).agg(F.max(F.struct("statistic", "sky")).alias("b")).select(*event, F.col("b.sky").alias("sky"), F.col("b.statistic").alias("statistic"))
    energy = correlations(pixels, event, 0).where("i = j").groupBy(*event).agg(F.sum("product").alias("energy"))
    return best.join(energy, list(event))
