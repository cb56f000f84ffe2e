"""Stretches of time without a gap, per key, where a key may hold all rows.

Rows are seen in cells as long as the gap: rows of one cell are always in one
stretch, and of two cells only neighbours can be.  So a stretch begins at each
cell whose rows are a gap or more behind the last one of the cell before.  That
is looked up in blocks of cells, each with the last cell of the block before it;
a block without a beginning gets its stretch from the blocks before, by pointers
that double until all have one.  No key is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoints

BLOCK = 64


def stretched(df: DataFrame, key: Sequence[str], at: str, gap: float, name: str = "stretch") -> DataFrame:
    """Rows with the number of the stretch that each is in: the first cell of it.  Rows less than ``gap`` behind another of their key share its stretch; one without a time has none."""
    checkpoints(df.sparkSession)
    k = [f"_k{i}" for i in range(len(key))]
    rows = df.withColumns({n: F.col(c) for c, n in zip(key, k, strict=True)} | {"_cell": F.floor(F.col(at) / gap).cast("long")})
    cells = rows.where("_cell IS NOT NULL").groupBy(*k, "_cell").agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    block = F.floor(F.col("_cell") / BLOCK).cast("long")
    seen = cells.withColumn("_block", F.explode(F.when(F.pmod("_cell", F.lit(BLOCK)) == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))))
    by = Window.partitionBy(*k, "_block").orderBy("_cell")
    before = F.max("_hi").over(by.rangeBetween(-1, -1))
    begins = F.when(before.isNull() | (F.col("_lo") - before >= gap), F.col("_cell"))
    own = block == F.col("_block")
    marked = seen.withColumn("_begins", begins).withColumn("_to", F.max(F.when(own, F.col("_begins"))).over(by.rangeBetween(Window.unboundedPreceding, 0)))
    marked = marked.where(own).select(*k, "_block", "_cell", "_to").checkpoint()
    begun, step = marked.groupBy(*k, "_block").agg(F.max("_to").alias("_last")).checkpoint(), 1
    beside = lambda df, *more: df.select(*[F.col(c).alias(f"_r{c}") for c in k], *more)
    same = [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in k]
    while not begun.where("_last IS NULL").isEmpty():
        back = beside(begun, (F.col("_block") + step).alias("_rblock"), F.col("_last").alias("_older"))
        begun = begun.join(back, [*same, F.col("_block") == F.col("_rblock")], "left").select(*k, "_block", F.coalesce("_last", "_older").alias("_last")).checkpoint()
        step *= 2
    earlier = beside(begun, (F.col("_block") + 1).alias("_rblock"), "_last")
    found = marked.where("_to IS NULL").join(earlier, [*same, F.col("_block") == F.col("_rblock")]).select(*k, "_cell", F.col("_last").alias(name))
    numbered = marked.where("_to IS NOT NULL").select(*k, "_cell", F.col("_to").alias(name)).unionByName(found)
    known = beside(numbered, F.col("_cell").alias("_rcell"), name)
    return rows.join(known, [*same, F.col("_cell") == F.col("_rcell")], "left").select(*df.columns, name)
