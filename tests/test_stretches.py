"""Stretches without a gap against a plain walk over sorted rows."""

import random

import pytest
from pyspark.sql import functions as F

from chirplake.operators import stretches


@pytest.mark.parametrize("gap", [1.0, 0.3])
def test_stretches(frame, gap):
    rng = random.Random(int(gap * 10))
    rows = [("a", round(rng.uniform(-50, 150), 2)) for _ in range(400)] + [(None, round(rng.uniform(0, 30), 2)) for _ in range(60)] + [("b", 0.0), ("b", gap), ("b", gap * 1.5)]
    rows += [("c", i * gap * 0.9) for i in range(600)] + [("c", 600 * gap + 5)]  # one stretch over many blocks
    table = frame([(i, *r) for i, r in enumerate(rows)] + [(-1, "a", None)], "i long, k string, t double")
    got = {r["i"]: (r["k"], r["s"]) for r in stretches.stretched(table, ["k"], "t", gap, "s").collect()}
    assert got.pop(-1) == ("a", None) and len(got) == len(rows)
    want, number = {}, 0
    for k in {k for k, _ in rows}:
        last = None
        for t, i in sorted((t, i) for i, (x, t) in enumerate(rows) if x == k):
            number += last is None or t - last >= gap
            want[i], last = number, t
    assert len(set(got.values())) == len(set(want.values())) == len({(got[i], want[i]) for i in want})


def test_one_key_is_dealt_over_tasks(spark):
    """All rows of one key, without a gap: blocks meet in many tasks, and the stretch is found by doubling."""
    rows = spark.range(20_000).select(F.lit("x").alias("k"), (F.col("id") * 0.5).alias("t"))
    assert [r["s"] for r in stretches.stretched(rows, ["k"], "t", 1.0, "s").select("s").distinct().collect()] == [0]
    assert stretches.stretched(rows.limit(0), ["k"], "t", 1.0).count() == 0
