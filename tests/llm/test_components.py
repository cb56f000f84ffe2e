"""Components: any graph's labels, and how many rounds, tables and files they take."""

import random

import pytest

from chirplake.llm.components import components
from chirplake.llm.shared import Scratch


def by_hand(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {x: top(x) for x in up}


def chain(n, rng):
    names = rng.sample(range(-(10**6), 10**6), n)
    return list(zip(names, names[1:], strict=False))


def graphs():
    rng = random.Random(5)
    yield []
    yield [(3, 3)]
    yield [(2, 1), (1, 2), (2, 1), (5, 5), (-7, 1)]
    yield chain(700, rng)
    yield [(rng.randrange(900), rng.randrange(900)) for _ in range(700)]
    yield [(0, i) for i in range(1, 600)] + [(900, i) for i in range(300, 700)]


@pytest.mark.parametrize("edges", list(graphs()))
def test_any_graph(spark, frame, edges):
    df = frame(edges, "a long, b long").repartition(5)
    got = [(r.node, r.label) for r in components(df, Scratch(spark, "t"), "x").collect()]
    assert len(got) == len(set(got))
    assert dict(got) == by_hand(edges)


def test_few_tables_and_files_whatever_the_shuffle_partitions(spark, frame):
    made = []

    class Counted(Scratch):
        def write(self, df, name, codec="zstd"):
            out = super().write(df, name, codec)
            made.append(len(out.inputFiles()))
            return out

    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        edges = chain(500, random.Random(6))
        got = components(frame(edges, "a long, b long").repartition(4), Counted(spark, "t"), "x")
        assert {r.node: r.label for r in got.collect()} == by_hand(edges)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(made) <= 15  # at most seven rounds
    assert max(made) <= max(4, spark.sparkContext.defaultParallelism)
