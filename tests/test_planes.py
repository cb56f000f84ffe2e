"""Clusters over tiles, exact ranks, thresholds, and directions, each against its plain definition."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirplake.operators import coherent, graph, kernels, ranks, tiles


def by_union(places, kf, kt):
    """The first place of each place's cluster."""
    order = sorted(set(places))
    label = kernels.label_grid(np.array([f for _, f in order]), np.array([t for t, _ in order]), kf, kt)
    first = {}
    for place, n in zip(order, label, strict=True):
        first.setdefault(n, place)
    return {place: first[n] for place, n in zip(order, label, strict=True)}


@pytest.mark.parametrize(("seed", "kf", "kt"), [(0, 3, 2), (1, 1, 1), (2, 2, 5)])
def test_clusters_across_borders(spark, frame, monkeypatch, seed, kf, kt):
    """Negative places, repeated pixels, a line through many tiles, and corners."""
    monkeypatch.setattr(tiles, "TILE", 8)
    rng = random.Random(seed)
    places = [(rng.randrange(-40, 40), rng.randrange(-20, 20)) for _ in range(300)] + [(t, t) for t in range(-60, 60)] + [(7, 8), (8, 7), (100, 0), (100, 0)]
    got = tiles.clusters(frame([("a", t, f, i) for i, (t, f) in enumerate(places)] + [("b", 0, 0, -1), (None, 0, 0, -2), ("a", None, 1, -3)], "job string, time int, freq int, id int"), ["job"], kf, kt)
    want = by_union(places, kf, kt)
    rows = {r.id: (r.cluster_time, r.cluster_freq) for r in got.collect()}
    assert rows == {i: want[p] for i, p in enumerate(places)} | {-1: (0, 0), -2: (0, 0), -3: (None, None)}


def test_no_clusters(frame):
    assert tiles.clusters(frame([], "time int, freq int"), []).count() == 0


def test_a_plane_of_one_key_is_dealt_over_tasks(spark):
    """One job with all pixels: no task of the labelling holds more than its tile."""
    pixels = spark.range(40_000).select((F.col("id") % 2000 * 2).alias("time"), (F.floor(F.col("id") / 2000) * 40).alias("freq"), F.lit(1).alias("job"))
    got = tiles.clusters(pixels, ["job"])
    assert got.select("cluster_time", "cluster_freq").distinct().count() == 20
    assert math.ceil(4000 / tiles.TILE) * math.ceil(800 / tiles.TILE) > 30


def test_components_of_chains_stars_and_structs(spark, frame):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (2000, 2001), (2001, 2000)]
    got = {r.node: r.label for r in graph.components(frame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(300)} | {2000: 2000, 2001: 2000}
    named = frame(edges, "a long, b long").select(F.struct("a").alias("a"), F.struct(F.col("b").alias("a")).alias("b"))
    assert {r.node.a: r.label.a for r in graph.components(named).collect()} == got


def test_running_sums_of_skewed_values(frame):
    rows = [(i, float(i % 7)) for i in range(2000)] + [(2000, 1e12), (2001, None)]
    got = graph.running(frame(rows, "id long, v double"), "v", ["v", "id"], F.col("id"), "before")
    total, want = 0, {}
    for i, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        want[i] = total
        total += i
    assert {r.id: r.before for r in got.collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_ranks(frame, seed):
    rng = random.Random(seed)
    rows = [("a", rng.choice([rng.uniform(-1, 1), 0.5, 1e300 * rng.uniform(-1, 1), 1e-300])) for _ in range(700)] + [("b", 2.0)] * 40 + [(None, 1.0), ("a", None), ("a", float("nan")), ("c", None)]
    asked = [(g, k) for g in ("a", "b", "c", "d", None) for k in (0, 1, 2, 40, 41, 333, 700, 701)]
    got = {(r.g, r.k): r.found for r in ranks.largest(frame(rows, "g string, v double"), ["g"], "v", frame(asked, "g string, k int")).collect()}
    by = defaultdict(list)
    for g, v in rows:
        if v is not None and not math.isnan(v):
            by[g].append(v)
    assert got == {(g, k): sorted(by[g], reverse=True)[k - 1] if 1 <= k <= len(by[g]) else None for g, k in asked}


def test_ranks_of_a_whole_table(frame):
    got = ranks.largest(frame([(float(i),) for i in range(5000)], "v double"), [], "v", frame([(17,), (5000,)], "k long"))
    assert sorted((r.k, r.found) for r in got.collect()) == [(17, 4983.0), (5000, 0.0)]


#: Values of the function from tables.
@pytest.mark.parametrize(("shape", "x", "share"), [(1, 2.0, math.exp(-2)), (0.5, 1.0, math.erfc(1.0)), (3, 2.0, 5 * math.exp(-2)), (10, 20.0, 0.0049954123), (2.5, 0.1, 0.9991139)])
def test_upper_share(shape, x, share):
    assert ranks.upper_share(shape, x) == pytest.approx(share, rel=1e-6)
    assert ranks.inverse_upper_share(shape, share) == pytest.approx(x, rel=1e-4)


def test_thresholds(frame):
    rng = random.Random(1)
    rows = [("x", rng.gammavariate(3, 1.3)) for _ in range(4000)] + [("x", 0.0)] * 500 + [("x", None), ("x", 900.0)] + [("zero", 0.0)] * 5
    table = frame(rows, "g string, e double")
    got = {r.g: r for r in ranks.energy_threshold(table, ["g"], "e", 3, 0.01).collect()}
    values = sorted(min(max(v, 0.0), 300.0) for g, v in rows if g == "x" and v is not None)
    filled = sum(v > 1e-4 for v in values)
    tail, bulk = (values[len(values) - int(s * filled) - 1] for s in (0.01, 0.2))
    shape = 1.0
    while ranks.upper_share(3 * shape, bulk) < 0.2:
        shape += 0.01
    shape = shape + 0.01 - 0.01 if shape > 1 else shape
    assert (got["x"].n, got["x"].filled, got["x"].tail, got["x"].bulk) == (len(values), filled, tail, bulk)
    assert got["x"].threshold == pytest.approx(0.3 * (ranks.inverse_upper_share(3 * shape, 0.01) + tail) + 3 * math.log(shape), rel=1e-9)
    assert got["zero"].threshold == 0.0
    shaped = {r.g: r.threshold for r in ranks.energy_threshold(table, ["g"], "e", 3, 0.01, packet=1.5).collect()}
    positive = [v for v in values if v > 1e-3]
    mean = sum(positive) / len(positive)
    gap = math.log(mean) - sum(map(math.log, positive)) / len(positive)
    fit = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    assert shaped["zero"] == 0.0 and shaped["x"] == pytest.approx(mean * ranks.inverse_upper_share(fit, 0.01 * fit / 1.5) / fit / 2, rel=1e-9)
    assert ranks.energy_threshold(table, [], "e", 3, 0.01).count() == 1


@pytest.mark.parametrize("detectors", [1, 2, 3])
def test_directions(frame, detectors):
    """The statistic is the part of the amplitudes, moved by the delays, that least squares on both patterns explains."""
    rng = random.Random(detectors)
    pixels = [(e, d, rng.randrange(2), rng.randrange(30), rng.uniform(-1, 1)) for e in (1, 2) for d in range(detectors) for _ in range(25)] + [(1, 0, 0, 3, None)]
    sky = [(s, d, rng.randrange(-4, 5), rng.choice([0.0, rng.uniform(-1, 1)]), rng.uniform(-1, 1) if s else 0.0) for s in range(6) for d in range(detectors)]
    sky += [(6, d, 0, 0.0, 0.0) for d in range(detectors)] + [(7, *r[1:]) for r in sky if r[0] == 5]
    got = {(r.event, r.sky): r.statistic for r in coherent.scan(frame(pixels, "event int, detector int, layer int, index int, amplitude double"), frame(sky, "sky int, detector int, delay int, plus double, cross double"), ["event"], 8).collect()}
    want, energy = {}, {}
    for event in (1, 2):
        a = defaultdict(float)
        for e, d, layer, i, x in pixels:
            if e == event:
                a[d, layer, i] += x or 0.0
        energy[event] = sum(x * x for x in a.values())
        for s in range(8):
            row = {d: (delay, p, c) for k, d, delay, p, c in sky if k == s}
            basis = np.array([[row[d][1], row[d][2]] for d in range(detectors)])
            explain = basis @ np.linalg.pinv(basis)
            want[event, s] = sum(float(v @ explain @ v) for layer in (0, 1) for i in range(-10, 45) for v in [np.array([a.get((d, layer, i + row[d][0]), 0.0) for d in range(detectors)])])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    best = {r.event: r for r in coherent.best_direction(frame(pixels, "event int, detector int, layer int, index int, amplitude double"), frame(sky, "sky int, detector int, delay int, plus double, cross double"), ["event"], 8).collect()}
    for event in (1, 2):
        top = max(round(want[event, s], 9) for s in range(8))
        assert best[event].sky == max(s for s in range(8) if abs(want[event, s] - top) < 1e-8)
        assert best[event].energy == pytest.approx(energy[event])
    with pytest.raises(ValueError, match="samples"):
        coherent.scan(frame(pixels, "event int, detector int, layer int, index int, amplitude double"), frame([(0, 0, 0, 1.0, 1.0), (0, 1, 99, 1.0, 1.0)], "sky int, detector int, delay int, plus double, cross double"), ["event"], 8)
