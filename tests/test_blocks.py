"""Neighbours settled in blocks of time, and sums over cones, against plain loops."""

import math

import numpy as np
import pytest

from chirplake.operators import skypix
from chirplake.streaming import online

TRIGGERS = "search string, id long, gps double, theta double, phi double, rho double"


@pytest.mark.parametrize("block", [1, 3, 64])
def test_one_stretch_settles_in_blocks(frame, monkeypatch, block):
    """No gap of ``seconds`` anywhere, so one stretch holds all of a search."""
    monkeypatch.setattr(online, "BLOCK", block)
    rng = np.random.default_rng(block)
    rows = [(s, i, float(round(g, 2)), float(rng.integers(0, 18) * 10), float(rng.integers(0, 12) * 30), float(rng.integers(0, 6))) for s in "ab" for i, g in enumerate(rng.uniform(0, 60, 400))]
    rows += [("a", 900, 500.0, 5.0, 5.0, 1.0), ("b", 900, -7.0, 5.0, 5.0, 1.0)]
    names = [c.split()[0] for c in TRIGGERS.split(", ")]
    want = []
    for s in "ab":
        new = sorted((dict(zip(names, r, strict=True)) for r in rows if r[0] == s), key=lambda r: (r["gps"], r["id"]))
        want += [(s, p["id"], p["gps"]) for p in online.settle([], new, 1.0, 40.0)]
    out = online.settled_neighbours_batch(frame(rows, TRIGGERS), "search", 1.0, 40.0)
    assert sorted((r["search"], r["id"], r["gps"]) for r in out.collect()) == sorted(want)
    assert out.columns == names


def test_totals_of_cones(frame):
    rng = np.random.default_rng(2)
    sky = [(int(i), float(t), float(p)) for i, (t, p) in enumerate(zip(rng.uniform(0, math.pi, 400), rng.uniform(-7, 14, 400), strict=True))]
    sky += [(2**40, 0.0, 1.0), (2**40 + 1, math.pi, 2.0), (500, None, 1.0)]
    cones = [(i, t, p, (i % 7) * 0.09) for i, t, p in sky[:150]] + [(1000, 0.0, 0.0, 0.3), (1001, math.pi, 9.0, 0.5), (1002, 1.0, None, 0.5)]
    got = {r["id"]: r for r in skypix.totals(frame(cones, "id long, theta double, phi double, radius double"), frame(sky, "id long, theta double, phi double"), 0.6, "id", "id").collect()}
    for i, t, p, r in cones:
        if p is None:
            assert i not in got
            continue
        near = [(2 * math.asin(min(1.0, math.sqrt(math.sin((t - u) / 2) ** 2 + math.sin(t) * math.sin(u) * math.sin((p - v) / 2) ** 2))), k) for k, u, v in sky if u is not None]
        near = [x for x in near if x[0] <= r]
        assert (got[i]["n"], got[i]["total"]) == (len(near), sum(k for _, k in near))
        assert got[i]["nearest"] == pytest.approx(min(near)[0], abs=1e-12)


def test_cones_are_not_broadcast(frame):
    points = frame([(i, 0.01 * i, 0.02 * i) for i in range(1, 300)], "id long, theta double, phi double")
    out = skypix.close_directions(points, 0.05, "id")
    assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
    far = lambda a, b: 2 * math.asin(math.sqrt(math.sin((a - b) * 0.005) ** 2 + math.sin(0.01 * a) * math.sin(0.01 * b) * math.sin((a - b) * 0.01) ** 2))
    assert sorted((r["id_a"], r["id_b"]) for r in out.collect()) == [(a, b) for a in range(1, 300) for b in range(a + 1, 300) if far(a, b) <= 0.05]
