"""Sigmoids of many groups at once against a direct maximiser of the likelihood."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chirplake.operators import efficiency


def likelihood(rows, middle, width):
    total = 0.0
    for x, hit in rows:
        p = min(max(0.5 * math.erfc(-(math.log10(x) - middle) / width), 1e-12), 1 - 1e-12)
        total += math.log(p if hit else 1 - p)
    return total


def maximised(rows):
    middle, width, step = 0.5, 1.0, 0.5
    best = likelihood(rows, middle, width)
    while step > 1e-7:
        tried = [(likelihood(rows, m, w), m, w) for m in (middle - step, middle, middle + step) for w in (width - step, width, width + step) if w > 1e-3]
        top = max(tried)
        if top[0] > best:
            best, middle, width = top
        else:
            step /= 2
    return middle, width


def test_sigmoids(frame):
    rng, rows = random.Random(1), []
    for name, middle, width in (("a", 0.3, 0.4), ("b", 1.1, 0.8), (None, 0.8, 0.2)):
        for _ in range(500):
            x = 10 ** rng.choice([0.0, 0.25, 0.5, 0.75, 1.0, 1.25, 1.5])
            rows.append((name, x, rng.random() < 0.5 * math.erfc(-(math.log10(x) - middle) / width)))
    separated = [("s", 10.0**i, i > 1) for i in range(4)] + [("all", 2.0, True), ("all", 3.0, True), ("one", 5.0, True), ("one", 5.0, False)]
    odd = [("a", None, True), ("a", 0.0, True), ("a", -1.0, False)]
    got = {r["name"]: r for r in efficiency.sigmoids(frame(rows + separated + odd, "name string, x double, hit boolean"), ["name"], "x", F.col("hit")).collect()}
    for name in ("a", "b", None):
        own = [(x, hit) for n, x, hit in rows if n == name]
        middle, width = maximised(own)
        assert got[name].settled and got[name].n == 500
        assert (got[name].middle, got[name].width) == pytest.approx((middle, width), abs=2e-5)
        assert got[name].hrss50 == pytest.approx(10**middle, rel=1e-4) and 0.5 * math.erfc(-(math.log10(got[name].hrss10) - middle) / width) == pytest.approx(0.1, abs=1e-4)
    assert all(got[n].middle is None and not got[n].settled for n in ("s", "all", "one"))
