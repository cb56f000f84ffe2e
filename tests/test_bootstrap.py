"""Bootstrap bands against a NumPy version with the same draws."""

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirplake.operators import bootstrap

ROWS = "g string, id long, v double"


def drawn(key, replicate, seed):
    u = int(hashlib.md5(f"{seed}_{replicate}_{key}".encode()).hexdigest()[:13], 16) / 2**52
    k, total = 0, math.exp(-1)
    while u >= total and k < 12:
        k += 1
        total += math.exp(-1) / math.factorial(k)
    return k


def by_hand(rows, count, level, kind, seed):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    n, mean = len(x), x.mean()
    means, errors = [], []
    for r in range(count):
        sample = np.repeat(x, [drawn(i, r, seed) for i in ids])
        if len(sample):
            means.append(sample.mean())
            errors.append(sample.std() / math.sqrt(len(sample)))
    means, errors, low, high = np.array(means), np.array(errors), (1 - level) / 2, (1 + level) / 2
    if kind == "studentised":
        t = np.where(errors > 1e-12, (means - mean) / np.maximum(errors, 1e-300), 0)
        return mean - np.quantile(t, high) * x.std() / math.sqrt(n), mean - np.quantile(t, low) * x.std() / math.sqrt(n)
    if kind == "bca":
        left_out = np.array([np.delete(x, i).mean() for i in range(n)])
        d = left_out.mean() - left_out
        a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
        z0 = NormalDist().inv_cdf(((means < mean).sum() + (means == mean).sum() / 2) / len(means))
        low, high = (NormalDist().cdf(z0 + (z0 + NormalDist().inv_cdf(q)) / (1 - a * (z0 + NormalDist().inv_cdf(q)))) for q in (low, high))
    return np.quantile(means, low), np.quantile(means, high)


@pytest.mark.parametrize("kind", bootstrap.KINDS)
def test_bands(frame, kind):
    rng = np.random.default_rng(1)
    data = {"a": [(i, float(v)) for i, v in enumerate(rng.exponential(3, 60))], "b": [(i + 500, float(v)) for i, v in enumerate(rng.normal(size=25))]}
    rows = [(g, i, v) for g, x in data.items() for i, v in x] + [("a", 9000, None), ("a", 9001, float("nan")), ("c", 1, None)]
    got = {r.g: r for r in bootstrap.bands(frame(rows, ROWS).repartition(4), ["g"], "id", "v", 80, 0.8, kind, seed=3).collect()}
    assert set(got) == {"a", "b"}
    for g, x in data.items():
        assert got[g].n == len(x) and got[g].mean == pytest.approx(np.mean([v for _, v in x]))
        assert (got[g].lower, got[g].upper) == pytest.approx(by_hand(x, 80, 0.8, kind, 3), rel=1e-6)


def test_draws_are_poisson_and_equal_values_have_no_width(spark, frame):
    counts = {r.k: r.n for r in spark.range(20_000).select(bootstrap.draws(F.col("id"), F.lit(1), 7).alias("k")).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert all(abs(counts.get(k, 0) / 20_000 - math.exp(-1) / math.factorial(k)) < 0.012 for k in range(6))
    for kind in bootstrap.KINDS:
        got = bootstrap.bands(frame([("x", i, 2.0) for i in range(9)] + [(None, 1, 5.0)], ROWS), ["g"], "id", "v", 40, kind=kind).collect()
        assert {r.g: (r.lower, r.upper) for r in got} == {"x": (2.0, 2.0), None: (5.0, 5.0)}
    with pytest.raises(ValueError):
        bootstrap.bands(frame([], ROWS), ["g"], "id", "v", kind="other")
