"""Linear prediction over blocks against least squares on whole series."""

import numpy as np
import pytest

from chirplake.operators import prediction

SCHEMA = "job string, block long, samples array<double>"


def blocks(job, x, size, first=0):
    return [(job, first + i // size, x[i : i + size].tolist()) for i in range(0, len(x), size)]


def by_hand(stretches, order):
    rows = [(x[t], [x[t - 1 - i] for i in range(order)]) for x in stretches for t in range(order, len(x))]
    return np.linalg.lstsq(np.array([r for _, r in rows]), np.array([y for y, _ in rows]), rcond=None)[0], len(rows)


@pytest.mark.parametrize("order", [1, 3, 8])
def test_equals_least_squares_on_the_whole_series(frame, order):
    rng = np.random.default_rng(order)
    x, y = np.zeros(900), rng.normal(size=137)
    for t in range(2, 900):
        x[t] = 1.2 * x[t - 1] - 0.5 * x[t - 2] + rng.normal()
    rows = blocks("a", x, 50) + blocks("a", x[:200], 40, first=100) + blocks("b", y, 9) + [("b", None, [1.0]), ("b", 500, None)]
    got = {r.job: r for r in prediction.coefficients(frame(rows, SCHEMA).repartition(5), ["job"], order).collect()}
    for job, stretches in (("a", [x, x[:200]]), ("b", [y])):
        want, n = by_hand(stretches, order)
        assert got[job].n == n and np.allclose(got[job].coefficients, want, atol=1e-9)


def test_residuals(frame):
    rng = np.random.default_rng(1)
    x = rng.normal(size=100)
    table = frame(blocks("a", x, 16), SCHEMA)
    fitted = prediction.coefficients(table, ["job"], 2)
    a = fitted.first().coefficients
    got = np.concatenate([r.residuals for r in prediction.residuals(table, fitted, ["job"], 2).orderBy("block").collect()])
    want = x.copy()
    want[2:] -= a[0] * x[1:-1] + a[1] * x[:-2]
    assert np.allclose(got, want)


def test_awkward_series(frame):
    zeros = {r.job: r.coefficients for r in prediction.coefficients(frame([("z", 0, [0.0] * 20), ("s", 0, [1.0])], SCHEMA), ["job"], 3).collect()}
    assert zeros == {"z": [0.0] * 3, "s": [0.0] * 3}
    assert prediction.coefficients(frame([], SCHEMA), ["job"], 3).count() == 0
    with pytest.raises(Exception, match="shorter than the order"):
        prediction.coefficients(frame([("a", 0, [1.0]), ("a", 1, [1.0] * 9)], SCHEMA), ["job"], 3).collect()
