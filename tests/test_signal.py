"""Noise, waveforms, thresholds and configurations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirplake.operators import signal
from chirplake.plans import config


def test_spectrum_on_a_grid(frame):
    rows = [(1.0, 2.0), (2.5, 5.0), (4.0, 2.0)]
    got = [r["psd"] for r in signal.psd_on_grid(frame(rows, "freq double, asd double"), 0.5, 12).orderBy("bin").collect()]
    f = np.arange(12) * 0.5
    want = np.where((f >= 1) & (f <= 4), np.interp(f, [1, 2.5, 4], [2, 5, 2]) ** 2, 0)
    assert np.allclose(got, want)


def test_noise_has_its_spectrum_and_seed(frame):
    jobs = frame([(1, "H1"), (1, "L1"), (2, "H1")], "job_id int, ifo string")
    got = {(r["job_id"], r["ifo"]): np.array(r["strain"]) for r in signal.noise(jobs, 64.0, 256.0, [4.0] * 129, 1.0, seed=3).collect()}
    again = {(r["job_id"], r["ifo"]): np.array(r["strain"]) for r in signal.noise(jobs.repartition(3), 64.0, 256.0, [4.0] * 129, 1.0, seed=3).collect()}
    assert all((got[k] == again[k]).all() for k in got) and not np.allclose(got[1, "H1"], got[2, "H1"])
    # a flat one-sided spectrum of 4 over 128 Hz is a variance of 512
    assert abs(got[1, "L1"].var() / 512 - 1) < 0.05


def test_sine_gaussian_and_projection(frame):
    df = frame([(50.0, 9.0, 2.0)], "f double, q double, h double")
    plus, cross = signal.sine_gaussian(F.col("f"), F.col("q"), F.col("h"), 1.0, 1024.0)
    r = df.select(plus.alias("p"), cross.alias("c"), signal.projected(plus, cross, F.lit(0.5), F.lit(-1.0)).alias("s")).first()
    p, c = np.array(r["p"]), np.array(r["c"])
    assert abs(math.sqrt(((p**2 + c**2) / 1024).sum()) - 2) < 1e-9 and np.allclose(r["s"], 0.5 * p - c)
    assert int(np.abs(np.fft.rfft(p)).argmax()) == 50


def test_thresholds():
    # sums of exponentials by simulation
    rng = np.random.default_rng(1)
    draws = rng.exponential(1, (200_000, 3)).sum(1)
    assert abs((draws > 2.0).mean() - signal.upper_gamma(3, 2.0)) < 0.01
    for n, p in ((1, 0.3), (2, 0.314), (4, 1e-6)):
        assert abs(signal.upper_gamma(n, signal.inverse_upper_gamma(n, p)) / p - 1) < 1e-6
    assert signal.pair_threshold(1.7, 1) == 1.7 and signal.pair_threshold(-1.0, 1) == 0.0
    assert signal.upper_gamma(1, signal.pair_threshold(1.7, 2)) == pytest.approx(signal.upper_gamma(2, 1.7**2 * 2))


def test_ragged_rows(frame):
    rows = [[1.0, 2.0], [], [3.0]]
    r = frame([(rows,)], "x array<array<double>>").select(signal.csr(F.col("x")).alias("c")).select("c.values", "c.offsets", signal.from_csr(F.col("c")).alias("x")).first()
    assert (r["values"], r["offsets"], r["x"]) == ([1.0, 2.0, 3.0], [0, 2, 2, 3], rows)


def test_lag_ids():
    got = signal.lag_ids(3, 40, 6)
    assert got[0] == [0, 0, 0] and len({tuple(x) for x in got}) == len(got) == 40
    assert all(min(x) == 0 and len(set(x)) == 3 and max(x) <= 12 for x in got[1:]) and got == signal.lag_ids(3, 40, 6)
    assert signal.lag_ids(3, 10, 6, offset=5) == got[5:15]


def test_configurations(tmp_path, frame):
    schema = {"properties": {"ifo": {"type": "array", "default": ["H1"]}, "inRate": {"type": "integer"}, "levelR": {"type": "integer", "default": 2}, "deep": {"type": "object", "properties": {"x": {"type": "number", "default": 1}}}}, "required": ["inRate"]}
    got = config.derived(config.with_defaults({"inRate": 4096, "deep": {}}, schema))
    assert got == {"ifo": ["H1"], "inRate": 4096, "levelR": 2, "deep": {"x": 1}, "nIFO": 1, "rateANA": 1024}
    for bad in ({}, {"inRate": "x"}, {"inRate": 1, "other": 2}):
        with pytest.raises(ValueError):
            config.with_defaults(bad, schema)
    assert config.capped(["rho0", "norm"], {"rho0": 11}, {"rho0": 8}) == ["rho0_cap8", "norm"]
    (tmp_path / "rank.py").write_text("def rank(df):\n    return df.selectExpr('x * 2 AS y')\n")
    assert config.hook(str(tmp_path / "rank.py"), "rank")(frame([(2,)], "x int")).first()["y"] == 4
    with pytest.raises(ValueError):
        config.hook(str(tmp_path / "rank.py"), "none")
    with pytest.raises(FileNotFoundError):
        config.hook(str(tmp_path / "no.py"), "rank")
