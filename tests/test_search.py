"""Scheduling, data quality, clusters, the sky and the online side against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirplake.functions import arrays
from chirplake.operators import clusters, cuts, dq, far, features, graph, injections, jobs, kernels, matching, network
from chirplake.plans import search
from chirplake.streaming import online

IV = "start double, end double"


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_lists_up_to_a_category(frame):
    files = frame([("H1", "CAT0", "a"), ("H1", "CAT1", "b"), ("H1", "CAT2", "c"), ("L1", "CAT0", "d"), ("L1", "CAT1", "none")], "ifo string, category string, file string")
    segments = frame([("H1", "a", 0.0, 10.0), ("H1", "a", 10.0, 30.0), ("H1", "b", 5.0, 20.0), ("H1", "c", 8.0, 9.0), ("L1", "d", 0.0, 50.0)], "ifo string, file string, start double, end double")
    got = dq.up_to_category(segments, files, "CAT1")
    assert rows_of(got, "ifo", "start", "end") == [("H1", 5.0, 20.0)]  # a list without segments leaves nothing of L1
    two = frame([("H1", "CAT2", "a"), ("L1", "CAT2", "d")], "ifo string, category string, file string")
    shifts = frame([("L1", 25.0)], "ifo string, shift double")
    assert rows_of(dq.veto_windows(segments, two, "CAT2", 2, shifts), "start", "end") == [(25.0, 30.0)]


def test_jobs_of_live_time(frame):
    live = frame([(0.0, 620.0)], IV)
    got = dq.jobs_of(live, 1200.0, 600.0, 10.0, 1.0, slags=[(0.0, 0.0), (0.0, 600.0)], windows=frame([(100.0, 200.0), (590.0, 900.0)], IV))
    assert [(r["slag_idx"], r["start"], r["end"], [tuple(w) for w in r["windows"]]) for r in got.orderBy("slag_idx").collect()] == [(i, 10.0, 610.0, [(100.0, 200.0), (590.0, 610.0)]) for i in (0, 1)]


def test_usable_intervals(frame):
    job = frame([(1, 0.0, 100.0), (2, 100.0, 200.0)], "job_id int, analyze_start double, analyze_end double")
    windows = frame([(1, 50.0, 70.0), (1, 90.0, 120.0), (2, 0.0, 150.0)], "job_id int, start double, end double")
    assert rows_of(injections.usable(job, windows, 30.0), "interval_id", "job_id", "start", "end") == [(0, 1, 50.0, 70.0), (1, 1, 90.0, 100.0), (2, 2, 100.0, 150.0)]


def test_poisson_schedule(spark, frame):
    rows = frame([(i, i * 1000.0, i * 1000.0 + 400) for i in range(30)], "interval_id long, start double, end double")
    points = spark.range(2000).withColumnRenamed("id", "i")
    got = injections.in_intervals_poisson(points, 0.02, rows, "i", 2000, seed=4).orderBy("i").collect()
    want, trial = [], 0
    while len(want) < 2000:
        for k in range(30):
            rng = np.random.default_rng([4, trial, k])
            t = k * 1000.0 + np.cumsum(rng.exponential(50, int(8 + 6 * math.sqrt(8) + 10)))
            want += [(trial, k, x) for x in t if x < k * 1000.0 + 400]
        trial += 1
    assert [(r["i"], r["trial_idx"], r["interval_id"], r["gps_time"]) for r in got] == [(i, *w) for i, w in enumerate(want[:2000])]
    assert injections.in_intervals_poisson(points, 0.02, rows, "i", 2000, seed=4, most_trials=2).count() < 2000


def test_poisson_schedule_draws_on_until_all_have_an_arrival(spark, frame, monkeypatch):
    """Where the first trials hold too few arrivals, no injection is lost; also in one range."""
    drawn = injections._drawn
    trials = []
    monkeypatch.setattr(injections, "_drawn", lambda rows, n, rate, seed: trials.append(n) or drawn(rows, n if len(trials) > 1 else 1, rate, seed))
    points = spark.range(200).withColumnRenamed("id", "i")
    got = injections.in_range_poisson(spark, points, 0.01, 0.0, 5000.0, "i", 200, edge=10.0, seed=2).collect()
    assert len(got) == 200 and len(trials) > 1 and all(10 <= r["gps_time"] < 4990 for r in got)


def test_rates_that_do_not_fit(spark, frame):
    with pytest.raises(ValueError):
        injections.in_range_at_rate(spark.range(5), 0.1, 0.0, 5.0, "id", 5)
    with pytest.raises(ValueError):
        injections.jittered(frame([(1, 0.0)], "id int, gps_time double"), 6.0, 0.1, "id")
    with pytest.raises(ValueError):
        injections.routed(frame([(1,)], "job_id int"), frame([(2, "x")], "job_id int, name string"))
    got = injections.in_range_at_rate(spark.range(5), 0.1, 0.0, 31.0, "id", 5)
    assert rows_of(got, "id", "trial_idx", "gps_time") == [(0, 0, 5.0), (1, 0, 15.5), (2, 0, 26.0), (3, 1, 5.0), (4, 1, 15.5)]


def test_points_with_nulls(frame):
    points = frame([(1, 5.0, None), (1, 5.0, None), (2, 50.0, "x"), (3, None, "y")], "id int, at double, note string")
    seg = frame([(7, 0.0, 10.0), (8, 4.0, 6.0)], "segment_idx int, start double, end double")
    assert sorted(map(str, rows_of(jobs.own_segment(points, seg, "at", 3.0), "id", "segment_idx"))) == ["(1, 7)", "(1, 7)", "(2, None)", "(3, None)"]
    assert rows_of(jobs.in_windows(points, seg, "at", 3.0, "inside"), "id", "inside") == [(1, True), (1, True), (2, False), (3, False)]


def test_components(spark, frame):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(80)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = sorted((n, find(n)) for n in {x for a, b in edges if a != b for x in (a, b)})
    assert rows_of(graph.components(frame(edges, "a long, b long")), "node", "label") == want
    assert graph.components(frame([], "a long, b long")).count() == 0


def test_superclusters(frame):
    pixels = frame([(1, 1, 0.0, 10.0, 4.0, [0.0], 5.0), (1, 2, 0.2, 10.0, 4.0, [0.2], 7.0), (1, 3, 90.0, 10.0, 4.0, [90.0], 9.0)], "job_id int, cluster_id int, time double, freq double, rate double, index array<double>, likelihood double")
    got = clusters.superclusters(pixels, ["job_id"], 1.0, 1)
    assert rows_of(got, "cluster_id", "size", "likelihood") == [(1, 2, 12.0), (3, 1, 9.0)]
    assert rows_of(clusters.superclusters(pixels, ["job_id"], 1.0, 2), "cluster_id") == [(1,)]
    assert clusters.close_links(pixels.where("false"), ["job_id"], 1.0).count() == 0


def test_antenna_and_delays(frame):
    rows = [(0.3, 0.2, 1.1, 1126259462.4), (4.0, -1.2, 0.0, 1200000000.0)]
    df = frame(rows, "ra double, dec double, psi double, gps double")
    plus, cross = network.antenna(search.H1, *[F.col(c) for c in ("ra", "dec", "psi", "gps")])
    from chirplake.functions import geo

    for r in df.select("*", plus.alias("p"), cross.alias("x"), geo.sidereal_radians(F.col("gps")).alias("g")).collect():
        hour, psi, dec = r["g"] - r["ra"], r["psi"], r["dec"]
        # the usual closed form of the wave frame, by hour angle
        x = np.array([-math.cos(psi) * math.sin(hour) - math.sin(psi) * math.cos(hour) * math.sin(dec), -math.cos(psi) * math.cos(hour) + math.sin(psi) * math.sin(hour) * math.sin(dec), math.sin(psi) * math.cos(dec)])
        y = np.array([math.sin(psi) * math.sin(hour) - math.cos(psi) * math.cos(hour) * math.sin(dec), math.sin(psi) * math.cos(hour) + math.cos(psi) * math.sin(hour) * math.sin(dec), math.cos(psi) * math.cos(dec)])
        d = np.array(search.H1.response())
        assert abs(r["p"] - (x @ d @ x - y @ d @ y)) < 1e-9 and abs(r["x"] - (x @ d @ y + y @ d @ x)) < 1e-9
    grid = frame([(0, 1.0, 2.0)], "sky_idx int, theta double, phi double")
    row = network.sky_table(grid, [search.H1, search.L1], search.H1, 16384.0).first()
    line = np.array([math.sin(1) * math.cos(2), math.sin(1) * math.sin(2), math.cos(1)])
    late = -(np.array(search.L1.place) - np.array(search.H1.place)) @ line / network.LIGHT
    assert row["delays"] == [0, round(late * 16384)] and abs(late) < 0.0101


def test_segment_maxima_with_zeros():
    for x in ([1.0, -2.0, 0.0, 3.0, -1.0], [0.0, 0.0], [1.0, 0.0, 1.0], [1.0, 2.0, -5.0]):
        signs = np.sign(x)
        change = [i for i in range(1, len(x)) if signs[i] != signs[i - 1]]
        want = [max(abs(v) for v in x[a:b]) for a, b in zip([0, *change[1:]], [*change[1:], len(x)], strict=True)] if len(change) > 1 else []
        assert kernels.segment_maxima(np.array(x)).tolist() == want


def test_whole_medians(frame):
    for n in (3, 5, 11):
        x = [float((i * 7) % 11) for i in range(n)]
        got = [r["median"] for r in cuts.rolling_median_whole(frame([(0, i, v) for i, v in enumerate(x)], "k int, i int, v double"), ["k"], "i", "v", 2).orderBy("i").collect()]
        want = []
        for i in range(n):
            left = min(max(i - 2, 0), max(n - 5, 0))
            want.append(float(np.median(x[left : left + 5])))
        assert got == want


def test_balanced_tail(frame):
    rows = [(i, float(i % 50), int(i % 5 == 0)) for i in range(1000)]
    got = features.balanced_tail(frame(rows, "id int, rho double, label int"), "rho", "label", 10.0, "id", 3).collect()
    assert sum(r["label"] for r in got) * 2 == len(got) == 320 and len({r["id"] for r in got}) == 320


def test_attached_rates_need_no_join(spark, frame):
    t = frame([(1, 0.5), (2, 1.5), (3, 9.0)], "id int, rho double")
    curve = far.far_curve(t, "rho", 0.0, 1.0, 2, far.YEAR)
    out = far.attach_far(t, "rho", curve, far.YEAR)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString().split("Subquery")[0].split("scalar-subquery")[0]
    assert {r["id"]: r["far"] for r in out.collect()} == {1: 2.0, 2: 1.0, 3: 1.0}
    with pytest.raises(ValueError):
        matching.overlapping(frame([(1, 0.0)], "id int, gps_time double"), frame([(1, 0.0, 0.0, 1.0)], "sim_idx int, gps_time double, real_start double, real_end double"))


def test_leakage(frame):
    got = frame([([1.0, -2.0, 0.0, 3.0, 4.0], [1.0, 2.0, 0.0, 0.0, 0.0])], "w array<double>, r array<double>").select(arrays.leakage(F.col("w"), F.col("r"), 3).alias("x")).first()["x"]
    assert np.allclose(got, np.array([0.0, 3.0, 4.0]) / math.sqrt(5))


def test_stream_of_neighbours_equals_the_table(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [("s", int(i), float(round(g, 3)), float(rng.choice([10.0, 12.0, 80.0])), 5.0, float(rng.integers(0, 9))) for i, g in enumerate(np.sort(rng.uniform(0, 60, 150)))]
    schema = "search string, id long, gps double, theta double, phi double, rho double"
    end = [("end", 9999, 100000.0, 0.0, 0.0, 0.0)]
    both = spark.createDataFrame(rows, schema).withColumn("ts", online.of_gps(F.col("gps")))
    for k in range(3):
        both.where((F.col("gps") >= 20 * k) & (F.col("gps") < 20 * k + 20)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    # a last row far ahead moves the watermark past all others, as data that go on do
    for k in (3, 4):
        spark.createDataFrame([(f"end{k}", 9999 + k, 100000.0 + k, 0.0, 0.0, 0.0)], schema).withColumn("ts", online.of_gps(F.col("gps"))).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(both.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = online.settled_neighbours(stream, "search", "ts", hold=2.0)
    run = out.writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r["id"], r["rho"]) for r in spark.table("settled").where("search = 's'").collect())
    want, pending = [], []
    for r in rows:
        online.settle(pending, [dict(zip(schema.replace(",", "").split()[::2], r, strict=True))])
    want = sorted((p["id"], p["rho"]) for p in pending)
    batch = online.settled_neighbours_batch(both, "search")
    assert sorted((r["id"], r["rho"]) for r in batch.collect()) == want == got and len(want) < 150 and end


def test_handler_is_idempotent(spark, frame, tmp_path):
    curve = far.far_curve(frame([(1.0,), (3.0,)], "rho double"), "rho", 0.0, 1.0, 5, far.YEAR)
    put = online.handler(f"{tmp_path}/saved", curve, far.YEAR)
    columns = "id long, gps double, theta double, phi double, rho double"
    first, second = frame([(1, 10.0, 5.0, 5.0, 3.0)], columns), frame([(2, 10.1, 5.0, 5.0, 2.0), (3, 10.2, 6.0, 5.0, 4.0), (4, 50.0, 5.0, 5.0, 1.0)], columns)
    put(first, 0)
    put(second, 1)
    put(second, 1)
    saved = spark.read.parquet(f"{tmp_path}/saved")
    assert sorted(r["id"] for r in saved.collect()) == [1, 3, 4] and saved.where("far is null").count() == 0


def test_directory_source(spark, tmp_path):
    (tmp_path / "H1-1000-16.json").write_text('{"x": 1}\n')
    (tmp_path / "odd.json").write_text('{"x": 2}\n')
    rows = online.source(spark, {"type": "directory", "path": str(tmp_path), "schema": "x int"})
    run = rows.writeStream.format("memory").queryName("dir").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [tuple(r) for r in spark.table("dir").collect()] == [(1, 1000.0, 16.0)]
    with pytest.raises(ValueError):
        online.source(spark, {"type": "pigeon"})
