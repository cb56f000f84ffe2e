"""Operators on hand-written rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirplake.functions import arrays, geo
from chirplake.operators import catalog, efficiency, far, features, intervals, jobs, kernels, lags, matching, selection
from chirplake.sources import files
from chirplake.streaming import online

TRIG, SIM = "id string, job_id int, trial_idx int, gps_time double, rho double", "sim_idx int, job_id int, trial_idx int, gps_time double, real_start double, real_end double"


def test_one_to_one_is_greedy(frame):
    t = frame([("t1", 1, 0, 1000.0, 8.0), ("t2", 1, 0, 1000.1, 12.0)], TRIG)
    s = frame([(10, 1, 0, 1000.0, 999.0, 1001.0), (20, 1, 0, 1000.0, 998.0, 1002.0)], SIM)
    assert [(r["id"], r["sim_sim_idx"]) for r in matching.match(t, s).collect()] == [("t2", 10)]


@pytest.mark.parametrize("how,rows", [("inner", 0), ("left", 1), ("right", 1), ("outer", 2)])
def test_other_job_does_not_match(frame, how, rows):
    t, s = frame([("t1", 1, 0, 1000.0, 8.0)], TRIG), frame([(10, 2, 0, 1000.0, 999.5, 1000.5)], SIM)
    assert matching.match(t, s, how).count() == rows


def test_unknown_join_kind(frame):
    with pytest.raises(ValueError):
        matching.match(frame([], TRIG), frame([], SIM), "cross")


def test_cells_change_no_pair(frame):
    rng = np.random.default_rng(1)
    t = frame([(str(i), 1, 0, float(x), 1.0) for i, x in enumerate(rng.uniform(0, 500, 60))], TRIG)
    s = frame([(i, 1, 0, float(x), float(x - w), float(x + w)) for i, (x, w) in enumerate(zip(rng.uniform(0, 500, 40), rng.uniform(0.1, 60, 40), strict=True))], SIM)
    pairs = lambda cell: sorted((r["id"], r["sim_sim_idx"]) for r in matching.overlapping(t, s, 1.0, cell).collect())
    assert pairs(None) == pairs(7.0)


def test_keep_last_and_stale(frame):
    t = frame([("a", 1, 0, 0, 1), ("a", 1, 0, 0, 2), ("a", 1, 0, 1, 3), ("b", 2, 0, 0, 4)], "id string, job_id int, trial_idx int, lag_idx int, _seq int")
    last = catalog.keep_last(t)
    assert sorted(r["_seq"] for r in last.collect()) == [2, 3, 4]
    done = frame([(1, 0, 1)], "job_id int, trial_idx int, lag_idx int")
    assert sorted(r["_seq"] for r in catalog.remove_stale(last, done, F.col("job_id") == 1).collect()) == [3, 4]


def test_zero_lag_rules(frame):
    df = frame([(0, 0.0, [0.0, 0.0]), (0, 1e-13, [0.0, 1.0]), (1, 0.0, None), (None, None, None)], "lag_idx int, time_lag_0 double, shift array<double>")
    assert [r[0] for r in df.select(lags.zero_lag(df)).collect()] == [True, False, False, True]
    assert [r[0] for r in df.select(lags.zero_lag(df, F.lit(True))).collect()] == [True, True, False, True]


def test_interval_algebra(frame):
    a = frame([(1, 0.0, 10.0), (1, 20.0, 30.0), (1, 10.0, 12.0)], "k int, start double, end double")
    b = frame([(1, 5.0, 20.0)], "k int, start double, end double")
    rows = lambda df: sorted((r["start"], r["end"]) for r in df.collect())
    assert rows(intervals.intersect(a, b, ["k"])) == rows(intervals.intersect(a, b, ["k"], 3.0)) == [(5.0, 10.0), (10.0, 12.0)]
    assert rows(intervals.union(a, ["k"])) == [(0.0, 12.0), (20.0, 30.0)]
    assert rows(intervals.gaps(a, ["k"])) == [(12.0, 20.0)]
    assert rows(intervals.shift_circular(a, F.lit(15.0), F.lit(40.0))) == [(0.0, 5.0), (15.0, 25.0), (25.0, 27.0), (35.0, 40.0)]


def test_job_split_rules(frame):
    iv = frame([(0.0, 620.0), (0.0, 100.0), (100000.0, 102400.0)], "start double, end double")
    got = sorted((r["start"], r["end"]) for r in jobs.split_jobs(iv, 1200.0, 600.0, 10.0).collect())
    assert got == [(10.0, 610.0), (100010.0, 101200.0), (101200.0, 102390.0)]


def test_schedule_sums_no_table_in_one_task(spark, frame, capsys):
    points = spark.range(40).withColumnRenamed("id", "key")
    got = {n: jobs.schedule_at_rate(points, frame([(i, i * 100.0, i * 100.0 + 1 + i % 3) for i in range(n)], "interval_id long, start double, end double"), 0.5, "key") for n in (10, 3000)}
    for n, out in got.items():
        size = [1 + i % 3 for i in range(n)]
        capacity = int(sum(size) * 0.5)
        step = (sum(size) - 2) / (capacity - 1)
        for r in out.collect():
            at, i = 1 + r["key"] % capacity * step, 0
            while at >= size[i]:
                at, i = at - size[i], i + 1
            assert (r["trial_idx"], r["interval_id"]) == (r["key"] // capacity, i) and abs(r["gps_time"] - i * 100.0 - at) < 1e-6
        assert out.count() == 40
    got[3000].explain()
    windows = re.findall(r"windowspecdefinition\(([^)]*)", capsys.readouterr().out)
    assert windows and all(w.startswith("_b") for w in windows)


def test_superlags_start_with_zero(spark):
    rows = [list(r["shift"]) for r in jobs.superlags(spark, 3, 3, size=5).collect()]
    assert rows[0] == [0, 0, 0] and all(r[0] == 0 for r in rows) and len({tuple(r) for r in rows}) == 5


def test_far_counts(frame):
    t = frame([(x,) for x in (0.5, 1.5, 1.5, 2.0)], "rho double")
    assert [(r["bin"], r["n"], r["n_above"]) for r in far.far_curve(t, "rho", 0.0, 1.0, 2, far.YEAR).orderBy("bin").collect()] == [(0, 1, 4), (1, 3, 3)]
    got = far.per_event_ifar(t.distinct(), t, "rho", 100.0).collect()
    assert {r["rho"]: r["n_above"] for r in got} == {0.5: 4, 1.5: 3, 2.0: 1}
    # an event without a value stays, without a rate; background without one does not count
    more = frame([(1.5,), (None,), (9.0,), (-1.0,)], "rho double")
    got = {r["rho"]: (r["n_above"], r["ifar_s"]) for r in far.per_event_ifar(more, t.unionByName(more.where("rho IS NULL")), "rho", 100.0).collect()}
    assert got[None] == (None, None) and got[1.5] == (3, 100 / 3) and got[-1.0] == (4, 25.0)
    assert far.per_event_ifar(more, t.where("rho > 5"), "rho", 100.0).count() == 4


def test_crossing(frame):
    curve = frame([("a", 1.0, 0.0), ("a", 100.0, 1.0), ("b", 1.0, 0.9), ("c", 3.0, 0.1)], "name string, hrss double, efficiency double")
    assert {r["name"]: round(r["crossing"], 6) for r in efficiency.crossing(curve, ["name"]).collect()} == {"a": 10.0, "b": 1.0, "c": 3.0}


def test_sigmoid_recovers_its_middle():
    x = np.logspace(-1, 3, 15)
    mid, width = efficiency.fit_sigmoid(x, efficiency._erfc_curve(x, 1.2, 0.4), np.ones(15))
    assert abs(mid - 1.2) < 0.02 and abs(width - 0.4) < 0.05


def test_splits_are_disjoint():
    parts = selection.split_by_livetime([(i, 100.0) for i in range(10)], [0.5, 0.5], seed=1)
    assert len(parts[0]) == len(parts[1]) == 5 and not set(parts[0]) & set(parts[1])


def test_caps_keep_null(frame):
    df = frame([(None,), (5.0,), (1.0,)], "x double")
    assert [r[0] for r in df.select(features.cap(F.col("x"), 2.0)).collect()] == [None, 2.0, 1.0]


def test_components_of_pixels():
    f, t = np.array([0, 1, 9, 9]), np.array([0, 1, 1, 9])
    assert kernels.label_grid(f, t, 3, 2).tolist() == [0, 0, 1, 2]


def test_q_veto_of_a_burst():
    t = np.arange(256) / 256
    wave = np.sin(2 * np.pi * 20 * t) * np.exp(-(((t - 0.5) / 0.1) ** 2))
    veto, factor = kernels.q_veto(wave)
    assert veto > 0 and factor > 0 and kernels.q_veto(np.zeros(8)) == (0.0, 0.0)


def test_geo(frame):
    df = frame([(90.0, 0.0, 90.0, 90.0)], "a double, b double, c double, d double")
    assert abs(df.select(geo.separation(*[F.col(c) for c in "abcd"])).first()[0] - 90) < 1e-9
    angles = frame([("12 deg",), ("3h",), ("x",)], "s string").select(geo.parse_angle(F.col("s"))).collect()
    assert [r[0] for r in angles] == [12.0, 45.0, None]


def test_arrays(frame):
    df = frame([([3.0, 4.0], [4.0, 3.0])], "a array<double>, b array<double>")
    row = df.select(arrays.overlap(F.col("a"), F.col("b")), arrays.slide(F.col("a"), 1), arrays.add_at(F.col("a"), F.col("b"), 1), arrays.id_ranges(F.lit("1-3,7"))).first()
    assert abs(row[0] - 0.96) < 1e-12 and list(row[1]) == [4.0, 3.0] and list(row[2]) == [3.0, 8.0] and list(row[3]) == [1, 2, 3, 7]


def test_text_sources(spark, tmp_path):
    (tmp_path / "seg.txt").write_text("# start stop\n0 10\n\n20 30 # two\n")
    seg = files.read_segments(spark, str(tmp_path / "seg.txt"))
    assert sorted(tuple(r) for r in seg.collect()) == [(0.0, 10.0), (20.0, 30.0)]
    assert sorted(tuple(r) for r in files.invert_segments(seg, -5.0, 40.0).collect()) == [(-5.0, 0.0), (10.0, 20.0), (30.0, 40.0)]
    (tmp_path / "f.lst").write_text("/x/H-H1-1000-64.gwf\nbad\n")
    assert [tuple(r)[1:] for r in files.read_frame_list(spark, str(tmp_path / "f.lst")).collect()] == [(1000.0, 1064.0)]
    assert "event_start_H1" in files.trigger_schema(["H1", "L1"]).names


def test_stream_keeps_the_loudest(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00.1", 1.0), (2, "2024-01-01 00:00:00.4", 3.0), (3, "2024-01-01 00:00:05", 2.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = online.loudest_of_neighbours(stream, "ts").writeStream.format("memory").queryName("loudest").outputMode("update").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["event_id"] for r in spark.table("loudest").collect()) == [2, 3]
