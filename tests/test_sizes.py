"""Steps that must not grow faster than their input: no pairs of close rows, no task or driver that gets all rows."""

import random

import pytest
from pyspark.sql import functions as F

from chirplake.functions import geo
from chirplake.operators import bootstrap, injections, isolation, kernels, matching, ranks
from chirplake.plans import search


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_arrivals_are_not_broadcast(frame):
    points = frame([(i,) for i in range(50)], "i long")
    out = injections.in_intervals_poisson(points, 0.1, frame([(1, 0.0, 500.0), (2, 500.0, 900.0)], "interval_id long, start double, end double"), "i", 50)
    assert "SortMergeJoin" in plan(out)
    assert sorted(r["i"] for r in out.collect()) == list(range(50))


def test_scheduled_events_may_have_gaps_in_their_ids(spark, frame, tmp_path):
    spark.sql("SELECT 1000 * id AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, id AS user_id, 'view' AS event_type, 1.0D AS value, '{\"k\": 1}' AS props FROM range(40)").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(5).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    assert sorted(r["id"] for r in search.QUERIES["poisson_schedule"](spark, str(tmp_path)).collect()) == [1000 * i for i in range(40)]


def test_rows_of_one_file_are_drawn_in_many_tasks(frame):
    rows = frame([("a", i, 1.0 * i) for i in range(20)], "g string, id long, v double").coalesce(1)
    assert "REPARTITION_BY_NUM" in plan(bootstrap.replicates(rows, ["g"], "id", "v", 5))


def test_a_cluster_without_likelihood_has_no_centre(frame):
    rows = frame([(1, 0, 5, 5, 0.0), (1, 0, 6, 5, 0.0), (1, 1, 50, 60, 2.0)], "job_id int, cluster_id long, freq int, time int, likelihood double")
    got = {r["cluster_id"]: r for r in kernels.cluster_statistics(rows, ["job_id"]).collect()}
    assert got[0]["size"] == 2 and got[0]["likelihood"] == 0 and got[0]["time"] != got[0]["time"]
    assert (got[1]["time"], got[1]["freq"]) == (60.0, 50.0)


@pytest.mark.parametrize("keyed", [True, False])
def test_matches_without_pairs(frame, monkeypatch, keyed):
    rng = random.Random(7)
    louds = [None, 1.0, 2.0, 3.0, 3.5, -1.0]
    at = lambda: rng.randrange(4000) / 4
    t = frame([(i, i % 2, g := at(), rng.choice(louds), g - rng.randrange(5), g + rng.randrange(40)) for i in range(400)], "id long, trial_idx int, gps_time double, rho double, event_start_a double, event_stop_a double")
    s = frame([(i, i % 2, g := at(), g - rng.randrange(30), g + rng.randrange(30)) for i in range(150)], "sim_idx long, trial_idx int, gps_time double, real_start double, real_end double")
    if not keyed:
        t, s = t.drop("trial_idx"), s.drop("trial_idx")
    want = sorted(map(str, matching.resolve(matching.overlapping(t, s, 0.5, 20.0)).collect()))
    monkeypatch.setattr(matching, "overlapping", None)
    monkeypatch.setattr(matching, "STEP", 500)
    assert sorted(map(str, matching.match(t, s, "inner", 0.5, 20.0).collect())) == want and want


def test_nearest_without_pairs(frame):
    rng = random.Random(3)
    points = [(i, rng.randrange(800) / 2) for i in range(100)] + [(100, None), (101, 5000.0)]
    events = [(i, rng.randrange(200) * 2.0) for i in range(150)] + [(200, None)]
    out = matching.nearest(frame(points, "id long, t double"), frame(events, "e long, t double"), 3.0, "t", "t", "e", "id")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # the points again
    want = {}
    for i, t in points:
        near = [(abs(u - t), e) for e, u in events if t is not None and u is not None and abs(u - t) <= 3.0]
        if near:
            want[i] = min(near)
    assert {r["id"]: (r["dt"], r["nearest_id"]) for r in out.collect()} == want


@pytest.mark.parametrize(("crowd", "group"), [(100_000, 256), (20, 3)])
@pytest.mark.parametrize(("window", "degrees"), [(9.0, 20.0), (0.3, 1.0), (40.0, 200.0), (9.0, 0.0)])
def test_close_pairs_of_odd_directions(frame, monkeypatch, crowd, group, window, degrees):
    rng = random.Random(5)
    odd = [0.0, 20.0, 180.0, -30.0, 400.0, 1e9, float("nan"), float("inf"), None]
    angle = lambda top: rng.choice(odd) if rng.random() < 0.2 else float(rng.randrange(0, top, 5))
    time = lambda: rng.choice([None, float("nan"), float("inf"), -float("inf"), 1e300]) if rng.random() < 0.03 else rng.randrange(-150, 150) / 3
    df = frame([(None if rng.random() < 0.03 else rng.randrange(250), time(), angle(180), angle(360)) for i in range(300)], "id long, gps double, theta double, phi double")
    a, b = (df.select(*[F.col(c).alias(f"{c}_{side}") for c in df.columns]) for side in "ab")
    later = (F.col("gps_b") > F.col("gps_a")) | ((F.col("gps_b") == F.col("gps_a")) & (F.col("id_b") > F.col("id_a")))
    close = geo.separation(*[F.col(c) for c in ("theta_a", "phi_a", "theta_b", "phi_b")]) < degrees
    want = a.crossJoin(b).where(later & (F.col("gps_b") - F.col("gps_a") < window) & close).select("id_a", "id_b", F.col("gps_b") - F.col("gps_a"))
    monkeypatch.setattr(matching, "CROWD", crowd)
    monkeypatch.setattr(matching, "GROUP", group)
    got = sorted(map(tuple, matching.close_pairs(df, window, degrees).collect()), key=str)
    assert got == sorted(map(tuple, want.collect()), key=str) and (got or not degrees)


def test_rows_of_one_time_are_not_all_paired(spark):
    df = spark.range(3000).select("id", (F.col("id") % 7).cast("double").alias("gps"), F.degrees(F.acos(F.rand(1) * 2 - 1)).alias("theta"), (F.rand(2) * 360).alias("phi"))
    looked = matching.close_groups(df, 10.0, 20.0).agg(F.sum(F.size("a").cast("long") * F.size("b"))).first()[0]
    pairs = matching.close_pairs(df, 10.0, 20.0).count()
    assert 100_000 < pairs < looked < 1_200_000  # of 9,000,000 of a cell of time


def test_rows_alike_are_paired_as_one_kind(spark):
    df = spark.range(1800).select("id", (F.col("id") % 3).cast("double").alias("gps"), (F.col("id") % 9 * 21).cast("double").alias("theta"), F.lit(0.0).alias("phi"))
    groups = matching.close_groups(df, 10.0, 20.0)
    assert groups.agg(F.sum(F.size("a").cast("long") * F.size("b"))).first()[0] < 1000  # pairs of rows: 360,000
    assert groups.agg(F.max(F.aggregate("a", F.lit(0), lambda n, kind: n + F.size(kind["ids"])))).first()[0] <= matching.GROUP
    rows, found = df.collect(), matching.close_pairs(df, 10.0, 20.0)
    near = lambda a, b: a["theta"] == b["theta"] and (a["gps"], a["id"]) < (b["gps"], b["id"])
    assert sorted((r["id_a"], r["id_b"]) for r in found.collect()) == sorted((a["id"], b["id"]) for a in rows for b in rows if near(a, b))


def test_pairs_have_tasks_by_their_rows(spark, monkeypatch):
    df = spark.range(900).select("id", F.col("id").cast("double").alias("gps"), F.lit(0.0).alias("theta"), F.lit(0.0).alias("phi"))
    monkeypatch.setattr(matching, "SHARE", 100, raising=False)
    assert "hashpartitioning(_cell" in (text := plan(matching.close_groups(df, 10.0, 20.0))) and ", 18), REPARTITION_BY_NUM" in text


@pytest.mark.parametrize("few", [0, 10_000])
def test_ranks_with_and_without_a_broadcast(frame, monkeypatch, few):
    assert ranks.FEW == 10_000
    monkeypatch.setattr(ranks, "FEW", few)
    rows = frame([(g, float(v * 7 % 100)) for g in "ab" for v in range(100)], "g string, v double")
    got = ranks.largest(rows, ["g"], "v", frame([("a", 1), ("a", 30), ("b", 100)], "g string, k long"))
    assert sorted((r["g"], r["k"], r["found"]) for r in got.collect()) == [("a", 1, 99.0), ("a", 30, 70.0), ("b", 100, 0.0)]


def test_inliers_are_looked_up_from_both_ends(frame):
    out = isolation.nearest_inliers(frame([(i, i % 5 != 2) for i in range(9000)], "id long, outlier boolean"), [], "id")
    assert "unboundedfollowing" not in plan(out).lower()
    got = {r["id"]: r["taken"] for r in out.where(F.col("id").isin(0, 2, 4, 5, 8999)).collect()}
    assert got == {0: 2, 2: 2, 4: 2, 5: 7, 8999: 8997}
