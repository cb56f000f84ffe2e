"""The catalogue door: creation, ingest order, metadata, SQL, live time, several runs."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from chirplake.operators import catalog, reports, selection
from chirplake.sources import files, params, store

ROWS = "id string, job_id int, lag_idx int, trial_idx int, rho double"


@pytest.fixture
def made(spark, frame, tmp_path):
    jobs = frame([(1, [0.0, 0.0], 2, 0.0, 100.0, ['{"hrss": 1}', '{"hrss": 2}']), (2, [0.0, 3.0], 1, 100.0, 150.0, [])], store.JOBS)
    return store.Catalogue.create(spark, str(tmp_path / "cat"), frame([], ROWS).schema, {"rate": 4}, jobs)


def test_validation(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.Catalogue.open(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        store.validate(spark, str(tmp_path / "empty"))


def test_appends_and_last_rows(spark, frame, made):
    assert made.total() == 0 and made.columns() == ["id", "job_id", "lag_idx", "trial_idx", "rho"]
    made.append(frame([("a", 1, 0, 0, 1.0), ("a", 1, 0, 0, 2.0), ("a", 1, 1, 0, 3.0), ("b", 2, 0, 0, 4.0)], ROWS).coalesce(1))
    made.append(frame([("b", 2, 0, 0, 5.0)], ROWS))
    again = store.Catalogue.open(spark, made.path)
    # inside one append the later row counts, and a later append above it; other lags stay
    assert sorted(r["rho"] for r in again.triggers().collect()) == [2.0, 3.0, 5.0]
    assert again.total() == 5 and again.triggers(deduplicate=False).count() == 5
    assert [r["id"] for r in again.of_jobs(frame([(2,), (2,)], "job_id int"), F.col("rho") > 4).collect()] == ["b"]
    assert store.rows_of(spark, made.path).count() == 3


def test_order_is_total(frame):
    rows = [("a", 1, None, 1.0), ("a", 1, 5, 2.0), ("a", 1, 5, 3.0), ("b", 1, None, None)]
    got = {r["id"]: r["rho"] for r in catalog.keep_last(frame(rows, "id string, job_id int, _seq long, rho double")).collect()}
    other = {r["id"]: r["rho"] for r in catalog.keep_last(frame(rows[::-1], "id string, job_id int, _seq long, rho double")).collect()}
    assert got == other and got["a"] in (2.0, 3.0) and got["b"] is None


def test_metadata_and_live_time(frame, made):
    assert made.metadata() == {"version": "1", "config": {"rate": 4}}
    assert sorted(r["injection"] for r in made.injections().collect()) == ['{"hrss": 1}', '{"hrss": 2}']
    assert [r["job_id"] for r in made.unshifted().collect()] == [1]
    # without progress: two lags of 100 s and one of 50 s
    assert made.live_time().first()["livetime"] == 250.0
    assert made.live_time(F.col("job_id") == 1).first()["livetime"] == 200.0
    made.append_progress(frame([(1, 0, 0, 3, 60.0, 1.0, "completed"), (1, 0, 1, 0, 99.0, 1.0, "skipped_segTHR")], files.PROGRESS))
    assert made.live_time().first()["livetime"] == 60.0


def test_sql(frame, made):
    made.append(frame([("a", 1, 0, 0, 1.0), ("b", 1, 0, 0, 7.0), ("c", 2, 0, 0, 4.0)], ROWS))
    got = made.query("SELECT id, rho::INT AS r FROM triggers t QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rho DESC) = 1 ORDER BY id")
    assert got.columns == ["id", "r"] and [tuple(r) for r in got.collect()] == [("b", 7), ("c", 4)]
    assert made.query("SELECT 'FROM triggers; QUALIFY' AS x, count(*) AS n FROM triggers;").first()["x"] == "FROM triggers; QUALIFY"
    assert made.query("SELECT a.id FROM triggers a JOIN triggers b ON a.job_id = b.job_id AND a.rho < b.rho").first()["id"] == "a"


def test_json_catalogue(spark, tmp_path):
    rows = [{"id": "a", "job_id": 1, "rho": 1.0}, {"id": "b", "job_id": 1, "rho": 5.0}, {"id": "a", "job_id": 1, "rho": 2.0}]
    with gzip.open(tmp_path / "c.json.gz", "wt") as f:
        json.dump({"version": "x", "triggers": rows}, f)
    got = store.from_json(spark, str(tmp_path / "c.json.gz"))
    assert sorted((r["id"], r["rho"]) for r in got.collect()) == [("a", 2.0), ("b", 5.0)]
    assert store.query(spark, "SELECT max(rho) AS m FROM triggers", triggers=got).first()["m"] == 5.0


def test_runs(spark, frame, made, tmp_path):
    made.append(frame([("a", 1, 0, 0, 1.0)], ROWS))
    other = store.Catalogue.create(spark, str(tmp_path / "other"), frame([], "id string, job_id int, extra int").schema, {})
    other.append(frame([("z", 9, 3)], "id string, job_id int, extra int"))
    rows, injections = store.runs({"one": made, "two": other})
    assert sorted((r["run_index"], r["run_name"], r["id"], r["extra"]) for r in rows.collect()) == [(0, "one", "a", None), (1, "two", "z", 3)]
    assert injections.count() == 2 and set(injections.columns) == {"job_id", "injection", "run_index", "run_name"}
    with pytest.raises(ValueError):
        store.runs({})


def test_parameters(frame):
    rows = [('{"a": 1, "b": true, "c": "x", "d": 1.5, "e": [1, 2], "m": 1}',), ('{"a": 2, "d": 2, "m": "y"}',), ("broken",), (None,)]
    df = frame(rows, "p string")
    types = params.inferred(df, "p")
    assert types == {"a": "bigint", "b": "boolean", "c": "string", "d": "double", "e": "array<double>", "m": "string"}
    assert [(r["a"], r["d"]) for r in params.flat(df, "p", types).collect()] == [(1, 1.5), (2, 2.0), (None, None), (None, None)]
    assert {r["key"]: r["n"] for r in params.keys(df, "p", ["e"]).collect()} == {"a": 2, "b": 1, "c": 1, "d": 2, "m": 2}
    assert [str(r[0]) for r in df.select(F.to_json(params.parsed("p"))).collect()][2:] == ["{}", "{}"]
    with pytest.raises(ValueError):
        params.flat(df, "p", {"p": "int"})


def test_splits_by_fraction(frame, tmp_path, spark):
    # the jobs of the hand-made case: 110 s each, halves; all jobs, disjoint, both there
    jobs = frame([(i, 110.0) for i in range(1, 5)], "job_id int, livetime double")
    got = selection.split_table(jobs, {"a": 0.5, "b": 0.5}, ["job_id"], seed=1).collect()
    assert sorted(r["job_id"] for r in got) == [1, 2, 3, 4] and sorted(r["split"] for r in got) == ["a", "a", "b", "b"]
    partial = selection.split_table(frame([(i, 1.0) for i in range(100)], "job_id int, livetime double"), {"a": 0.1, "b": 0.25}, ["job_id"]).groupBy("split").count()
    assert {r["split"]: r["count"] for r in partial.collect()} == {"a": 10, "b": 25}
    rows = frame([(1, 0.5), (2, 0.7), (9, 0.1)], "job_id int, rho double")
    selection.write_splits(rows, {"some": frame([(1,), (2,)], "job_id int"), "none": frame([(77,)], "job_id int")}, "job_id", str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s" / "split=some")).count() == 2
    empty = spark.read.parquet(str(tmp_path / "s" / "split=none"))
    assert empty.count() == 0 and empty.columns == ["job_id", "rho"]


def test_reports(frame, tmp_path, spark):
    rows = frame([(i, float(i)) for i in range(100)], "id long, rho double")
    out = reports.background_report(rows, "rho", catalog.YEAR, 0.0, 10.0, 10, top=3, zero_lag=frame([(1000, 95.0)], "id long, rho double"))
    assert [(r["id"], r["rank"], r["far"]) for r in out["loudest"].orderBy("rank").collect()] == [(99, 1, 1.0), (98, 2, 2.0), (97, 3, 3.0)]
    assert out["zero_lag"].first()["far"] == 10.0  # ten events in its bin and above, in one year
    reports.write_csv(out["loudest"], str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
    zero = reports.zero_lag_report(frame([(1, 99.0), (2, 50.0)], "id long, rho double"), rows, "rho", catalog.YEAR, catalog.YEAR)
    assert {r["id"]: r["n_above"] for r in zero["events"].collect()} == {1: 1, 2: 50}
    counts = [r["n_above"] for r in zero["counts"].orderBy("ifar").collect()]
    assert counts[0] == 2 and counts[-1] == 1
    # quantiles of a Poisson count of mean 4, by hand: P(0) = 0.0183, P(<=2) = 0.238, P(<=6) = 0.889, P(<=9) = 0.9919
    bands = next(reports._ppf([0.01, 0.2, 0.88, 0.99])(iter([__import__("pandas").DataFrame({"ifar": [1.0], "mu": [4.0]})])))
    assert bands["bands"][0].tolist() == [0.0, 2.0, 6.0, 9.0]
    assert reports.ifar_threshold(rows, "rho", 100.0, 20.0) == 95.0 and reports.ifar_threshold(rows, "rho", 100.0, 1000.0) > 99.0
    sims = frame([("w", h, x) for h in (1.0, 10.0, 100.0) for x in ([None, 1.0] if h == 1.0 else [1.0, 9.0] if h == 10.0 else [9.0, 9.0])], "name string, hrss double, rho double")
    got = {r["ifar"]: r["hrss50"] for r in reports.hrss50_by_ifar(sims, "rho", {"low": 0.5, "high": 5.0}).collect()}
    assert got["low"] == 1.0 and got["high"] == 10.0


def test_command_line(spark, frame, made, tmp_path, capsys):
    from chirplake.__main__ import main

    made.append(frame([("a", 1, 0, 0, 1.0), ("b", 2, 0, 0, 7.0)], ROWS))
    made.append_progress(frame([(1, 0, 0, 3, 60.0, 1.0, "completed")], files.PROGRESS))
    main(["query", made.path, "SELECT count(*) AS n_rows FROM triggers"], spark)
    main(["progress", made.path], spark)
    shown = capsys.readouterr().out
    assert "n_rows" in shown and "|2     |" in shown and "60.0" in shown
    frame([(1, 2.0)], "a int, b double").write.parquet(str(tmp_path / "f1"))
    frame([(2,)], "a int").write.parquet(str(tmp_path / "f2"))
    main(["merge", str(tmp_path / "f1"), str(tmp_path / "f2"), "--out", str(tmp_path / "all")], spark)
    assert spark.read.parquet(str(tmp_path / "all")).count() == 2


def test_a_filter_never_brings_back_what_was_replaced(frame, made, monkeypatch):
    made.append(frame([("a", 1, 0, 0, 9.0), ("b", 2, 0, 0, 8.0)], ROWS))
    made.append(frame([("a", 1, 0, 0, 2.0)], ROWS))
    ids = frame([(1,), (2,)], "job_id int")
    for pushed in (1000, 1):  # as a filter of the scan, and as a join
        monkeypatch.setattr(store, "PUSHED", pushed)
        assert [r["id"] for r in made.of_jobs(ids, F.col("rho") > 5).collect()] == ["b"]
        assert sorted((r["id"], r["rho"]) for r in made.of_jobs(ids).collect()) == [("a", 2.0), ("b", 8.0)]


def metrics(df, names):
    """Sums of the scan's metrics of a finished plan."""
    df.collect()
    out, todo = dict.fromkeys(names, 0), [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        for n in names:
            if "Scan" in node.nodeName() and node.metrics().contains(n):
                out[n] += node.metrics().apply(n).value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_clustering_lets_a_scan_skip(spark, frame, made):
    """The rows of few jobs are read from few row groups of the clustered files; the answer stays."""
    rows = spark.range(60_000).select(F.concat(F.lit("t"), "id").alias("id"), (F.pmod(F.xxhash64("id"), F.lit(3000))).cast("int").alias("job_id"), F.lit(0).alias("lag_idx"), F.lit(0).alias("trial_idx"), F.rand(1).alias("rho"))
    made.append(rows.repartition(6))
    sorted_by_job = made.cluster(files=12)
    ids = frame([(17,), (1400,)], "job_id int")
    plain, quick = made.of_jobs(ids), sorted_by_job.of_jobs(ids)
    key = lambda df: sorted((r["id"], r["job_id"], r["rho"]) for r in df.collect())
    assert key(plain) == key(quick) and len(key(quick)) > 10
    read = [metrics(x, ["numOutputRows"])["numOutputRows"] for x in (made.of_jobs(ids), sorted_by_job.of_jobs(ids))]
    assert read[0] >= 60_000 and read[1] < 20_000
    assert sorted_by_job.jobs().count() == made.jobs().count() and sorted_by_job.metadata() == made.metadata()


def test_sql_names_its_relations_anywhere(spark, frame, made):
    made.append(frame([("a", 1, 0, 0, 1.0), ("b", 2, 0, 0, 7.0)], ROWS))
    other = frame([(1, "x")], "job_id int, label string")
    assert made.query("SELECT id, label FROM jobs, triggers WHERE jobs.job_id = triggers.job_id", jobs=other).first()["label"] == "x"
    assert made.query('SELECT max("rho") AS m FROM "triggers"').first()["m"] == 7.0
    assert made.query("WITH big AS (SELECT * FROM triggers WHERE rho > 2) SELECT id FROM big").first()["id"] == "b"
    assert made.query("SELECT (SELECT count(*) FROM triggers) AS n").first()["n"] == 2
    for sql in ("WITH x AS (SELECT * FROM triggers QUALIFY row_number() OVER (ORDER BY rho) = 1) SELECT * FROM x", "SELECT * FROM (SELECT * FROM triggers QUALIFY row_number() OVER (ORDER BY rho) = 1)", "SELECT id FROM triggers UNION SELECT id FROM triggers QUALIFY row_number() OVER (ORDER BY id) = 1"):
        with pytest.raises(ValueError, match="QUALIFY"):
            made.query(sql)
