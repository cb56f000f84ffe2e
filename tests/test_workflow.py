"""Workflow steps, cuts and draws."""

import math

import pytest
from pyspark.sql import functions as F

from chirplake.operators import cuts, sky
from chirplake.plans import workflow


def test_steps_run_in_order(frame):
    @workflow.action("rows", outputs=("df",))
    def rows(n):
        return frame([(i,) for i in range(n)], "x int")

    @workflow.action("keep")
    def keep(df, cut):
        return cuts.all_cuts(df, [cut])

    flow = workflow.Workflow([{"action": "rows", "id": "a", "args": {"n": "@sizes.0"}}, {"action": "keep", "id": "b", "args": {"df": "@a", "cut": "x >= ${least}"}}], {"sizes": [5], "least": 3})
    assert flow.run()["b"].count() == 2
    assert flow.edges() == [("sizes", "a"), ("a", "b"), ("least", "b")]
    with pytest.raises(KeyError):
        workflow.Workflow([{"action": "nothing"}]).run()


def test_cut_text_is_not_python():
    with pytest.raises(ValueError):
        cuts.from_text("__import__('os')")


def test_draws(spark, frame):
    ids = spark.range(500).withColumnRenamed("id", "i")
    inside = sky.patch(ids, "i", 1.0, 0.3, 0.2).select(F.acos(F.sin("dec") * math.sin(0.3) + F.cos("dec") * math.cos(0.3) * F.cos(F.col("ra") - 1.0)).alias("d"))
    assert inside.agg(F.max("d")).first()[0] <= 0.2 + 1e-9
    pixels = frame([(1.0, 0.0, 0.0), (2.0, 0.1, 3.0)], "ra double, dec double, value double")
    assert {r["ra"] for r in sky.weighted(ids, "i", pixels).select("ra").distinct().collect()} == {2.0}
    assert sky.all_sky(ids, "i").where("ra < 0 or ra >= 6.2831854 or abs(dec) > 1.5707964").count() == 0


def test_results_have_names(tmp_path):
    @workflow.action("pair")
    def pair(a, path=None):
        return [a, path]

    @workflow.action("sizes")
    def sizes():
        return {"n": 3, "more": {"x": [7]}}

    config = {
        "vars": {"base": "b", "twice": "${base}${base}"},
        "runtime": {"tmp_dir": str(tmp_path / "t"), "cleanup_tmp": "on_success"},
        "steps": [
            {"action": "sizes"},
            {"action": "pair", "output_alias": ["first", "second"], "args": {"a": "@more.x.0", "path": "tmp://out/${base}.parquet"}},
            {"action": "pair", "output_alias": "both", "inputs": {"a": "${n}"}},
            {"action": "json.dumps", "id": "text", "args": {"obj": "@both"}},
            {"action": "sizes", "id": "s", "outputs": {"seven": "more.x.0"}},
        ],
    }
    got = workflow.Workflow.of(config).run()
    assert (got["n"], got["first"], got["second"], got["both"], got["text"], got["seven"]) == (3, 7, f"{tmp_path}/t/out/b.parquet", [3, None], "[3, null]", 7)
    assert not (tmp_path / "t").exists()
    with pytest.raises(KeyError):
        workflow.Workflow.of({"steps": [{"action": "pair", "args": {"a": "@no.where"}}]}).run()
    with pytest.raises(ValueError):
        workflow.Workflow.of({"steps": [{"action": "pair", "args": {"a": 1}, "output_alias": ["only"]}]}).run()


def test_workflow_files(tmp_path):
    (tmp_path / "w.json").write_text('{"vars": {"x": 2}, "steps": [{"action": "json.dumps", "id": "t", "args": {"obj": "@x"}}]}')
    assert workflow.Workflow.read(str(tmp_path / "w.json")).run()["t"] == "2"
