"""What Python workers keep between tasks, and how many a stage asks for."""

import os
import random
import re

import pyarrow as pa

from chirplake.llm import near_dup, packing
from chirplake.llm.entries import vocabulary
from chirplake.llm.shared import Scratch

from .texts import SCHEMA, documents, words


def held_mb(spark):
    """MB of each idle worker, by process."""

    def run(it):
        for batch in it:
            with open("/proc/self/smaps_rollup") as f:
                mb = int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) >> 10
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()] * batch.num_rows, "mb": [mb] * batch.num_rows})

    rows = spark.range(64, numPartitions=64).mapInArrow(run, "pid long, mb long").collect()
    return {r["pid"]: r["mb"] for r in rows}


def test_workers_give_memory_back(spark, frame):
    rng = random.Random(5)
    many = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(300_000)]
    docs = frame([(i, " ".join(rng.choices(many, k=300))) for i in range(6000)], SCHEMA)
    before = held_mb(spark)
    assert packing.pack(docs.coalesce(1), vocabulary("word_bpe_49k.json")).selectExpr("sum(length)").first()[0] > 6000 * 300
    after = held_mb(spark)
    # a worker that an earlier test has left large may be as large as it was
    assert after and all(mb <= max(200, before.get(pid, 0) + 60) for pid, mb in after.items()), (before, after)


def test_near_duplicates_take_one_worker_a_core(spark, frame, monkeypatch):
    steps = {}

    class Watched(Scratch):
        def write(self, df, name, codec="zstd"):
            plan = df._jdf.queryExecution().executedPlan().toString()
            steps[name] = max(map(len, chains(plan)))
            return super().write(df, name, codec)

    def chains(plan):
        """Python steps above one another without an exchange between them, for each of them."""
        open_at = []
        for line in plan.split("\n"):
            found = re.search(r"[A-Za-z]", line)
            if found:
                open_at = [(at, x) for at, x in open_at if at < found.start()]
                if "Exchange" in line:
                    open_at = []
                elif "MapInArrow" in line:
                    open_at.append((found.start(), line))
            yield open_at

    monkeypatch.setattr(near_dup, "BLOCK", 4)
    rng = random.Random(3)
    base = words(60, rng)
    docs = [*documents(n=12), *[(10_000 + i, " ".join([*base, f"tail{i}"])) for i in range(30)]]
    docs = [(r[0], r[1]) for r in docs]
    out = near_dup.classes(frame(docs, SCHEMA), Watched(spark, "t"))
    assert len({r["component_id"] for r in out.collect() if r["doc_id"] >= 10_000}) == 1
    assert {"likely-0", "links-0", "signed"} <= set(steps) and max(steps.values()) == 1, steps
