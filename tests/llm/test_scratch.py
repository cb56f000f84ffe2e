"""Intermediate tables: what was shuffled for one goes as soon as it is written."""

import time

from chirplake.llm import byte_dedup
from chirplake.llm.shared import SHUFFLES_GO, Scratch

from .test_exact import by_row, cut_by_hand
from .texts import SCHEMA, documents


def shuffled(spark):
    """Names of the shuffle files that lie on this machine's disk."""
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {x for x in names if x.startswith("shuffle_") and x.endswith(".data")}


def test_repeats_keep_no_shuffle_of_an_earlier_step(spark, frame):
    left = {}

    class Watched(Scratch):
        def write(self, df, name, codec="zstd"):
            before, until = shuffled(spark), time.time() + 5
            out = super().write(df, name, codec)
            while (new := shuffled(spark) - before) and time.time() < until:
                time.sleep(0.2)
            left[name] = new
            return out

    docs = documents(n=12)
    was = spark.conf.get(SHUFFLES_GO, None)
    out = byte_dedup.cut_repeats(frame(docs, SCHEMA).repartition(3), Watched(spark, "t"))
    assert left == {"first": set(), "second": set()}
    assert spark.conf.get(SHUFFLES_GO, None) in (was, "false")
    assert by_row(out, "doc_id", "n_removed") == sorted(repr((r[0], r[2])) for r in cut_by_hand(docs))
