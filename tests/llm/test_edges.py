"""Awkward tables for every operator: empty ones, nulls in every column, repeated rows, clashing names, long texts, many spans."""

import hashlib
import time

import numpy as np
import pytest

from chirplake.llm import byte_dedup, decontam, html_main, licenses, near_dup, packing, pii, quality, token_files, toxicity
from chirplake.llm.entries import vocabulary
from chirplake.llm.shared import Scratch, shared_dir

from .test_exact import by_row, cut_by_hand, hit_words, link_components, quality_counts, spans
from .texts import ALNUM, SCHEMA, documents, lowered

#: Names that operators use inside, as columns of the caller's table.
CLASH = {"spans": "x", "bands": "x", "digest": "x", "n_shingles": "x", "found": "x", "words": "x", "marks": "x", "row": "x", "host": "x", "labels": "x", "kept": "x", "rep": "x", "key": "x", "shard": "x", "block": "x", "ids": "x", "text_": "x", "_email": "x", "some": "x", "order": "x", "starts": "x", "base": "x"}


def operators(spark):
    """Each text operator as a function of documents."""
    s = lambda: Scratch(spark, "edges")
    bench = spark.createDataFrame([(1, "one two three"), (None, "x y z"), (2, None)], "item_id long, text string")
    return {
        "op2": lambda d: decontam.find_shared(d, bench),
        "op3": licenses.scan,
        "op4": pii.report,
        "op5": lambda d: token_files.read(*token_files.write(d, s(), vocabulary("byte_bpe_50k.json"))),
        "op6": lambda d: quality.report(d, s()),
        "op7": lambda d: packing.pack(d, vocabulary("word_bpe_49k.json")),
        "op8": lambda d: near_dup.classes(d, s()),
        "op9": lambda d: toxicity.score(d, toxicity.train(d, spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, None)], "doc_id long, quality int, toxic int"))),
        "op10": lambda d: byte_dedup.cut_repeats(d, s()),
    }


NAMES = ["op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, frame, name):
    out = operators(spark)[name](frame([], SCHEMA + ", source string"))
    assert out.count() == 0 and "doc_id" in out.columns


@pytest.mark.parametrize("name", NAMES)
def test_clashing_columns_and_nulls(spark, frame, name):
    """Further columns of any name change nothing; null ids and texts and repeated rows each have their answer."""
    rows = [(1, "one two three four five", "a"), (1, "one two three four five", "a"), (None, "one two three", None), (None, None, None), (2, None, "a"), (3, "", None)]
    plain = frame(rows, SCHEMA + ", source string")
    clash = plain
    for column, value in CLASH.items():
        clash = clash.withColumn(column, __import__("pyspark.sql.functions", fromlist=["lit"]).lit(value))
    run = operators(spark)[name]
    got = run(clash)
    columns = [c for c in got.columns if c != "sequence_id"]
    assert by_row(got, *columns) == by_row(run(plain), *columns)
    if name != "op7":
        assert got.count() == len(rows)


def test_null_ids_have_no_part_in_groups(spark, frame):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, text), (5, text), (7, text), (None, text)]
    got = near_dup.classes(frame(rows, SCHEMA), Scratch(spark, "t"))
    assert by_row(got, "doc_id", "component_id", "kept") == sorted(map(repr, [(None, None, True), (None, None, True), (5, 5, True), (7, 5, False)]))
    cut = {(r["doc_id"], r["n_removed"]) for r in byte_dedup.cut_repeats(frame(rows, SCHEMA), Scratch(spark, "t")).collect()}
    assert cut == {(None, 0), (5, 0), (7, len(text))}


def test_long_texts(spark, frame):
    """A text of a few megabytes among small ones."""
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(5000)])
    long = " ".join(words[rng.integers(0, 5000, 300_000)])
    docs = [(1, long), (2, "short one"), (3, long[:200_000])]
    got = {r["doc_id"]: r["n_removed"] for r in byte_dedup.cut_repeats(frame(docs, SCHEMA), Scratch(spark, "t")).collect()}
    assert got == {1: 0, 2: 0, 3: 200_000}
    near = {r["doc_id"]: r["n_shingles"] for r in near_dup.classes(frame(docs, SCHEMA), Scratch(spark, "t")).collect()}
    v = long.split()
    assert near[1] == len({tuple(v[i : i + 4]) for i in range(len(v) - 3)})
    q = {r["doc_id"]: r["n_words"] for r in quality.report(frame([(*d, "s") for d in docs], SCHEMA + ", source string"), Scratch(spark, "t")).collect()}
    assert q[1] == 300_000


def test_many_spans(frame):
    text = "mail a@b.co and 10.0.0.1, " * 3000
    began = time.time()
    got = pii.report(frame([(1, text)], SCHEMA)).first()
    assert (got["n_email"], got["n_ip"]) == (3000, 3000) and got["base_sha256"] == hashlib.sha256(",".join(spans(text)).encode()).hexdigest()
    assert pii.mask(frame([(1, text)], SCHEMA)).first()["text"] == "mail [EMAIL] and [IP], " * 3000
    assert time.time() - began < 120


def test_full_windows_have_little_padding(frame):
    docs = [(i, " ".join(f"word{(i * j) % 997}." for j in range(5 + i * 7 % 900))) for i in range(300)]
    rows = packing.pack(frame(docs, SCHEMA).coalesce(1), vocabulary("word_bpe_49k.json")).collect()
    used: dict[int, int] = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used.values())
    assert padding < 0.02 * sum(used.values())


def test_pages_of_nothing_and_clashes(spark, frame):
    schema = "page_id long, url string, html string"
    assert html_main.main_text(frame([], schema), Scratch(spark, "t")).count() == 0
    rows = [(1, "http://a.example/x", "<p>one</p>"), (1, "http://a.example/x", "<p>one</p>"), (None, None, "<p>two</p>"), (2, "no url", None)]
    more = frame([(*r, "x", "y", "z") for r in rows], schema + ", row string, host string, blocks string")
    got = html_main.main_text(more, Scratch(spark, "t"))
    assert by_row(got, "page_id", "text", "n_chars") == sorted(map(repr, [(1, "one", 3), (1, "one", 3), (None, "two", 3), (2, "", 0)]))


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        class getConf:  # noqa: N801
            def get(self, key):
                return None

    class Session:
        sparkContext = Context  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda key, other=None: other)

    with pytest.raises(ValueError):
        shared_dir(Session)


def test_scratch_goes(spark, frame):
    scratch = Scratch(spark, "gone")
    scratch.write(frame([(1, "x")], SCHEMA), "a")
    scratch.drop("a")
    path, system = scratch._path("a")
    assert not system.exists(path)


def test_hand_made_answers_agree_on_the_awkward_table(spark, frame):
    """The brute-force versions and the operators on one more seed of awkward documents."""
    docs = documents(seed=9, n=36)
    assert by_row(near_dup.classes(frame(docs, SCHEMA), Scratch(spark, "t")), "doc_id", "component_id") == sorted(repr((i, c)) for i, _, c, _ in link_components(docs, 4, 80))
    assert by_row(byte_dedup.cut_repeats(frame(docs, SCHEMA), Scratch(spark, "t")), "doc_id", "n_removed") == sorted(repr((r[0], r[2])) for r in cut_by_hand(docs))
    items = [(1, docs[0][1]), (2, "ab ab ab"), (3, "ab " * 12)]
    out = decontam.find_shared(frame(docs, SCHEMA), frame(items, "item_id long, text string"))
    assert by_row(out, "doc_id", "n_words", "n_hit") == sorted(repr((i, *hit_words(t, items)[:2])) for i, t in docs)
    q = quality.report(frame([(*d, "s") for d in docs], SCHEMA + ", source string"), Scratch(spark, "t"))
    assert by_row(q, "doc_id", "n_words", "n_repeat_words") == sorted(repr((i, quality_counts(t)[0], quality_counts(t)[4])) for i, t in docs)
    assert by_row(licenses.scan(frame(docs, SCHEMA)), "doc_id", "n_words") == sorted(repr((i, len(ALNUM.findall(lowered(t or ""))))) for i, t in docs)
