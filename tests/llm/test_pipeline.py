"""The pipeline's stages, each on all that the one before kept, against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from chirplake.llm import toxicity
from chirplake.llm.entries import vocabulary

from .test_exact import hit_words, link_components
from .texts import SCHEMA, words

COLUMNS = SCHEMA + ", lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, docs, labels = random.Random(7), [], []
    base = words(60, rng)
    item = words(14, rng, "mnopqr")
    for i in range(300):
        w = words(rng.randint(20, 60), rng)
        if i % 7 == 0:
            w[3:6] = ["vilest", "wretch", "grubby"]
        if i % 30 == 1:
            w = [*base, f"tail{i}"]
        if i % 41 == 2:
            w[5:5] = item
        if i % 11 == 3:
            w[8:8] = ["write", "me@example.org", "now"]
        docs.append((i, " ".join(w), "en", f"s{i % 3}", len(" ".join(w))))
        if i < 200:
            labels.append((i, 1, int(i % 7 == 0)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (1002, "two words", None, None, 9)]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, docs


def test_stages(spark, tables, tmp_path):
    d, docs = tables
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns, text = now.columns, {r[0]: r[1] for r in docs}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        came = {r["doc_id"]: r["text"] for r in now.collect()}
        stage(spark, now, d).write.parquet(f"{tmp_path}/{i}")
        now = spark.read.parquet(f"{tmp_path}/{i}")
        if name == "packing":
            break
        left = {r["doc_id"]: r["text"] for r in now.collect()}
        assert now.columns == columns
        if name == "toxicity":
            models = toxicity.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
            kept = {r["doc_id"] for r in toxicity.score(spark.read.parquet(f"{d}/documents.parquet"), models).collect() if r["kept"]}
            assert set(left) == kept and all(("vilest" in (text[k] or "")) != (k in kept) for k in text)
        elif name == "near_duplicates":
            assert set(left) == {k for k, _, _, first in link_components(list(came.items()), 5, 80) if first}
            assert sum(k % 30 == 1 for k in left if k < 300) == 1
        elif name == "decontamination":
            item = [(1, spark.read.parquet(f"{d}/benchmark.parquet").where("item_id = 1").first()["text"])]
            assert set(left) == {k for k, t in came.items() if not hit_words(t, item)[1]} and set(left) < set(came)
        else:
            assert left == {k: t if t is None else re.sub(r"me@example\.org", "[EMAIL]", t) for k, t in came.items()}
            assert sum("[EMAIL]" in (t or "") for t in left.values()) > 5
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in now.collect())
    model = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    pieces = collections.defaultdict(list)
    for r in now.collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert set(pieces) == set(came)
    for k, own in pieces.items():
        ids, at = [*model.encode(came[k] or "", add_special_tokens=False).ids, 1], 0
        for start, length, crc, total in sorted(own):
            assert start == at and total == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    whole = corpus_pipeline.run(spark, d)
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in whole.collect()) == sorted((k, s, c) for k, own in pieces.items() for s, _, c, _ in own)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_and_further_columns(spark, tables, tmp_path):
    """A row that is there twice is one document after the near-duplicate stage; further columns stay."""
    d, docs = tables
    rows = spark.createDataFrame([docs[3], docs[3], docs[5], (None, "a null id stays", "en", "s", 15)], COLUMNS).selectExpr("*", "'x' AS spans", "'y' AS kept")
    out = corpus_pipeline.STAGES[1][1](spark, rows, d)
    assert sorted(map(str, [r["doc_id"] for r in out.collect()])) == ["3", "5", "None"] and out.columns == rows.columns
