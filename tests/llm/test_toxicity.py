"""The classifier chain: held-out documents, and the edges."""

import random

import numpy as np

from chirplake.llm import toxicity

from .texts import SCHEMA, words

LABELS = "doc_id long, quality int, toxic int"


def corpus(n, seed):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        toxic, low = i % 7 == 0, i % 5 == 1
        w = words(rng.randint(20, 60), rng)
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["vilest", "wretch", "grubby" + rng.choice("abcdef")])
        if low:
            w = [x + "###junk" for x in w]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


def test_held_out(spark, frame):
    docs, labels = corpus(1200, 1)
    models = toxicity.train(frame(docs, SCHEMA), frame(labels[:800] + [labels[0], (None, 1, 1), (5000, 1, 1), (900, None, 1)], LABELS))
    got = {r["doc_id"]: r for r in toxicity.score(frame(docs[800:] + [(-1, None), (-2, "")], SCHEMA), models).collect()}
    right = np.mean([got[i]["toxic"] == bool(t) for i, _, t in labels[800:]])
    assert right > 0.98 and np.mean([got[i]["low_quality"] == (q == 0) for i, q, _ in labels[800:]]) > 0.98
    assert not got[-1]["toxic"] and not got[-2]["toxic"] and len(models[1].earlier) == 1
    kept = toxicity.without_toxic(frame([(i, t, "s") for i, t in docs[800:]], SCHEMA + ", kept string"), models)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in range(800, 1200) if not got[i]["toxic"]) and kept.columns == ["doc_id", "text", "kept"]


def test_rare_word_is_learned_from_many_labels(spark, frame):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(12_000):
        rare, toxic = i % 1200 == 7, i % 7 == 0
        docs.append((i, " ".join(words(6, rng) + ["zyxgloat"] * rare + ["vilest"] * toxic)))
        labels.append((i, i % 5 and 1, int(rare or toxic)))
    models = toxicity.train(frame(docs, SCHEMA), frame(labels, LABELS))
    got = {r["doc_id"]: r for r in toxicity.score(frame([(-1, "zyxgloat"), (-2, "")], SCHEMA), models).collect()}
    assert got[-1]["p_toxic"] > got[-2]["p_toxic"]  # 10 documents of 12,000: too few of them are in a smaller sample


def test_no_labels(spark, frame):
    docs, labels = corpus(20, 2)
    for some in ([], [(i, 1, 0) for i in range(20)]):
        models = toxicity.train(frame(docs, SCHEMA), frame(some, LABELS))
        assert not any(r["toxic"] for r in toxicity.score(frame(docs, SCHEMA), models).collect())


def test_threshold():
    assert 0.4 < toxicity.best_threshold(np.array([0.9, 0.8, 0.3, 0.1]), np.array([1, 1, 0, 0])) < 0.7
    assert toxicity.best_threshold(np.array([0.9]), np.array([1])) == 1.0
