"""The best documents against scores of all of them."""

import math
import random
import re
from collections import Counter

import pytest

from chirplake.llm import ranked_search
from chirplake.llm.shared import Scratch

from .texts import SCHEMA, lowered

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def by_hand(queries, docs, top=10):
    terms = [(i, TERM.findall(lowered(t or ""))) for i, t in docs]
    held = [(i, Counter(w), len(w)) for i, w in terms if w]
    n_docs, total, df = len(held), sum(n for *_, n in held), Counter()
    for _, c, _ in held:
        df.update(c.keys())
    wanted, out = {}, []
    for item, text in queries:
        if item is not None:
            wanted.setdefault(item, Counter()).update(TERM.findall(lowered(text or "")))
    for item, asked in wanted.items():
        scored = []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // total
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items() if c[t])
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out)


def found(spark, frame, queries, docs, **more):
    d = frame(docs, SCHEMA).repartition(5).selectExpr("*", "'x' AS row", "1 AS n", "'t' AS terms")
    q = frame(queries, "item_id long, text string").selectExpr("*", "'x' AS q", "1 AS term")
    return sorted(tuple(r) for r in ranked_search.search(q, d, Scratch(spark, "ranked"), **more).collect())


def collection(seed, n=300):
    """Words of very different frequency; lengths from one to hundreds; copies."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}é"
    docs = [(i * 2, " ".join(word() for _ in range(rng.choice([1, 5, 30, 300])))) for i in range(n)]
    docs += [(i * 2 + 1, docs[rng.randrange(n)][1].upper()) for i in range(n // 3)]
    queries = [(j, " ".join(word() for _ in range(rng.choice([1, 3, 40])))) for j in range(12)]
    return queries, docs


@pytest.mark.parametrize("seed", range(3))
def test_equals_scores_of_all(spark, frame, seed):
    queries, docs = collection(seed)
    assert found(spark, frame, queries, docs) == by_hand(queries, docs)


def test_small_slices_and_parts_of_lists(spark, frame, monkeypatch):
    queries, docs = collection(9, 120)
    for name, value in (("SLICE_BYTES", 600), ("PART", 16), ("TEXT_BYTES", 40), ("LOOKUPS", 50)):
        monkeypatch.setattr(ranked_search, name, value)
    assert found(spark, frame, queries, docs) == by_hand(queries, docs)


def test_awkward_rows(spark, frame):
    """Nulls, repeated rows and ids, empty texts, a query without a match, fewer documents than asked for."""
    docs = [(1, "b a"), (1, "b a"), (None, "b a c"), (2, None), (3, ""), (4, "--"), (5, "B-b, 7"), (6, "zzz " * 3000), (7, "q")]
    queries = [(1, "a b"), (2, None), (3, "nothing here"), (None, "a"), (4, "7 7 b"), (5, "a"), (5, "zzz"), (6, "--")]
    assert found(spark, frame, queries, docs) == by_hand(queries, docs)
    assert found(spark, frame, queries, []) == [] == found(spark, frame, [], docs)


def test_ties_go_by_id(spark, frame):
    docs = [(i, "same words here") for i in range(400)] + [(1000 + i, "other") for i in range(400)]
    assert found(spark, frame, [(1, "words")], docs) == by_hand([(1, "words")], docs)
    assert [r[2] for r in found(spark, frame, [(1, "words")], docs, top=25)] == list(range(25))
