"""Isolation trees against a grower by hand with the same cuts; replaced rows against a search by hand."""

import hashlib
import math
import random

from chirplake.operators import isolation


def drawn(*parts):
    return int(hashlib.md5("_".join(map(str, parts)).encode()).hexdigest()[:13], 16) / (1 << 52)


def grown_by_hand(rows, tree, node, top, seed, out):
    """Nodes below one node, recursively; each row is a list of features."""
    some = [i for i in range(len(rows[0])) if max(r[i] for r in rows) > min(r[i] for r in rows)] if rows else []
    if node >= 1 << top or not some:
        out[tree, node] = (len(rows), None, None)
        return
    i = some[math.floor(drawn(seed, tree, node, "feature") * len(some))]
    lo, hi = min(r[i] for r in rows), max(r[i] for r in rows)
    cut = lo + (hi - lo) * drawn(seed, tree, node, "cut")
    out[tree, node] = (len(rows), i, cut)
    for side, part in enumerate(([r for r in rows if r[i] <= cut], [r for r in rows if r[i] > cut])):
        if part:
            grown_by_hand(part, tree, 2 * node + side, top, seed, out)


def depth_by_hand(forest, trees, row):
    total = 0
    for tree in range(trees):
        node = 1
        while (tree, node) in forest and forest[tree, node][1] is not None:
            _, i, cut = forest[tree, node]
            node = 2 * node + (row[i] > cut)
        n = forest[tree, node][0] if (tree, node) in forest else 0
        total += isolation.UNIT * (node.bit_length() - 1) + round(isolation.UNIT * isolation.left_over(n))
    return total


def test_forest_depths_and_flags(frame):
    rng, trees, size, seed = random.Random(1), 7, 32, 3
    rows = [(i, rng.gauss(0, 1), float(rng.randint(0, 3))) for i in range(150)] + [(150, 40.0, 3.0), (151, 0.1, 1.0), (152, 0.1, 1.0), (153, None, 1.0), (154, float("nan"), 2.0)]
    df = frame(rows, "id long, x double, y double")
    clean = [r for r in rows if r[1] is not None and not math.isnan(r[1])]
    want = {}
    for tree in range(trees):
        part = sorted(clean, key=lambda r: (drawn(seed, tree, r[0]), str(r[0])))[:size]
        grown_by_hand([r[1:] for r in part], tree, 1, isolation.height(size), seed, want)
    forest = isolation.grown(isolation.samples(df, "id", ["x", "y"], trees, size, seed), 2, size, seed)
    assert {(r["tree"], r["node"]): (r["n"], r["feature"], r["cut"]) for r in forest.collect()} == want
    got = {r["id"]: r for r in isolation.outliers(df, "id", ["x", "y"], 0.15, trees, size, seed).collect()}
    hand = {r[0]: depth_by_hand(want, trees, r[1:]) for r in clean}
    assert {i: r["depth"] for i, r in got.items()} == hand | {153: None, 154: None}
    edge = sorted(hand.values())[math.ceil((len(hand) - 1) * 0.15)]
    middle = [(sorted(r[k] for r in clean)[(len(clean) - 1) // 2] + sorted(r[k] for r in clean)[len(clean) // 2]) / 2 for k in (1, 2)]
    assert {i for i, r in got.items() if r["outlier"]} == {r[0] for r in clean if hand[r[0]] < edge and (r[1] > middle[0] or r[2] > middle[1])}
    assert got[150]["outlier"] and got[150]["score"] == max(r["score"] for r in got.values() if r["score"]) and got[151]["depth"] == got[152]["depth"]


def test_none_one_and_equal_rows(frame):
    schema = "id long, x double"
    assert isolation.outliers(frame([], schema), "id", ["x"], trees=3, size=8).count() == 0
    for rows in ([(1, 2.0)], [(i, 5.0) for i in range(9)]):
        got = isolation.outliers(frame(rows, schema), "id", ["x"], trees=3, size=8).collect()
        assert len(got) == len(rows) and not any(r["outlier"] for r in got)


def test_nearest_inliers(frame):
    rng = random.Random(2)
    rows = [(s, i, rng.random() < 0.7) for s in ("a", None) for i in sorted(rng.sample(range(3 * isolation.CELL), 60))] + [("b", 5, True), ("b", 9, True), ("c", 1, False), ("c", 2, True), ("c", 3, False), ("c", 9000, True)]
    got = {(r["s"], r["i"]): r["taken"] for r in isolation.nearest_inliers(frame(rows, "s string, i long, outlier boolean"), ["s"], "i").collect()}
    for s, i, _ in rows:
        kept = [j for t, j, out in rows if t == s and not out]
        assert got[s, i] == (min(kept, key=lambda j: (abs(j - i), j)) if kept else i)
    assert got["c", 2] == 1 and got["c", 9000] == 3 and len(got) == len(rows)
