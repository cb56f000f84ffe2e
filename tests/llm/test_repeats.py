"""Repeats of whole documents cost rows by task and bucket, not by document and segment."""

import random

import numpy as np

from chirplake.llm import byte_dedup
from chirplake.llm.shared import Scratch

from .test_exact import by_row, cut_by_hand
from .texts import SCHEMA


def test_copies_make_no_row_for_a_mark(spark, frame):
    rows = {}

    class Watched(Scratch):
        def write(self, df, name, codec="zstd"):
            out = super().write(df, name, codec)
            rows[name] = out.count()
            return out

    rng = random.Random(11)
    texts = ["".join(rng.choices("abcdefgh ", k=1500)) for _ in range(30)]
    docs = [(30 * copy + i, text) for copy in range(6) for i, text in enumerate(texts)]
    out = byte_dedup.cut_repeats(frame(docs, SCHEMA).repartition(12), Watched(spark, "t"))
    assert by_row(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(map(repr, cut_by_hand(docs)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # tasks x buckets, once more for what a batch marks itself; 150 documents x 32 parts before
    assert n == 4 and rows["first"] <= 4 * 17 + 12 * 17


def test_places_of_a_gram():
    rng = np.random.default_rng(2)
    for t in range(60):
        n = int(rng.integers(50, 600))
        raw = rng.integers(97, 97 + rng.integers(1, 5), n).astype(np.uint8)
        if t % 2:
            raw = np.tile(raw[: n // 3], 3)
        low, h = byte_dedup.keys(raw)
        width = byte_dedup.LENGTH - byte_dedup.GRAM + 1
        begin = np.flatnonzero(np.diff(low, prepend=~low[:1]))
        size = np.diff(np.append(begin, len(low)))
        place, many = byte_dedup._places(h, low, width, begin, size, low[begin])
        for b, s, p, m in zip(begin, size, place, many, strict=True):
            found = b + np.flatnonzero(h[b : b + s + width - 1] == low[b])
            assert (m, p) == (len(found), found[-1])
