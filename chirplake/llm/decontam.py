"""Benchmark decontamination by winnowing.

Items and documents keep the smallest hash of k consecutive words in every
window of w such hashes.  Two texts that share k + w - 1 = ``span`` consecutive
words share such a window and so a kept hash: every shared span of that length
is found.  Each hit is extended to the longest run of equal words, once for all
hits of a run, by running sums of word hashes, and its bytes are compared; runs
of ``span`` words or more (for an item of fewer words: the whole item) are the
contaminated words.

The benchmark is the small side.  Its size is measured first: up to
``slice_bytes`` of text are broadcast at once, and a larger benchmark is taken
in as many slices, one pass after the other, so that no more than one slice is
ever held.  Documents never shuffle.

Defined cases: null or wordless texts have no words and no hits; null or
wordless items are never found; a repeated item id is one item with several
texts; equal rows are each answered; an empty benchmark leaves all clean; a
null item id is left out; other columns of either table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textbytes as T
from .shared import Scratch, bounded_batches, id_and_text, lean

SPAN, K = 10, 5
SLICE_BYTES = 16 << 20
#: Pairs of equal fingerprints that are extended together.
PAIRS = 1 << 20
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_items array<string>, hit_spans array<long>"


class Prints:
    """Fingerprints of one slice of items, sorted, with the place of each in the items' words."""

    def __init__(self, items: pa.Table, span: int, k: int):
        raw, offs = T.flat(items.column("text"))
        words = T.Words(raw, offs, 0, len(offs) - 1, T.ALNUM)
        self.span, self.k, self.ids = span, k, items.column("item_id").to_pylist()
        self.count, self.doc, self.words = words.count, words.doc(), Runs(words)
        self.by_k: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if (self.count >= span).any():
            g, low, ok = windows(words.hash, words.first, self.count, k, span - k + 1)
            self._add(k, g, np.flatnonzero(kept(g, low, ok)))
        for n in sorted(set(self.count[(self.count > 0) & (self.count < span)].tolist())):
            self._add(-n, T.grams(words.hash, n), words.first[:-1][self.count == n])

    def _add(self, key: int, g: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(g[at], kind="stable")
        quick = np.zeros(1 << 18, bool)
        quick[g[at] >> T.U64(46)] = True
        self.by_k[key] = (g[at][order], at[order], quick)


class Runs:
    """Words with running sums of their hashes, so that runs of any length compare at once."""

    def __init__(self, words: T.Words):
        self.words, self.first, n = words, words.first, len(words.hash)
        up, self.down = T._powers(n + 1)
        with np.errstate(over="ignore"):
            self.total = np.zeros(n + 1, T.U64)
            np.cumsum(words.hash * up[:n], out=self.total[1:])
        self._plain: tuple[bytes, np.ndarray] | None = None

    def hash(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.total[at + size] - self.total[at]) * self.down[at]

    def text(self, a: int, b: int) -> bytes:
        """The bytes of words a..b, each with a zero byte behind it."""
        if self._plain is None:
            w = self.words
            edge = np.concatenate([[0], np.cumsum(w.end - w.start + 1)])
            out = np.zeros(int(edge[-1]), np.uint8)
            inside = np.ones(len(out), bool)
            inside[edge[1:] - 1] = False
            out[inside] = w.bytes[T.ranges(w.start, w.end - w.start)]
            self._plain = out.tobytes(), edge
        raw, edge = self._plain
        return raw[edge[a] : edge[b]]


def windows(hashes: np.ndarray, first: np.ndarray, count: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All k-gram hashes, the smallest of each window of w, by its start, and which windows lie within one document."""
    g = T.grams(hashes, k)
    n = len(g) - w + 1
    if n <= 0:
        return g, g[:0], np.zeros(0, bool)
    low = g[:n].copy()
    for d in range(1, w):
        np.minimum(low, g[d : d + n], out=low)
    span = k + w - 1
    inside = np.zeros(len(hashes) + 1, np.int32)
    long = count >= span
    np.add.at(inside, first[:-1][long], 1)
    np.add.at(inside, first[:-1][long] + count[long] - span + 1, -1)
    return g, low, np.cumsum(inside)[:n] > 0


def kept(g: np.ndarray, low: np.ndarray, ok: np.ndarray, one: bool = False) -> np.ndarray:
    """Which hashes are the smallest of some window: all of equal ones, or one of each window.

    Items keep all, documents one (that of the window before as long as it can
    be, else the last): in every shared window the document's hash then meets
    the item's at the same place, and repeated words keep few.
    """
    keep = np.zeros(len(g), bool)
    n = len(low)
    if not one:
        for d in range(len(g) - n + 1 if n else 0):
            keep[d : d + n] |= (g[d : d + n] == low) & ok
        return keep
    choice, many = np.full(n, -1, np.int64), np.zeros(n, np.int8)
    for d in range(len(g) - n + 1 if n else 0):
        hit = g[d : d + n] == low
        choice[hit] = d
        many += hit
    choice += np.arange(n)
    for i in np.flatnonzero((many[1:] > 1) & ok[1:] & ok[:-1]).tolist() if n else ():
        before = choice[i]
        if before > i and g[before] == low[i + 1]:
            choice[i + 1] = before
    keep[choice[ok]] = True
    return keep


def _reach(a: Runs, b: Runs, at_a: np.ndarray, at_b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words, ``most`` at most, are equal from both places on (step 1) or before them (step -1)."""
    low, high = np.zeros(len(most), np.int64), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        back = mid if step < 0 else 0
        same = a.hash(at_a - back, mid) == b.hash(at_b - back, mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _extended(words: Runs, items: Runs, d: np.ndarray, i: np.ndarray, doc: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Longest runs of equal words (start, end, start in the item) through pairs of places: one for all pairs of a run, which share a diagonal."""
    order = np.lexsort((d, d - i))
    d, i = d[order], i[order]
    while len(d):
        head = np.ones(len(d), bool)
        head[1:] = (d - i)[1:] != (d - i)[:-1]
        x, y = d[head], i[head]
        left = _reach(words, items, x, y, np.minimum(x - words.first[doc[x]], y - items.first[item[y]]), -1)
        right = _reach(words, items, x, y, np.minimum(words.first[doc[x] + 1] - x, items.first[item[y] + 1] - y), 1)
        yield x - left, x + right, y - left
        later = d >= (x + right)[np.cumsum(head) - 1]
        d, i = d[later], i[later]


def _hits(words: T.Words, prints: Prints) -> tuple[list[tuple[int, int]], set[tuple[int, int]]]:
    """Runs of words (start, end) that stand in an item and are long enough, and (document, item) of those."""
    spans, found = [], set()
    doc, runs = words.doc(), Runs(words)
    for key, (table, places, quick) in prints.by_k.items():
        if key > 0:
            g, low, ok = windows(words.hash, words.first, words.count, key, prints.span - key + 1)
            keep = kept(g, low, ok, one=True)
        else:
            g = T.grams(words.hash, -key)
            keep = doc[: len(g)] == doc[-key - 1 :] if len(g) else np.zeros(0, bool)
        at = np.flatnonzero(keep)
        at = at[quick[g[at] >> T.U64(46)]]
        lo, hi = np.searchsorted(table, g[at], "left"), np.searchsorted(table, g[at], "right")
        some = hi > lo
        at, lo, hi = at[some], lo[some], hi[some]
        if key < 0:  # whole items: equal ones share their places, and count once a document
            same = np.fromiter((runs.text(a, a - key) == prints.words.text(places[j], places[j] - key) for a, j in zip(at.tolist(), lo.tolist(), strict=True)), bool, len(at))
            spans += [(a, a - key) for a in at[same].tolist()]
            pairs = np.unique(np.stack([doc[at[same]], lo[same], hi[same]], 1), axis=0) if same.any() else np.zeros((0, 3), np.int64)
            found |= {(d, int(prints.doc[places[j]])) for d, a, b in pairs.tolist() for j in range(a, b)}
            continue
        edge = np.concatenate([[0], np.cumsum(hi - lo)])
        begin = 0
        while begin < len(at):  # so many pairs of places at a time
            stop = max(begin + 1, int(np.searchsorted(edge, edge[begin] + PAIRS, "right")) - 1)
            many = (hi - lo)[begin:stop]
            d_at, i_at = np.repeat(at[begin:stop], many), places[T.ranges(lo[begin:stop], many)]
            begin = stop
            for start, end, item in _extended(runs, prints.words, d_at, i_at, doc, prints.doc):
                ok = end - start >= prints.span
                for s, e, i in zip(start[ok].tolist(), end[ok].tolist(), item[ok].tolist(), strict=True):
                    if runs.text(s, e) == prints.words.text(i, i + e - s):
                        spans.append((s, e))
                        found.add((int(doc[s]), int(prints.doc[i])))
    return spans, found


def _scan(column: pa.Array, prints: Prints) -> tuple[np.ndarray, list[list[int]], list[list[str]]]:
    """Of each text: its number of words, the hit runs [start, end, ...] counted from its first word, and the items."""
    raw, offs = T.flat(column)
    count, spans, items = np.zeros(len(offs) - 1, np.int64), [[] for _ in range(len(offs) - 1)], [[] for _ in range(len(offs) - 1)]
    for a, b in T.chunks(offs):
        words = T.Words(raw, offs, a, b, T.ALNUM)
        count[a:b] = words.count
        hit, found = _hits(words, prints)
        for s, e in hit:
            d = int(np.searchsorted(words.first, s, "right")) - 1
            spans[a + d] += [int(s - words.first[d]), int(e - words.first[d])]
        for d, item in found:
            items[a + d].append(str(prints.ids[item]))
    return count, spans, items


def merged(spans: list[int]) -> list[int]:
    """Runs [start, end, ...] joined where they touch or overlap."""
    out: list[int] = []
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


_LAST: dict[str, tuple] = {}


def _prints(held: Broadcast, span: int, k: int) -> Prints:
    """The worker's fingerprints of the slice at hand; those of the one before are let go."""
    table = held.value  # one object per broadcast and worker
    if "now" not in _LAST or _LAST["now"][0] is not table or _LAST["now"][1:3] != (span, k):
        _LAST["now"] = (table, span, k, Prints(table, span, k))
    return _LAST["now"][3]


def _slices(benchmark: DataFrame, slice_bytes: int) -> list[DataFrame]:
    """The benchmark's texts in parts of about ``slice_bytes`` (a longer text is a part of its own size)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // slice_bytes) or 1
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _passes(docs: DataFrame, benchmark: DataFrame, slice_bytes: int, step: Callable[[Broadcast, bool], Callable], schema: Callable[[bool], str | StructType]) -> DataFrame:
    """``step`` over the documents for each slice; all but the last are written, so that only one slice is broadcast and held at a time."""
    spark = docs.sparkSession
    parts, out = _slices(benchmark, slice_bytes), docs
    scratch = Scratch(spark, "decontamination") if len(parts) > 1 else None
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        held = spark.sparkContext.broadcast(part.toArrow())  # about slice_bytes
        out = out.mapInArrow(lean(step(held, last)), schema(last))
        if not last:
            out = scratch.write(out, f"pass-{i}")
            held.destroy()
        if 0 < i < len(parts) - 1:
            scratch.drop(f"pass-{i - 1}")
    return out


def find_shared(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per document row: its words, those inside a shared span, and the items found.  ``docs`` has doc_id and text."""

    def step(held: Broadcast, last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            prints = _prints(held, span, k)
            for batch in batches:
                count, spans, items = _scan(batch.column("text"), prints)
                spans = [merged(x + y) if x or y else x for x, y in zip(spans, batch.column("spans").to_pylist(), strict=True)]
                items = [sorted({*x, *y}) if x or y else x for x, y in zip(items, batch.column("items").to_pylist(), strict=True)]
                if not last:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "text", "spans", "items"])
                    continue
                hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(count), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()), pa.array([x > 0 for x in hit], pa.bool_()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_items", "hit_spans"],
                )

        return run

    rows = id_and_text(docs).withColumn("spans", F.array().cast("array<long>")).withColumn("items", F.array().cast("array<string>"))
    return _passes(rows, benchmark, slice_bytes, step, lambda last: SCHEMA if last else "doc_id long, text string, spans array<long>, items array<string>")


def without_hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, k: int = K, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The documents, all columns as they are, without those that share a span with an item.  ``docs`` has text."""

    def step(held: Broadcast, last: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            prints = _prints(held, span, k)
            for batch in batches:
                _, spans, _ = _scan(batch.column("text"), prints)
                yield batch.filter(pa.array([not x for x in spans], pa.bool_()))

        return run

    bounded_batches(docs.sparkSession)
    return _passes(docs, benchmark, slice_bytes, step, lambda last: docs.schema)
