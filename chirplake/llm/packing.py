"""Order-preserving packing of token streams into windows.

The documents of a partition, in their order, are one stream of ids.  Windows
are cut from it by dynamic programming over the places where a cut is cheap:
ends of documents (free), ends of sentences, and, inside stretches that have
neither, every few ids.  With f(i) the least cost of cutting the stream up to
place i,

    f(i) = penalty(i) + min over j of f(j) + padding(pos(i) - pos(j)),

where padding fills a window up to ``size``, or is nothing at a power of two.
For full padding the minimum of f(j) + pos(j) over a sliding window of ids is
kept in a monotone queue, so a place costs constant time; the few powers of two
are looked up.  The stream is taken in stretches of bounded length: at the end
of one, the cheapest cut within the last window is kept and the ids behind it
open the next.  The last window of a partition is cut into powers of two where
that is cheaper than padding it.

No row moves between partitions, nothing is dropped, and every id lies in
exactly one piece.  Defined cases: a null text is empty and consists of its end
id; equal rows are each packed; an empty table gives no rows; a document longer
than a window is cut; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .encoding import Encoder, batches
from .shared import id_and_text, lean

SIZE = 2048
#: In ids of padding: a cut at the end of a sentence, inside a sentence, and a window of a smaller power of two.
SENTENCE, INSIDE, SMALL = 8, 64, 16
STRETCH = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def places(ends: np.ndarray, sentence: np.ndarray, total: int, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Where cuts may be (from 0 to total, ascending) and their penalties."""
    gap, every = max(size // 8, 1), max(size // 32, 1)
    cost = np.full(total + 1, -1, np.int16)
    cost[sentence] = SENTENCE
    cost[ends] = 0
    cost[0] = cost[total] = 0
    at = np.flatnonzero(cost >= 0)
    wide = np.flatnonzero(np.diff(at) > gap)
    for i in wide.tolist():
        more = np.arange(at[i] + every, at[i + 1], every)
        cost[more] = INSIDE
    if len(wide):
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def plan(at: np.ndarray, cost: np.ndarray, size: int = SIZE, last: bool = True) -> list[int]:
    """The cut positions of least cost, from 0; up to the total if ``last``, else up to the cheapest place in the last window."""
    pos, pen, n = at.tolist(), cost.tolist(), len(at)
    where = np.full(int(at[-1]) + 1, -1, np.int32)
    where[at] = np.arange(n, dtype=np.int32)
    small: dict[int, list[int]] = {}
    for power in (size // 8, size // 4, size // 2):  # smaller ones only end a partition's stream
        i = np.flatnonzero(at >= power)
        j = where[at[i] - power]
        for a, b in zip(i[j >= 0].tolist(), j[j >= 0].tolist(), strict=True):
            if power:
                small.setdefault(a, []).append(b)
    f, back = [0] * n, [0] * n
    q_key, q_at, head = [pos[0]], [0], 0
    for i in range(1, n):
        p = pos[i]
        low = p - size
        while pos[q_at[head]] < low:
            head += 1
        best, b = q_key[head] - low, q_at[head]
        if i in small:
            for j in small[i]:
                if f[j] + SMALL < best:
                    best, b = f[j] + SMALL, j
        best += pen[i]
        f[i], back[i] = best, b
        key = best + p
        while len(q_key) > head and q_key[-1] >= key:
            q_key.pop()
            q_at.pop()
        q_key.append(key)
        q_at.append(i)
    total = pos[-1]
    tail = [i for i in range(n - 1, -1, -1) if pos[i] > total - size]
    if not last:
        end, rest = min(tail, key=lambda i: (f[i], -i)), []
    else:
        end = min(tail, key=lambda i: f[i] + tail_cost(total - pos[i]))
        rest, p = [], pos[end]
        for bit in range(size.bit_length(), -1, -1):
            if (total - pos[end]) >> bit & 1:
                p += 1 << bit
                rest.append(p)
        if f[n - 1] <= f[end] + tail_cost(total - pos[end]):
            end, rest = n - 1, []
    cuts = [*rest[::-1]]
    while end:
        cuts.append(pos[end])
        end = back[end]
    return [0, *cuts[::-1]]


def tail_cost(n: int) -> int:
    """Of a rest cut into powers of two."""
    return (n.bit_count() - 1) * INSIDE if n else 0


def _pack(path: str, size: int, end_id: int, stops: tuple[str, ...]):
    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, spaced=False)
        marks = [encoder.model.token_to_id(x) for x in stops]
        stop = np.zeros(encoder.model.get_vocab_size() + 1, bool)
        stop[[m for m in marks if m is not None]] = True
        sequence = TaskContext.get().partitionId() << 40
        # the open stretch: ids, and of each document in it: id, ids before the stretch, ids in all, place where its part ends
        held, held_n, docs = [], 0, []

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, held_n, docs, sequence
            ids = np.concatenate(held)
            ends = np.array([d[3] for d in docs])
            at, cost = places(ends, np.flatnonzero(stop[ids]) + 1, len(ids), size)
            cuts = np.array(plan(at, cost, size, last))
            kept = int(cuts[-1])
            bounds = np.unique(np.concatenate([cuts, ends[ends <= kept]]))
            lo, hi = bounds[:-1], bounds[1:]
            doc, window = np.searchsorted(ends, lo, "right"), np.searchsorted(cuts, lo, "right") - 1
            begin = np.concatenate([[0], ends[:-1]])
            raw = memoryview(ids.astype("<u4").tobytes())
            out = pa.RecordBatch.from_arrays(
                [pa.array([docs[d][0] for d in doc.tolist()], pa.int64()), pa.array(lo - begin[doc] + np.array([docs[d][1] for d in doc.tolist()], np.int64), pa.int64()), pa.array(hi - lo, pa.int64()), pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.int64()), pa.array([docs[d][2] for d in doc.tolist()], pa.int64()), pa.array(sequence + window, pa.int64()), pa.array(lo - cuts[window], pa.int64())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += len(cuts) - 1
            first = int(np.searchsorted(ends, kept, "right"))
            docs = [(d, before + max(0, kept - int(b)), n, e - kept) for (d, before, n, e), b in zip(docs[first:], begin[first:], strict=True)]
            held, held_n = [ids[kept:]], len(ids) - kept
            return out

        for batch in it:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for a, b in batches(texts):
                ids, count = encoder.encode(texts.slice(a, b - a))
                ends = np.cumsum(count)
                ids = np.insert(ids, ends, end_id)
                ends = ends + np.arange(1, len(ends) + 1)
                for d, n, e in zip(doc_ids[a:b], (count + 1).tolist(), ends.tolist(), strict=True):
                    docs.append((d, 0, n, held_n + e))
                held.append(ids)
                held_n += len(ids)
                if held_n >= STRETCH:
                    yield flush(last=False)
        if held_n:
            yield flush(last=True)

    return run


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = 1, stops: tuple[str, ...] = (".</w>", "!</w>", "?</w>")) -> DataFrame:
    """One row per piece of a document in a sequence (see SCHEMA).  Sequences hold at most ``size`` ids, a power of two; sequence_id holds the partition above bit 40."""
    return id_and_text(docs).mapInArrow(_pack(vocabulary, size, end_id, stops), SCHEMA)
