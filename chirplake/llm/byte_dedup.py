"""Repeated byte strings across documents, by suffix sorting of bounded groups.

Every ``length``-byte string has a key that depends on its bytes alone: the
smallest hash of the 16-byte strings inside it.  Equal strings have equal keys,
wherever they stand, so strings of different keys never need to be compared.
Neighbouring strings mostly share their key; a run of them is a segment.

1. Documents give their segments as (key, hash of the bytes, document, place).
   Equal segments within a batch need no comparison: only those of the smallest
   document go on, the others are marked.  A segment that a third of all
   documents hold is thus one entry per batch.
2. By key: equal segments of larger documents are marked.  Equal means the same
   64-bit hash of all bytes under the same key; with ten different segments a
   key, 100 TB of text would have about 10^-6 wrong matches.  Of a key's different
   segments those are passed on that agree with another on enough bytes left or
   right of the gram for a common string, with one document for each.
3. Those segments' bytes are fetched from the documents, and brought together
   by key in blocks.  In a block, common prefixes are derived from the
   Burrows-Wheeler transform in increasing order and up to ``length`` (see
   ``bwt``): suffixes that have not parted then begin with equal strings, and
   all but those of the smallest document are marked.  A key with very many
   different segments is dealt out by the strings themselves instead, again one
   entry per batch and string.
4. The marks meet the documents, and the marked bytes go.

Steps 1 and 2 end in a table, and so does step 3: what each has shuffled goes with
its end.  The documents are dealt for step 3 and again for step 4, so that their
texts and the segments' bytes do not lie on disk together to the end.

Documents are dealt in buckets of their doc_id.  Marks and requests for bytes are
records in blobs, a few blobs for a bucket and task, that come to its texts ahead
of them in one sort: there is no row, and no list of rows, for a mark.

Defined cases: null text is empty; a text shorter than ``length`` loses
nothing; equal rows of one doc_id do not count as repeats of each other, and
each is answered; a null doc_id loses nothing and costs no one anything; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as T
from .bwt import prefix_groups
from .shared import Scratch, id_and_text

GRAM, LENGTH = 16, 50
#: Starts in one segment at most, starts looked at together, and symbols in one transform.
RUN, SLICE, BLOCK = 128, 1 << 17, 1 << 19
#: Bytes of text whose equal segments are looked for before anything is shuffled.
SHARED = 8 << 20
#: Different segments of one key from which on it is dealt out by its strings.
WIDE = 4096
PARTS = 8
#: Buckets of documents in a partition, and records that a task holds before it gives them out.
BUCKETS, HELD = 4, 1 << 20
ENTRY = np.dtype([("key", "<u4"), ("low", "<u4"), ("high", "<u4"), ("doc", "<u2"), ("start", "<u4"), ("n", "u1"), ("left", "<u2"), ("right", "<u2")])
#: Sides of a segment: NONE can match nothing, ANY may match everything (the gram that makes the key stands in it several times).
NONE, ANY = 0, 0xFFFF


def keys(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The key of every ``length``-byte string of a buffer, by its start, and the hashes of all grams."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, T.U64), np.zeros(0, T.U64)
    with np.errstate(over="ignore"):
        h, size = T._BYTE[raw], 1
        for m in T._stream(0x16, 4) | T.U64(1):
            h = h[:-size] * m + h[size:]
            size *= 2
        assert size == GRAM
        h ^= h >> T.U64(29)
        h *= T.U64(0xBF58476D1CE4E5B9)
        h ^= h >> T.U64(32)
    width, have, low = length - GRAM + 1, 1, h
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low, h


def _sides(h: np.ndarray, low: np.ndarray, key: np.ndarray, begin: np.ndarray, size: np.ndarray, total: np.ndarray, down: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Short hashes of the bytes left and right of each segment's gram.

    A string of ``length`` bytes with the gram inside reaches at least half of
    the other bytes to its left, or to its right.  Two segments can have a
    string in common only if they agree on that many bytes on one side.
    """
    width = length - GRAM + 1  # starts of strings that hold one gram
    half = (length - GRAM) // 2
    left, right = np.full(len(key), ANY, np.uint16), np.full(len(key), ANY, np.uint16)
    j = np.flatnonzero(size <= width)  # a longer run holds the gram more than once
    q, many = _places(h, low, width, begin[j], size[j], key[j])
    j, q = j[many == 1], q[many == 1]
    reach = q - half >= begin[j]
    left[j], right[j] = NONE, NONE
    a, b = j[reach], q[reach]
    left[a] = _short((total[b] - total[b - half]) * down[b - half])
    reach = q + GRAM + half <= begin[j] + size[j] - 1 + length
    a, b = j[reach], q[reach] + GRAM
    right[a] = _short((total[b + half] - total[b]) * down[b])
    return left, right


def _places(h: np.ndarray, low: np.ndarray, width: int, begin: np.ndarray, size: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last place of each segment's gram, and the number of its places.

    A segment's gram is the smallest of windows of ``width`` grams, so it is looked for only among the grams that are the smallest of one.
    """
    have, most = 1, np.concatenate([np.zeros(width - 1, T.U64), low, np.zeros(width - 1, T.U64)])
    while have < width:
        step = min(have, width - have)
        most = np.maximum(most[:-step], most[step:])
        have += step
    least = h == most[: len(h)]
    at, before = np.flatnonzero(least), np.zeros(len(h) + 1, np.int64)
    np.cumsum(least, out=before[1:])
    i, stop = before[begin], before[np.minimum(begin + size + width - 1, len(h))]
    place, many, some = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.arange(len(key))
    while len(some := some[i[some] < stop[some]]):
        found = some[h[at[i[some]]] == key[some]]
        place[found] = at[i[found]]
        many[found] += 1
        i[some] += 1
    return place, many


def _short(h: np.ndarray) -> np.ndarray:
    return (T.mix(h) % T.U64(ANY - 1) + T.U64(1)).astype(np.uint16)


def segments(raw: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> Iterator[tuple[np.ndarray, ...]]:
    """Slices of a buffer of documents: key, hash, document, start in the buffer, number of starts and sides of its segments."""
    ends = offs[1:]
    for a in range(0, len(raw), SLICE):
        part = raw[a : a + SLICE + length - 1]
        k, grams = keys(part, length)
        if not len(k):
            continue
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(offs[:-1], a + len(k), "left")
        ok = np.ones(len(k) + 1, bool)
        ok[-1] = False
        cut = np.zeros(len(k) + 1, bool)
        for d in range(lo, hi):  # strings that would run over a document's end
            e = int(ends[d]) - a
            ok[max(0, e - length + 1) : max(0, min(e, len(k)))] = False
            if 0 <= e < len(k):
                cut[e] = True
        head = cut[:-1]
        head[0] = True
        head[1:] |= (k[1:] != k[:-1]) | (ok[1:-1] != ok[:-2])
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(k)))
        good = ok[begin]
        begin, size = begin[good], size[good]
        if (size > RUN).any():
            times = -(-size // RUN)
            number = T.ranges(np.zeros(len(size), np.int64), times)
            begin, size = np.repeat(begin, times) + number * RUN, np.minimum(np.repeat(size, times) - number * RUN, RUN)
        up, down = T._powers(len(part) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, T.U64)
            np.cumsum(T._BYTE[part] * up[: len(part)], out=total[1:])
            h = T.mix((total[begin + size + length - 1] - total[begin]) * down[begin] + size.astype(T.U64))
            left, right = _sides(grams, k, k[begin], begin, size, total, down, length)
        start = begin + a
        yield k[begin], h, np.searchsorted(ends, start, "right"), start, size, left, right


MARK = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4")])
REQUEST = np.dtype([("doc", "<i8"), ("key", "<u8"), ("start", "<u4"), ("n", "u1"), ("wide", "u1")])


def _marks(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    rows = np.empty(len(doc), MARK)
    rows["doc"], rows["start"], rows["end"] = doc, start, end
    return rows


def joined(marks: np.ndarray) -> np.ndarray:
    """Marks by document and place, in one where they touch or overlap."""
    if not len(marks):
        return marks
    marks = marks[np.lexsort((marks["start"], marks["doc"]))]
    head = np.ones(len(marks), bool)
    head[1:] = marks["doc"][1:] != marks["doc"][:-1]
    own = np.cumsum(head) << 32  # no mark reaches into the next document
    end = np.maximum.accumulate(marks["end"] + own)
    head[1:] |= (marks["start"] + own)[1:] > end[:-1]
    at = np.flatnonzero(head)
    out = marks[at]
    out["end"] = (end - own)[np.append(at[1:], len(marks)) - 1]
    return out


def _blobs(records: np.ndarray, buckets: int) -> tuple[list[int], list[bytes]]:
    """Records by the bucket of their document, as one blob each."""
    bucket = records["doc"] % buckets
    order = np.lexsort((records["doc"], bucket))
    bucket, raw, width = bucket[order], records[order].tobytes(), records.dtype.itemsize
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    cut = [*(first * width).tolist(), len(raw)]
    return bucket[first].tolist(), [raw[i:j] for i, j in zip(cut, cut[1:], strict=False)]


class _Records:
    """Records of several kinds, given out as blobs by bucket when there are many."""

    def __init__(self, buckets: int, *names: str):
        self.buckets, self.names, self.held, self.n = buckets, names, [[] for _ in names], 0

    def add(self, *records: np.ndarray) -> Iterator[pa.RecordBatch]:
        for held, new in zip(self.held, records, strict=True):
            if len(new):
                held.append(new)
                self.n += len(new)
        if self.n >= HELD:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        for name, held in zip(self.names, self.held, strict=True):
            if held:
                bucket, blobs = _blobs(np.concatenate(held), self.buckets)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *[pa.array(blobs if name == other else [None] * len(blobs), pa.binary()) for other in self.names]], names=["bucket", *self.names])
        self.held, self.n = [[] for _ in self.names], 0


def _by_bucket(it: Iterator[pa.RecordBatch], name: str, kind: np.dtype, ready: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Rows by bucket, blobs of records ahead of the texts: a bucket's records with each batch of its texts."""
    now, held, records = None, [], None
    for batch in it:
        bucket = batch.column("bucket").to_numpy()
        cut = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
        for a, b in zip(cut, cut[1:], strict=False):
            part = batch.slice(a, b - a)
            if bucket[a] != now:
                now, held, records = bucket[a], [], None
            blobs = len(part) - part.column(name).null_count
            held += part.column(name).slice(0, blobs).to_pylist()
            if blobs < len(part):
                if records is None:
                    records = ready(np.frombuffer(b"".join(held), kind))
                    held = []
                yield records, part.slice(blobs)


def _entries(parts: int, buckets: int, length: int):
    """(doc_id, text) to blobs of entries for each part, and marks of what a smaller document of the batch holds."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            _, edges = T.flat(whole.column("text"))
            for lo, hi in [(a, min(a + (1 << 16), j)) for i, j in T.chunks(edges, SHARED) for a in range(i, j, 1 << 16)]:
                batch = whole.slice(lo, hi - lo)
                batch = batch.filter(batch.column("doc_id").is_valid())
                raw, offs = T.flat(batch.column("text"))
                ids = batch.column("doc_id").to_numpy()
                found = list(segments(raw, offs, length))
                if not found:
                    continue
                key, h, doc, start, size, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
                start = start - offs[:-1][doc]
                order = np.argsort(T.mix(key) ^ h)  # equal segments stand together
                key, h, doc, start, size, left, right = (x[order] for x in (key, h, doc, start, size, left, right))
                head = np.ones(len(key), bool)
                head[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
                owner = ids[doc]
                repeat = owner != np.minimum.reduceat(owner, np.flatnonzero(head))[np.cumsum(head) - 1]
                bucket, marks = _blobs(joined(_marks(owner[repeat], start[repeat], start[repeat] + size[repeat] + length - 1)), buckets)
                keep = ~repeat
                key, h, doc, start, size, left, right = (x[keep] for x in (key, h, doc, start, size, left, right))
                part = ((key >> T.U64(32)) % T.U64(parts)).astype(np.int64)
                order = np.argsort(part << 16 | doc)
                entry = np.empty(len(key), ENTRY)
                entry["key"], entry["low"], entry["high"] = key & T.U64(0xFFFFFFFF), h & T.U64(0xFFFFFFFF), h >> T.U64(32)
                entry["start"], entry["n"], entry["left"], entry["right"] = start, size, left, right
                assert not len(start) or start.max() < 1 << 32
                entry, part, doc = entry[order], part[order], doc[order]
                new = np.ones(len(part), bool)  # a part's first entry, or its first one of a document
                new[1:] = part[1:] != part[:-1]
                first = np.flatnonzero(new)
                new[1:] |= doc[1:] != doc[:-1]
                number = np.cumsum(new) - 1
                entry["doc"] = number - np.repeat(number[first], np.diff(np.append(first, len(part))))
                raw, docs = entry.tobytes(), ids[doc[new]].astype("<i8").tobytes()
                cut, of = np.append(first, len(part)), np.append(number[first], new.sum())
                blobs = [raw[i:j] for i, j in zip((cut[:-1] * ENTRY.itemsize).tolist(), (cut[1:] * ENTRY.itemsize).tolist(), strict=True)]
                docs = [docs[i:j] for i, j in zip((of[:-1] * 8).tolist(), (of[1:] * 8).tolist(), strict=True)]
                n, m = len(blobs), len(marks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[first].tolist() + [b % parts for b in bucket], pa.int32()), pa.array(blobs + [None] * m, pa.binary()), pa.array(docs + [None] * m, pa.binary()), pa.array([None] * n + bucket, pa.int32()), pa.array([None] * n + marks, pa.binary())],
                    names=["part", "entries", "docs", "bucket", "marks"],
                )

    return run


def _resolve(buckets: int, length: int):
    """Rows by part: marks (also those passed through), and requests for the bytes of differing segments."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        out = _Records(buckets, "marks", "asked")

        def close() -> tuple[np.ndarray, np.ndarray]:
            e = np.concatenate([np.frombuffer(x, ENTRY) for x, _ in held])
            doc = np.concatenate([np.frombuffer(d, "<i8")[np.frombuffer(x, ENTRY)["doc"]] for x, d in held])
            h = e["high"].astype(np.uint64) << np.uint64(32) | e["low"]
            order = np.argsort(e["key"].astype(np.uint64) << np.uint64(32) | (h ^ h >> np.uint64(16)) & np.uint64(0xFFFFFFFF))  # by key, equal segments together
            e, doc, h = e[order], doc[order], h[order]
            new_key, new_seg = np.ones(len(e), bool), np.ones(len(e), bool)
            new_key[1:] = e["key"][1:] != e["key"][:-1]
            new_seg[1:] = new_key[1:] | (h[1:] != h[:-1])
            seg = np.cumsum(new_seg) - 1
            kind, heads = np.flatnonzero(new_seg), np.flatnonzero(new_key)
            repeat = doc != np.minimum.reduceat(doc, kind)[seg]
            start, size = e["start"].astype(np.int64), e["n"].astype(np.int64)
            marks = _marks(doc[repeat], start[repeat], (start + size)[repeat] + length - 1)
            # of a key's different segments, those that agree with another on a side
            of = (np.cumsum(new_key) - 1)[kind]
            mixed = (np.bincount(of) > 1) & (np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads))
            some = np.flatnonzero(mixed[of])
            of, some_kind = of[some], kind[some]
            wanted = np.bincount(of, weights=e["left"][some_kind] == ANY, minlength=len(heads))[of] > 0
            for side in ("left", "right"):
                value = e[side][some_kind].astype(np.int64)
                _, which, many = np.unique(of << 16 | value, return_inverse=True, return_counts=True)
                wanted |= (many[which] > 1) & (value != NONE)
            kinds = np.bincount(of, weights=wanted, minlength=len(heads))[of]
            wide = np.full(len(kind), -1)  # of a segment: -1 where it isn't asked for
            wide[some] = np.where(wanted & (kinds > 1), kinds > WIDE, -1)
            ask = (wide[seg] >= 0) & ~repeat
            r = np.empty(int(ask.sum()), REQUEST)
            r["doc"], r["key"] = doc[ask], np.uint64(now) << np.uint64(32) | e["key"][ask]
            r["start"], r["n"], r["wide"] = start[ask], size[ask], wide[seg[ask]]
            return marks, r

        for batch in it:
            for row in batch.to_pylist():
                if row["part"] != now:
                    if held:
                        yield from out.add(*close())
                    now, held = row["part"], []
                if row["entries"] is None:
                    yield from out.add(np.frombuffer(row["marks"], MARK), np.zeros(0, REQUEST))
                else:
                    held.append((row["entries"], row["docs"]))
        if held:
            yield from out.add(*close())
        yield from out.flush()

    return run


def _fetch(buckets: int, length: int):
    """Texts by bucket and what is asked of them to rows (key, doc_id, start, n, bytes); of wide keys one row per string, and marks for those that a smaller document of the batch has."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, whole in _by_bucket(it, "asked", REQUEST, lambda r: r[np.argsort(r["doc"])]):
            if len(asked):
                _, edges = T.flat(whole.column("text"))
                for lo, hi in T.chunks(edges, SHARED):
                    yield from chunk(asked, whole.slice(lo, hi - lo))

    def rows(key: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, text: pa.Array) -> pa.RecordBatch:
        nulls = pa.nulls(len(key), pa.int32()), pa.nulls(len(key), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.uint64).view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int64)), pa.array(n.astype(np.int32)), text, *nulls], names=["key", "doc_id", "start", "n", "bytes", "bucket", "marks"])

    def chunk(asked: np.ndarray, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, offs = T.flat(batch.column("text"))
        ids = batch.column("doc_id").to_numpy()
        lo, hi = np.searchsorted(asked["doc"], ids, "left"), np.searchsorted(asked["doc"], ids, "right")
        row, r = np.repeat(np.arange(len(ids)), hi - lo), asked[T.ranges(lo, hi - lo)]
        size = r["n"].astype(np.int64) + length - 1
        at = offs[row] + r["start"]
        fits = at + size <= offs[row + 1]  # else another row of the same doc_id has this segment
        r, at, size = r[fits], at[fits], size[fits]
        some = r["wide"] == 0
        narrow, place = r[some], at[some]
        edges = np.append(0, np.cumsum(size[some]))
        for i, j in T.chunks(edges, SLICE):
            text = raw[T.ranges(place[i:j], np.diff(edges[i : j + 1]))]
            yield rows(narrow["key"][i:j], narrow["doc"][i:j], narrow["start"][i:j], narrow["n"][i:j], pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((edges[i : j + 1] - edges[i]).astype(np.int32)), pa.py_buffer(text)]))
        if some.all():
            return
        data = raw.tobytes()
        wide: dict[bytes, list[tuple[int, int]]] = {}
        for d, s, n, p in zip(*(r[c][~some].tolist() for c in ("doc", "start", "n")), at[~some].tolist(), strict=True):
            for j in range(n):
                wide.setdefault(data[p + j : p + j + length], []).append((d, s + j))
        first, repeats = [], []
        for string, places in wide.items():
            least = min(d for d, _ in places)
            first += [(string, d, j) for d, j in places if d == least]
            repeats += [(d, j) for d, j in places if d != least]
        key = np.array([int.from_bytes(hashlib.blake2b(string, digest_size=8).digest()) for string, _, _ in first], np.uint64)
        yield rows(key, np.array([d for _, d, _ in first]), np.array([j for _, _, j in first]), np.ones(len(first)), pa.array([string for string, _, _ in first], pa.binary()))
        doc, start = np.array(repeats, np.int64).reshape(-1, 2).T
        bucket, marks = _blobs(joined(_marks(doc, start, start + length)), buckets)
        none = [pa.nulls(len(bucket), kind) for kind in (pa.int64(), pa.int64(), pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *none, pa.array(bucket, pa.int32()), pa.array(marks, pa.binary())], names=["key", "doc_id", "start", "n", "bytes", "bucket", "marks"])

    return run


def repeated(contexts: list[bytes], doc: np.ndarray, n: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(context, start in it) of each of the contexts' first n strings that also stands in a context of a smaller document."""
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts)) + 1
    symbols = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.int64) + 1
    first = np.cumsum(sizes) - sizes
    symbols[first + sizes - 1] = 0  # parts contexts; no string holds it
    order, group = prefix_groups(symbols, length)
    owner = np.repeat(np.arange(len(contexts)), sizes)[order]
    inside = order - first[owner] < n[owner]
    order, group, owner = order[inside], group[inside], owner[inside]
    if not len(order):
        return owner, order
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.repeat(np.minimum.reduceat(doc[owner], heads), np.diff(np.append(heads, len(group))))
    again = doc[owner] > least
    return owner[again], (order - first[owner])[again]


def _compare(buckets: int, length: int):
    """Rows sorted by key: marks of strings that a smaller document holds."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        out = _Records(buckets, "marks")

        def close() -> np.ndarray:
            rows = pa.Table.from_batches(held)
            doc, start, n = (rows.column(c).to_numpy() for c in ("doc_id", "start", "n"))
            owner, at = repeated(rows.column("bytes").to_pylist(), doc, n, length)
            begin = start[owner] + at
            return joined(_marks(doc[owner], begin, begin + length))

        for batch in it:
            passed = batch.column("bytes").is_null()
            for marks in batch.column("marks").filter(passed).to_pylist():
                yield from out.add(np.frombuffer(marks, MARK))
            batch = batch.filter(batch.column("bytes").is_valid())
            if not len(batch):
                continue
            key, edges = batch.column("key").to_numpy(), np.append(0, np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy()))
            cuts, a = np.flatnonzero(np.diff(key)) + 1, 0
            if key[0] != last:
                cuts = np.append(0, cuts)
            while True:  # a block ends with the first key at its size
                i = int(np.searchsorted(edges[cuts], edges[a] + BLOCK - size))
                b = int(cuts[i]) if i < len(cuts) else len(key)
                held.append(batch.slice(a, b - a))
                size += int(edges[b] - edges[a])
                if i == len(cuts):
                    break
                yield from out.add(close())
                held, size, a, cuts = [], 0, b, cuts[i + 1 :]
            last = key[-1]
        if held:
            yield from out.add(close())
        yield from out.flush()

    return run


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>"


def _cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for marks, batch in _by_bucket(it, "marks", MARK, joined):
        raw, offs = T.flat(batch.column("text"))
        data = memoryview(raw.tobytes())
        ids = batch.column("doc_id")
        known = ids.fill_null(0).to_numpy()
        lo, hi = (np.where(ids.is_valid(), np.searchsorted(marks["doc"], known, side), 0).tolist() for side in ("left", "right"))
        rows = []
        for i, (a, b) in enumerate(zip(lo, hi, strict=True)):
            own = data[offs[i] : offs[i + 1]]
            sha, at, spans = hashlib.sha256(), 0, []
            if b > a:  # of rows of one doc_id, one may end before a mark
                for s, e in np.minimum(np.stack([marks["start"][a:b], marks["end"][a:b]], 1), len(own)).tolist():
                    if s < e:
                        sha.update(own[at:s])
                        at = e
                        spans += [s, e]
            sha.update(own[at:])
            rows.append((len(own), sum(spans[1::2]) - sum(spans[::2]), len(spans) // 2, sha.hexdigest(), spans))
        n, gone, count, sha, spans = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.int64()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def _prime(n: int) -> int:
    """The first prime from n on."""
    return next(p for p in range(n, 2 * n) if all(p % i for i in range(2, math.isqrt(p) + 1)))


def cut_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """One row per document row: its bytes, those removed, the runs removed, and the digest of the rest."""
    assert length >= GRAM + 1
    spark = docs.sparkSession
    rows = id_and_text(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (64 << 20)))
    buckets = _prime(BUCKETS * n + 1)  # doc_ids may be the multiples of a number; few have this one

    def dealt(name: str, blobs: DataFrame) -> DataFrame:
        texts = rows.withColumn("bucket", F.coalesce(F.pmod("doc_id", F.lit(buckets)), F.pmod(F.xxhash64("text"), F.lit(buckets))).cast("int"))
        both = texts.unionByName(blobs.where(f"{name} is not null").select("bucket", name), allowMissingColumns=True)
        return both.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket", F.col(name).isNull())

    entries = rows.mapInArrow(_entries(n * PARTS, buckets, length), "part int, entries binary, docs binary, bucket int, marks binary")
    first = entries.repartition(n, "part").sortWithinPartitions("part").mapInArrow(_resolve(buckets, length), "bucket int, marks binary, asked binary")
    first = scratch.write(first, "first")
    fetched = dealt("asked", first).where("doc_id is not null or asked is not null").mapInArrow(_fetch(buckets, length), "key long, doc_id long, start long, n int, bytes binary, bucket int, marks binary")
    second = fetched.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_compare(buckets, length), "bucket int, marks binary")
    second = scratch.write(second, "second")  # the dealt texts and the fetched bytes go before the texts are dealt again
    return dealt("marks", first.select("bucket", "marks").unionByName(second)).mapInArrow(_cut, SCHEMA)
