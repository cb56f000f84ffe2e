"""Words and hashes of whole batches of texts as NumPy arrays.

A batch of texts is one byte buffer and its document offsets.  Words are found
and hashed for the whole buffer at once; no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are looked at together: enough to spread NumPy's call costs, little enough for the caches.
CHUNK_BYTES = 1 << 20

_ascii = np.arange(256)
#: A-Z to a-z; every other byte stays.
LOWER = np.where((_ascii >= 65) & (_ascii <= 90), _ascii + 32, _ascii).astype(np.uint8)
#: Bytes of words of letters, digits and everything beyond ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after lower-casing.
ALNUM = ((_ascii >= 48) & (_ascii <= 57)) | ((_ascii >= 97) & (_ascii <= 122)) | (_ascii >= 128)
#: Bytes of words between white space: [^\x20\x09-\x0D].
NONSPACE = ~((_ascii == 32) | ((_ascii >= 9) & (_ascii <= 13)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _stream(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(U64(seed) + np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


_BYTE = _stream(0x5EED, 256)
_BASE = int(_stream(0xBA5E, 1)[0] | U64(1)) | 4
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses mod 2^64, at least n."""
    size = max(CHUNK_BYTES, 1 << (max(n, 1) - 1).bit_length())
    if size not in _POWERS:
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, U64)
            up[0] = 1
            down = np.full(size, pow(_BASE, -1, 1 << 64), U64)
            down[0] = 1
            new = np.cumprod(up), np.cumprod(down)
        if size > CHUNK_BYTES:
            return new  # of one very long text; not kept
        _POWERS[size] = new
    return _POWERS[size]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, and the n + 1 offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes; a longer document is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """The words of documents a..b: ``start``/``end`` in the chunk's bytes, ``hash``, and ``first``, the number of each document's first word (with a last entry for the end)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, a: int, b: int, inside: np.ndarray, hashed: bool = True):
        self.docs = b - a
        self.bytes = LOWER[raw[offsets[a] : offsets[b]]]
        n, edge = len(self.bytes), offsets[a : b + 1] - offsets[a]
        on = inside[self.bytes]
        begin, stop = on.copy(), on.copy()
        begin[1:] &= ~on[:-1]
        stop[:-1] &= ~on[1:]
        heads = edge[:-1][edge[:-1] < edge[1:]]
        begin[heads] = on[heads]
        tails = heads[1:] - 1
        stop[tails] = on[tails]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, edge)
        self.count = np.diff(self.first)
        if hashed:
            up, down = _powers(n + 1)
            with np.errstate(over="ignore"):
                total = np.zeros(n + 1, U64)
                np.cumsum(_BYTE[self.bytes] * up[:n], out=total[1:])
                self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.docs), self.count)

    def text(self, i: int, j: int) -> list[bytes]:
        return [self.bytes[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True)]


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k neighbours each, for every position that has k - 1 more behind it (document bounds not heeded)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.full(n, U64(k), U64)
        for i, m in enumerate(_stream(0xC0DE, k) | U64(1)):
            out += hashes[i : i + n] * m
    return mix(out)


def whole(hashes: np.ndarray) -> int:
    """One hash of a short sequence, the same as ``grams(hashes, len(hashes))[0]``."""
    return int(grams(hashes, len(hashes))[0])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length), one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values."""
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))
