"""Common prefixes from a Burrows-Wheeler transform, up to a bound.

``prefix_groups`` sorts the suffixes of a byte string by their first ``bound``
symbols and more (prefix doubling), takes the transform from that order, and
derives common prefixes without a text comparison: intervals of equal prefixes
are expanded breadth first by one symbol to the left, so the lengths at which
neighbours part come up in increasing order.  It begins with the prefixes that the
sort has compared in one number, where the bound is not below, and stops at the bound:
neighbours that have not parted by then share ``bound`` symbols.
"""

from __future__ import annotations

import numpy as np

from . import textbytes as T

#: Symbols that one number holds.
HEAD = 7


def _ranks(first: np.ndarray, second: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Order and dense ranks of suffixes by a key, or by two ranks."""
    n = len(first)
    bits = n.bit_length()
    if second is not None and 3 * bits <= 64:  # ranks are n at most: sorted with the place in one number
        both = np.sort(first.astype(np.uint64) << np.uint64(2 * bits) | second.astype(np.uint64) << np.uint64(bits) | np.arange(n, dtype=np.uint64))
        order, key = (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
    else:
        key = first if second is None else (first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
    new = np.ones(n, np.int64)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    return order, rank, bool(new.all())


def _heads(symbols: np.ndarray) -> np.ndarray:
    """The first ``HEAD`` symbols of each suffix in one number."""
    n = len(symbols)
    padded = np.zeros(n + HEAD, np.uint64)
    padded[:n] = symbols.astype(np.uint64) + 1
    key = np.zeros(n, np.uint64)
    for i in range(HEAD):
        key = (key << np.uint64(9)) | padded[i : i + n]
    return key


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least; symbols are below 510, and past the end there are none."""
    n = len(symbols)
    order, rank, done = _ranks(_heads(symbols))
    h = HEAD
    while h < depth and not done:
        later = np.zeros(n, np.int64)
        later[: n - h] = rank[h:] if h < n else 0
        order, rank, done = _ranks(rank, later)
        h *= 2
    return order


def prefix_groups(symbols: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the number of each one's group: those that share their first ``bound`` symbols."""
    ended = np.append(symbols.astype(np.int64) + 1, 0)  # a last symbol below all others
    n = len(ended)
    order = suffix_order(ended, bound + 1)
    last = ended[order - 1]  # the transform; before the first symbol stands the last
    by_symbol = np.argsort(last.astype(np.uint16), kind="stable")  # row of each place that a step to the left leads to
    to = np.empty(n, np.int32)
    to[by_symbol] = np.arange(n, dtype=np.int32)
    sorted_symbol = last[by_symbol]
    parted = np.zeros(n + 1, bool)  # between row i - 1 and row i, at a length below the bound
    parted[0] = parted[n] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    if bound >= HEAD:  # the intervals of that length are known from the numbers that were sorted
        head = _heads(ended)[order]
        parted[1:n] = head[1:] != head[:-1]
        lo = np.flatnonzero(parted[:n])
        hi = np.append(lo[1:], n)
    own = np.full(n, -1, np.int32)
    for _ in range(bound - HEAD if bound >= HEAD else bound):
        size = hi - lo
        rows = T.ranges(lo, size)
        if not len(rows):
            break
        number = np.repeat(np.arange(len(lo)), size)
        if len(rows) * 16 > n:
            own[rows] = number
            seen = own[by_symbol]
            own[rows] = -1
            place = np.flatnonzero(seen >= 0)
            group, symbol = seen[place], sorted_symbol[place]
        else:
            by = np.argsort(to[rows], kind="stable")
            place, group = to[rows][by], number[by]
            symbol = sorted_symbol[place]
        head = np.ones(len(place), bool)
        head[1:] = (group[1:] != group[:-1]) | (symbol[1:] != symbol[:-1])
        begin = np.flatnonzero(head)
        new_lo = place[begin]
        new_hi = place[np.append(begin[1:], len(place)) - 1] + 1
        fresh = ~parted[new_hi]
        # two intervals never end at one row on one level, so each sets its own entry
        parted[new_hi[fresh]] = True
        # an interval that ends at the last row sets none, but what it parts on its left still expands
        fresh |= new_hi == n
        lo, hi = new_lo[fresh], new_hi[fresh]
    return order[1:], np.cumsum(parted[:n])[1:]
