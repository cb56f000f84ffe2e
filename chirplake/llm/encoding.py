"""Token ids of whole texts by the tokenizers library, a word at a time.

A byte-pair tokenizer first splits a text into pieces and merges within a piece
only.  A single space between two non-space characters always begins a piece
(byte level) or belongs to none (word level), so the ids of a text are those of
its parts between such spaces.  The distinct parts of a chunk of texts are
found by Arrow; the ids of those met in the most chunks are kept for the life
of the worker, ``KEPT_WORDS`` at most between two chunks.

A part of Latin letters with punctuation behind it, perhaps twice with a line
feed between, the usual case, is a few pieces.  Many of these go to the library's merge model in one call,
joined by letters of bytes that no UTF-8 text has and no merge knows, so that
nothing merges across them.  Any other part goes through the whole pipeline of
the tokenizer as it is loaded, and so does, uncut, a text that holds the string
of an added token.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textbytes as T

#: A space next to further white space; only there may parts at spaces differ from the library's pieces.
_RUN = re.compile(r" \s")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: The same for Arrow's regular expressions, which know ASCII's white space only by that name.
_RUN_ARROW = " [\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_WORD, _TAIL = r"([A-Za-z\xAA\xB5\xBA\xC0-\xD6\xD8-\xF6\xF8-\xFF]+)", r"([!-&(-/:-@\[-`{-~]*)"
#: Letters of Latin-1, then ASCII punctuation without the apostrophe; perhaps the same again behind a line feed.
_SIMPLE = re.compile(rf"{_WORD}{_TAIL}(?:\n{_WORD}{_TAIL})?\Z")
_ASCII_TAIL = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: Parts kept, bytes of text encoded together, parts joined in one call.
KEPT_WORDS, CHUNK_BYTES, JOINED = 400_000, 4 << 20, 64
#: Written for the end of a word together with its last letter.
_PRIVATE = 0xE000


def _byte_letters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself where printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_LETTERS = _byte_letters()
#: Letters of the bytes 0xC0 and 0xC1: behind a part, and between its pieces.
END, INNER = _LETTERS[0xC0], _LETTERS[0xC1]
_SPACE, _LAST = _LETTERS[32], {x: chr(_PRIVATE + ord(x)) for x in _LETTERS.values()}

Learn = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class _Known:
    """Parts by number, their ids one after the other, and in how many chunks each was met."""

    def __init__(self, learn: Learn):
        self.learn, self.number = learn, {}
        self.pool, self.edge, self.hits = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The numbers of different parts; those that have none yet are learned."""
        if len(self.number) > KEPT_WORDS:
            self._forget()
        at = np.fromiter(map(self.number.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh, first = [parts[i] for i in new.tolist()], len(self.number)
            ids, size = self.learn(fresh)
            at[new] = np.arange(first, first + len(new))
            self.number.update(zip(fresh, range(first, first + len(new)), strict=True))
            self.pool = np.concatenate([self.pool, ids])
            self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(size)])
            self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int32)])
        self.hits[at] += 1
        return at

    def _forget(self) -> None:
        """Keeps the half of KEPT_WORDS that was met most often, or fewer where the last ones are equal."""
        half = len(self.hits) - KEPT_WORDS // 2
        kept = np.flatnonzero(self.hits > np.partition(self.hits, half)[half])
        words = list(self.number)
        self.number = {words[i]: n for n, i in enumerate(kept.tolist())}
        size = np.diff(self.edge)[kept]
        self.pool = self.pool[T.ranges(self.edge[kept], size)]
        self.edge, self.hits = np.concatenate([[0], np.cumsum(size)]), self.hits[kept] >> 1


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return (np.concatenate([np.array(x, np.uint32) for x in lists]) if lists else np.zeros(0, np.uint32)), size


class Encoder:
    """``spaced``: the space before a word is part of its first token (byte level); else white space makes no tokens and letters are lowered."""

    _kept: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.model, self.spaced = Tokenizer.from_file(path), spaced
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.merges = Tokenizer(self.model.model if spaced else _ends_as_letters(path))
        self.end, self.inner = (self.merges.encode(x, add_special_tokens=False).ids[0] for x in (END, INNER))
        self.words, self.heads = _Known(self._learn), _Known(lambda parts: self._whole(parts))

    @classmethod
    def of(cls, path: str, spaced: bool) -> Encoder:
        """The worker's encoder for this vocabulary."""
        if (path, spaced) not in cls._kept:
            cls._kept[path, spaced] = cls(path, spaced)
        return cls._kept[path, spaced]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flat([e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])

    def _piece(self, piece: str) -> str:
        """A piece as the merge model reads it."""
        if not piece.isascii():
            piece = "".join([_LETTERS[b] for b in piece.encode()])
        elif piece[0] <= " ":
            piece = _LETTERS[ord(piece[0])] + piece[1:]
        return piece if self.spaced else piece[:-1] + _LAST[piece[-1]]

    def _simple(self, part: str) -> str | None:
        """A simple part's pieces; None for another."""
        word = part.rstrip(_ASCII_TAIL)
        if word.isascii() and word.isalpha():  # most parts: the same as below, sooner
            tail = part[len(word) :]
            if self.spaced:
                return f"{_SPACE}{word}{INNER}{tail}" if tail else _SPACE + word
            word = word[:-1].lower() + _LAST[word[-1].lower()]
            return f"{word}{INNER}{tail[:-1]}{_LAST[tail[-1]]}" if tail else word
        found = _SIMPLE.match(part)
        if not found:
            return None
        word, tail, second, last = found.groups()
        pieces = [" " + word, tail] if self.spaced else [word.lower(), tail]
        if second:
            pieces += ["\n", second, last] if self.spaced else [second.lower(), last]
        return INNER.join([self._piece(p) for p in pieces if p])

    def _learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = list(map(self._simple, parts))
        simple = [p for p in pieces if p is not None]
        joined = [END.join(simple[i : i + JOINED]) + END for i in range(0, len(simple), JOINED)]
        ids, _ = _flat([e.ids for e in self.merges.encode_batch_fast(joined, add_special_tokens=False)])
        ids = ids[ids != self.inner]
        ends = np.flatnonzero(ids == self.end)
        ids, easy = ids[ids != self.end], np.diff(ends, prepend=-1) - 1
        if len(simple) == len(parts):
            return ids, easy
        is_simple = np.fromiter((p is not None for p in pieces), bool, len(parts))
        space = " " if self.spaced else ""
        other, hard = self._whole([space + p for p, q in zip(parts, pieces, strict=True) if q is None])
        size = np.zeros(len(parts), np.int64)
        size[is_simple], size[~is_simple] = easy, hard
        out, at = np.zeros(int(size.sum()), np.uint32), np.cumsum(size) - size
        out[T.ranges(at[is_simple], easy)] = ids
        out[T.ranges(at[~is_simple], hard)] = other
        return out, size

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All texts' parts, and their numbers."""
        if self.spaced:
            odd = pc.match_substring_regex(texts, _RUN_ARROW)
            if pc.any(odd).as_py():
                lists = [_SAFE.split(t) if _RUN.search(t) else t.split(" ") for t in texts.to_pylist()]
                return pa.array([p for x in lists for p in x], pa.large_string()), np.fromiter(map(len, lists), np.int64, len(lists))
        parts = pc.split_pattern(texts, " ")
        return parts.flatten(), np.diff(parts.offsets.to_numpy())

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), one after the other, and each text's number of ids."""
        texts = pc.fill_null((pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts).cast(pa.large_string()), "")
        special = np.zeros(len(texts), bool)
        for token in self.added:
            special |= pc.match_substring(texts, token, ignore_case=True).to_numpy(zero_copy_only=False)
        if special.any():
            out, a = [], 0
            for b in [*np.flatnonzero(special).tolist(), len(texts)]:
                out.append(self.encode(texts.slice(a, b - a)) if b > a else _flat([]))
                out.append(self._whole(texts.slice(b, 1).to_pylist()))
                a = b + 1
            return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])
        if not len(texts):
            return _flat([])
        parts, count = self._cut(texts)
        coded = parts.dictionary_encode()
        at = self.words.numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        known, edge, first = self.words.pool, self.words.edge, np.cumsum(count) - count
        if self.spaced:  # a text's first part has no space before it, so its ids are others
            heads = parts.take(pa.array(first)).dictionary_encode()
            at[first] = len(edge) - 1 + self.heads.numbers(heads.dictionary.to_pylist())[heads.indices.to_numpy()]
            known, edge = np.concatenate([known, self.heads.pool]), np.concatenate([edge, edge[-1] + self.heads.edge[1:]])
        got = pa.LargeListArray.from_arrays(pa.array(edge), pa.array(known)).take(pa.array(at))
        return got.flatten().to_numpy(), np.diff(got.offsets.to_numpy()[np.append(first, len(at))])


def _ends_as_letters(path: str):
    """The merge model of a vocabulary with word ends, each end and the letter before it written as one letter, so that joined words keep theirs."""
    from tokenizers.models import BPE

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model["end_of_word_suffix"]

    def one(token: str) -> str:
        if not token.endswith(end) or token == end:
            return token
        token = token.removesuffix(end)
        return token[:-1] + _LAST[token[-1]]

    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    return BPE({one(t): i for t, i in model["vocab"].items()}, [(one(a), one(b)) for a, b in pairs])


def batches(column: pa.Array) -> list[tuple[int, int]]:
    """Row ranges of a text column that are encoded together."""
    _, offs = T.flat(column)
    return list(T.chunks(offs, CHUNK_BYTES))
