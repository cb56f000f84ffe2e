"""Byte-level BPE by a transducer, and the way back as a stream.

Encoding.  Merging pairs of least rank never looks across a boundary that ends
up between two tokens, so the tokens of a prefix are those of a shorter prefix
and one more, and that one is right exactly if merging it together with the
token before it leaves both as they are.  So merges compile into a
nondeterministic transducer: a thread has the tokens of some prefix behind it
and reads its next token along a trie of the vocabulary; where a token ends that
fits the one before, a new thread begins.  It is made deterministic a transition
at a time, as texts ask for them: a state is the set of live threads, and a
transition says which token ends with its byte.  What all threads have behind
them in common is settled and emitted, at a piece's end and every ``EMIT_BYTES``;
a thread lives for the bytes of the longest token at most, which bounds the
lookahead.  ``STATES`` bounds the machine; a full one starts anew.

A text is cut at spaces that begin a piece, and there into pieces by the pattern;
the ids of words are kept as in ``encoding``.  The pattern's classes of characters are those of the tokenizer
library's regular expressions; where this worker's differ, stand-ins are cut.

Decoding.  Ids become bytes chunk by chunk; an incremental UTF-8 machine holds
back the bytes of a character that the next chunk completes.  Ill-formed parts
become U+FFFD, one for each maximal part, however the ids are cut into chunks.

Defined cases: a null or empty text has no ids, null or no ids give an empty
text; an id outside the vocabulary or a null one is an error; equal rows and ids
all stay; an empty table gives no rows; a text of any length is read in chunks;
further columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import encoding
from . import textbytes as T
from .shared import bounded_batches, id_and_text

#: States of the machine, and bytes of pieces that go through it together.
STATES, TOGETHER = 1 << 17, 256
#: Words with kept ids, and bytes of text encoded together.
WORDS, CHUNK_BYTES = 150_000, 2 << 20
#: States by which the table grows.
ROWS = 1 << 12
#: Bytes of a piece after which settled tokens are emitted.
EMIT_BYTES = 4096
#: With so many tokens below a node, a thread keeps which of them fit instead of the token before.
FEW = 16
#: Pieces or ids handled at once, and characters in a batch of texts.
CHUNK, BATCH_TEXT = 1 << 16, 1 << 20
ENCODED = "doc_id long, ids array<int>"
DECODED = "doc_id long, ids array<int>, text string"


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank: a line has a token in base 64 and its rank."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be numbered from 0")
    return [found[i] for i in range(len(found))]


class Transducer:
    """Pieces of text to ids."""

    def __init__(self, tokens: list[bytes], states: int = STATES):
        self.tokens, self.most = tokens, states
        self.rank, self.length = {t: i for i, t in enumerate(tokens)}, list(map(len, tokens))
        self.lengths = np.array(self.length)
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.halves: dict[int, tuple[int, int]] = {}  # the last merge of a token
        self.edges: tuple[dict, dict] = ({}, {})
        made = []  # tokens that merges lead to; another can only be a whole piece
        for number, token in enumerate(tokens):
            parts, halves = self.merged(token)
            if parts == [number]:
                made.append(number)
                if halves:
                    self.halves[number] = halves
        reached = set(made)
        self.unmade = {t: i for i, t in enumerate(tokens) if i not in reached}
        #: Whether a token is always made after its halves, as the ranks say.
        self.ordered = all(self.length[h] == 1 or h < t for t, both in self.halves.items() for h in both)
        #: The trie, in the order of its tokens' bytes: those below a node are a range of ``order``.
        self.order = sorted(made, key=tokens.__getitem__)
        self.child: dict[int, int] = {}  # (node, byte) to node
        self.ends, self.depth, self.below = [-1], [0], [[0, len(self.order)]]  # of a node: its token, its bytes, and the longer tokens
        for place, number in enumerate(self.order):
            node = 0
            for b in tokens[number]:
                self.below[node][1] = place + 1
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    self.below.append([place + 1, place + 1])
                node = self.child[key]
            self.ends[node] = number
        for node, token in enumerate(self.ends):
            if token < 0:
                self.below[node][0] -= 1  # the first token below made this node
        self.below[0][0] = 0
        self._start()

    def _start(self) -> None:
        self.thread_number: dict[tuple, int] = {}
        self.threads: list[tuple] = []
        self.moves: dict[int, int] = {}  # both answers of _move in one number
        first = (self._thread(0, -1, None),)
        self.number, self.states = {first: 0}, [first]
        #: By state: the next state for each byte that was met (-1: not asked for yet), and the token that ended with the last one.
        self.column = np.full(256, -1, np.int64)
        self.table, self.ended = np.full((ROWS, 32), -1, np.int32), np.full(ROWS, -1, np.int32)

    def _thread(self, node: int, before: int, fitting: tuple | None) -> int:
        """The number of a thread: at a node, with the token before it, or, where few tokens are below, with those of them that fit."""
        key = (node, before if fitting is None else fitting)
        if key not in self.thread_number:
            self.thread_number[key] = len(self.threads)
            self.threads.append((node, before, fitting))
        return self.thread_number[key]

    def _move(self, thread: int, byte: int) -> tuple[int, int]:
        """The thread behind a byte, and the token that may end there; -1 for none."""
        node, before, fitting = self.threads[thread]
        at = self.child.get(node << 8 | byte)
        if at is None:
            return -1, -1
        token = self.ends[at]
        if token >= 0 and not ((before < 0 or self.fits(before, token)) if fitting is None else token in fitting):
            token = -1
        low, high = self.below[at]
        if fitting is not None:
            inside = set(self.order[low:high])
            fitting = tuple(t for t in fitting if t in inside)
        elif high - low <= FEW:
            fitting = tuple(t for t in self.order[low:high] if before < 0 or self.fits(before, t))
        return (-1 if fitting == () else self._thread(at, before, fitting)), token

    def merged(self, raw: bytes) -> tuple[list[int], tuple[int, int] | None]:
        """The definition: of all neighbours that form a token the pair of least rank is merged, the first of equals.  The tokens, and the last pair."""
        parts, pair, none = [raw[i : i + 1] for i in range(len(raw))], None, len(self.tokens)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            pair = (self.rank[parts[i]], self.rank[parts[i + 1]])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts], pair

    def _edge(self, token: int, side: int) -> list[int]:
        """What stood at one end of a token, from its byte there to itself, and then a number above all."""
        out = self.edges[side].get(token)
        if out is None:
            out = [len(self.tokens), token]
            while out[-1] in self.halves:
                out.append(self.halves[out[-1]][side])
            out = self.edges[side][token] = out[::-1]
        return out

    def fits(self, before: int, token: int) -> bool:
        """Whether both stay as they are when they are merged together."""
        return self._apart(before, token) if self.ordered else self.merged(self.tokens[before] + self.tokens[token])[0] == [before, token]

    def _apart(self, before: int, token: int) -> bool:
        """The same without merging: at no time do the neighbours at the boundary form a token that is due before either is merged away."""
        never = len(self.tokens)
        a, b = self._edge(before, 1), self._edge(token, 0)
        i = j = 0
        while True:
            over = self.rank.get(self.tokens[a[i]] + self.tokens[b[j]], never)
            if over < a[i + 1] and over <= b[j + 1] and over < never:
                return False
            if a[i + 1] == never and b[j + 1] == never:
                return True
            if a[i + 1] <= b[j + 1]:
                i += 1
            else:
                j += 1

    def _grow(self, state: int, byte: int) -> int:
        """The state behind a transition that no text has taken yet."""
        live, new = [], -1
        for thread in self.states[state]:
            key = thread << 8 | byte
            got = self.moves.get(key)
            if got is None:
                then, token = self._move(thread, byte)
                got = self.moves[key] = (then + 1) << 32 | token + 1
            if got >> 32:
                live.append((got >> 32) - 1)
            if new < 0:
                new = (got & 0xFFFFFFFF) - 1
        key = (*live, self._thread(0, new, None))
        then = self.number.setdefault(key, len(self.states))
        if then == len(self.states):
            self.states.append(key)
            if then == len(self.table):
                self.table = np.concatenate([self.table, np.full((ROWS, self.table.shape[1]), -1, np.int32)])
                self.ended = np.concatenate([self.ended, np.full(ROWS, -1, np.int32)])
            self.ended[then] = new
        self.table[state, self.column[byte]] = then
        return then

    def _met(self, raw: np.ndarray) -> None:
        """Gives bytes that are new a column."""
        new = np.flatnonzero(np.bincount(raw, minlength=256).astype(bool) & (self.column < 0))
        used = int(self.column.max()) + 1
        self.column[new] = np.arange(used, used + len(new))
        more = -(-(used + len(new) - self.table.shape[1]) // 32) * 32
        if more > 0:
            self.table = np.concatenate([self.table, np.full((len(self.table), more), -1, np.int32)], axis=1)

    def _settled(self, state: int, ends: list[int]) -> int:
        """How many bytes the live threads agree on: where the ways back from their beginnings meet."""
        at = sorted({len(ends) - self.depth[self.threads[thread][0]] for thread in self.states[state]})
        while len(at) > 1:
            last = at.pop()
            back = last - self.length[ends[last - 1]]
            if back not in at:
                at = sorted([*at, back])
        return at[0]

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens of the first bytes, by the token that ends at each."""
        out = []
        while at:
            token = ends[at - 1]
            out.append(token)
            at -= self.length[token]
        return out[::-1]

    def ids(self, piece: bytes) -> list[int]:
        """One piece of any length."""
        if piece in self.unmade:
            return [self.unmade[piece]]
        if len(self.states) >= self.most:
            self._start()
        self._met(np.frombuffer(piece, np.uint8))
        state, out, ends = 0, [], []
        for b in piece:
            then = int(self.table[state, self.column[b]])
            state = then if then >= 0 else self._grow(state, b)
            ends.append(int(self.ended[state]))
            if len(ends) >= EMIT_BYTES:
                settled = self._settled(state, ends)
                out += self._back(ends, settled)
                del ends[:settled]
                if len(self.states) >= self.most:  # the threads stay, under new numbers
                    kept = [self.threads[thread] for thread in self.states[state]]
                    self._start()
                    self._met(np.frombuffer(piece, np.uint8))
                    key = tuple(self._thread(*thread) for thread in kept)
                    state = self.number[key] = len(self.states)
                    self.states.append(key)
        return out + self._back(ends, len(ends))

    def many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and each one's number of ids: short pieces go through the machine together, a byte at a time."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        count, found = np.zeros(len(pieces), np.int64), []
        apart = size > TOGETHER
        if self.unmade:
            apart |= np.fromiter((p in self.unmade for p in pieces), bool, len(pieces))
        for i in np.flatnonzero(apart).tolist():
            ids = self.ids(pieces[i])
            count[i] = len(ids)
            found.append((np.full(len(ids), i), np.arange(len(ids)), np.array(ids, np.int64)))
        short = np.flatnonzero(~apart)
        short = short[np.argsort(-size[short], kind="stable")]
        if len(self.states) >= self.most:
            self._start()
        n = size[short]
        raw, first = np.frombuffer(b"".join([pieces[i] for i in short.tolist()]), np.uint8), np.cumsum(n) - n
        self._met(raw)
        ends, state = np.zeros(len(raw), np.int32), np.zeros(len(short), np.int32)
        for k in range(int(n.max()) if len(n) else 0):
            alive = int(np.searchsorted(-n, -k, "left"))  # those longer than k
            here, byte = state[:alive], raw[first[:alive] + k]
            then = self.table[here, self.column[byte]]
            if (then < 0).any():
                for key in np.unique(here[then < 0].astype(np.int64) << 8 | byte[then < 0]).tolist():
                    self._grow(key >> 8, key & 255)
                then = self.table[here, self.column[byte]]
            state[:alive] = then
            ends[first[:alive] + k] = self.ended[then]
        at, place = n.copy(), 0
        live = np.flatnonzero(at > 0)
        while len(live):
            token = ends[first[live] + at[live] - 1]
            found.append((short[live], np.full(len(live), -1 - place), token))
            count[short[live]] += 1
            at[live] -= self.lengths[token]
            live = live[at[live] > 0]
            place += 1
        start = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.uint32)
        for piece, where, token in found:  # places of short pieces count from the end
            out[np.where(where < 0, start[piece] + count[piece], start[piece]) + where] = token
        return out, count


def _same_class(characters: str, class_name: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points that the tokenizer library and this worker's regular expressions put into a class."""
    import regex
    import tiktoken

    single = tiktoken.Encoding("bytes", pat_str=class_name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    theirs, ours = bytes(single.encode_ordinary(characters)).decode(), "".join(regex.findall(class_name, characters))
    return tuple(np.frombuffer(x.encode("utf-32-le"), "<u4") for x in (theirs, ours))


def _stand_ins(characters: str) -> dict[int, str]:
    """For characters whose class differs, one of the class that they have in the tokenizer library."""
    found: dict[int, str] = {}
    names = {r"\p{L}": "x", r"\p{N}": "0", r"\s": " "}
    classes = {name: _same_class(characters, name) for name in names}
    for theirs, ours in classes.values():
        found |= dict.fromkeys(np.setxor1d(theirs, ours).tolist(), "~")
    for name, stand_in in names.items():
        found |= {c: stand_in for c in np.intersect1d(classes[name][0], np.fromiter(found, np.uint32, len(found))).tolist()}
    return found


class Splitter:
    """A text's pieces: the matches of the pattern, as the tokenizer library finds them."""

    def __init__(self, pattern: str):
        import regex

        self.pattern = regex.compile(pattern)
        self.low = _stand_ins("".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000)))))
        self.high: dict[int, str] | None = None
        self.odd = regex.compile(f"[{''.join(map(regex.escape, map(chr, self.low)))}\U00010000-\U0010ffff]")

    def pieces(self, text: str) -> Iterator[list[str]]:
        """All pieces, in lists of bounded length."""
        if not text.isascii() and self.odd.search(text):
            if self.high is None:
                self.high = _stand_ins("".join(map(chr, range(0x10000, 0x110000))))
            found = (text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.low | self.high)))
        elif len(text) <= CHUNK:
            yield self.pattern.findall(text)
            return
        else:
            found = (m[0] for m in self.pattern.finditer(text))
        while some := list(islice(found, CHUNK)):
            yield some


class _Words(encoding._Known):
    """Words with their ids; all are learned anew when they are too many."""

    def numbers(self, parts: list[str]) -> np.ndarray:
        if len(self.number) > WORDS:
            self.__init__(self.learn)
        return super().numbers(parts)


class Encoder(encoding.Encoder):
    """Texts cut at spaces that begin a piece, as for the other byte-level tokenizer; ids of the parts by the machine."""

    def __init__(self, path: str, pattern: str):
        self.machine, self.splitter = Transducer(read_ranks(path)), Splitter(pattern)
        self.spaced, self.added = True, []
        self.words, self.heads = _Words(self._learn), _Words(self._whole)

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        """The worker's encoder."""
        if (path, pattern) not in cls._kept:
            cls._kept[path, pattern] = cls(path, pattern)
        return cls._kept[path, pattern]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes, some, owner = [], np.zeros(len(texts), np.int64), [], []

        def go() -> None:
            got, count = self.machine.many(some)
            ids.append(got)
            np.add.at(sizes, owner, count)
            some.clear()
            owner.clear()

        for i, text in enumerate(texts):
            for pieces in self.splitter.pieces(text):
                some.extend([p.encode() for p in pieces])
                owner.extend([i] * len(pieces))
                if len(some) >= CHUNK:
                    go()
        go()
        return np.concatenate(ids), sizes

    def _learn(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._whole([" " + p for p in parts])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of each row's whole text, by the rank file at ``path`` and the pattern that cuts texts into pieces."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path, pattern)
        for batch in it:
            texts = batch.column("text")
            for a, b in T.chunks(T.flat(texts)[1], CHUNK_BYTES):
                ids, count = encoder.encode(texts.slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, ENCODED)


def _machine() -> np.ndarray:
    """Next states of the UTF-8 machine by state and byte, from the table of well-formed sequences.

    0: between characters; 1: ill-formed; 2 to 4: one, two or three bytes are missing; 5 to 8: the same behind a lead whose second byte has narrower bounds.
    """
    table = np.ones((9, 256), np.uint8)
    # lead bytes from, to, and the state behind them
    for low, high, state in ((0x00, 0x7F, 0), (0xC2, 0xDF, 2), (0xE0, 0xE0, 5), (0xE1, 0xEC, 3), (0xED, 0xED, 6), (0xEE, 0xEF, 3), (0xF0, 0xF0, 7), (0xF1, 0xF3, 4), (0xF4, 0xF4, 8)):
        table[0, low : high + 1] = state
    # a state, the bounds of its byte, and the state behind it
    for state, low, high, then in ((2, 0x80, 0xBF, 0), (3, 0x80, 0xBF, 2), (4, 0x80, 0xBF, 3), (5, 0xA0, 0xBF, 2), (6, 0x80, 0x9F, 2), (7, 0x90, 0xBF, 3), (8, 0x80, 0x8F, 3)):
        table[state, low : high + 1] = then
    return table


MACHINE = _machine().tolist()


class TextStream:
    """Bytes in any cut to text: ``feed`` gives the characters that are complete, ``finish`` what is left."""

    def __init__(self):
        self.held = b""

    def feed(self, raw: bytes) -> str:
        raw = self.held + raw
        lead = len(raw) - 1  # of the last character: behind it are continuation bytes only, three at most in a well-formed text
        while lead > len(raw) - 4 and lead > 0 and raw[lead] & 0xC0 == 0x80:
            lead -= 1
        state = 0
        for b in raw[max(lead, 0) :]:
            state = MACHINE[state][b]
        cut = lead if state > 1 else len(raw)
        self.held = raw[cut:]
        return raw[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids) with the text that the ids decode to."""
    bounded_batches(encoded.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(read_ranks(path), pa.large_binary())
        for batch in it:
            lists = batch.column("ids")
            texts, size, first = [], 0, 0
            for i in range(batch.num_rows):
                ids, stream, parts = lists[i].values, TextStream(), []
                for at in range(0, len(ids) if ids is not None else 0, CHUNK):
                    chunk = ids.slice(at, CHUNK)
                    if chunk.null_count or pc.any(pc.or_(pc.less(chunk, 0), pc.greater_equal(chunk, len(tokens)))).as_py():
                        raise ValueError("an id is not in the vocabulary")
                    got = tokens.take(chunk)
                    parts.append(stream.feed(got.buffers()[2].to_pybytes()))
                texts.append("".join([*parts, stream.finish()]))
                size += len(texts[-1])
                if size >= BATCH_TEXT or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(texts)) for c in ("doc_id", "ids")), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])
                    texts, size, first = [], 0, i + 1

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)
