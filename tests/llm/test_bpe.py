"""The transducer against the tokenizer library and the plain definition of merges; the text stream against any cut of bytes."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chirplake.llm import bpe
from chirplake.llm.entries import vocabulary

from .texts import SCHEMA, documents

PATH = vocabulary("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pattern():
    return __import__("public_tokenizers").PATTERN


@pytest.fixture(scope="module")
def library(pattern):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(PATH))}, special_tokens={})


@pytest.fixture(scope="module")
def encoder(pattern):
    return bpe.Encoder.of(PATH, pattern)


def cut(ids, count):
    return [ids[e - n : e].tolist() for n, e in zip(count, count.cumsum(), strict=True)]


def test_random_texts(encoder, library):
    """All planes of Unicode, white space of every sort, contractions; characters whose class differs between the two libraries are met too."""
    rng = random.Random(3)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    pools = [every, every[:128], every[:0x3000], "ab' \n\tstrelvd\x1c\x85　 "]
    texts = ["".join(rng.choice(pools[i % 4]) for _ in range(rng.randrange(40))) for i in range(3000)]
    assert cut(*encoder.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_pieces_of_any_length(encoder, library):
    rng = random.Random(4)
    for text in ("a" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(30_000)), "中文" * 3000, "ab" * bpe.EMIT_BYTES):
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_a_machine_that_starts_anew(library):
    """A bound on states changes no result, within a piece and between pieces."""
    machine = bpe.Transducer(bpe.read_ranks(PATH), states=50)
    rng = random.Random(5)
    pieces = ["".join(rng.choice("etaoinsh") for _ in range(rng.randrange(1, 30))).encode() for _ in range(50)]
    for i in range(0, 50, 10):
        ids, count = machine.many(pieces[i : i + 10])
        assert cut(ids, count) == [machine.merged(p)[0] for p in pieces[i : i + 10]]
    long = "".join(rng.choice("etaoinsh") for _ in range(3 * bpe.EMIT_BYTES))
    assert machine.ids(long.encode()) == library._core_bpe.encode_single_piece(long.encode())


@pytest.mark.parametrize("seed", range(8))
def test_ranks_in_any_order(seed):
    """Vocabularies that no training made, with ranks in any order and tokens that no merges lead to."""
    rng = random.Random(seed)
    longer = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))).encode() for _ in range(40)})
    rng.shuffle(longer)
    machine = bpe.Transducer([bytes([b]) for b in range(256)] + longer)
    for _ in range(300):
        piece = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 25))).encode()
        want = [machine.rank[piece]] if piece in machine.rank else machine.merged(piece)[0]
        assert machine.many([piece])[0].tolist() == want == machine.ids(piece)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=6))
def test_the_stream_does_not_depend_on_the_cut(raw, cuts):
    stream, edges = bpe.TextStream(), sorted({0, len(raw), *(c for c in cuts if c < len(raw))})
    parts = [stream.feed(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    assert "".join(parts) + stream.finish() == raw.decode("utf-8", "replace")


def test_the_stream_holds_back_only_what_is_open():
    stream = bpe.TextStream()
    assert [stream.feed(bytes([b])) for b in "a€😀".encode()] == ["a", "", "", "€", "", "", "", "😀"]


def test_documents(spark, frame, pattern, library):
    rows = [*documents(2), (5, "x " * 200_000), (5, "x " * 200_000), (None, "a  b"), (7, None)]
    table = frame(rows, SCHEMA).selectExpr("*", "'x' AS ids", "1 AS n_tokens", "'y' AS term")
    got = bpe.decode(bpe.encode(table, PATH, pattern), PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(i, library.encode_ordinary(t or ""), t or "") for i, t in rows]
    assert sorted([(r.doc_id, r.ids, r.text) for r in got], key=key) == sorted(want, key=key)
    assert bpe.decode(bpe.encode(frame([], SCHEMA), PATH, pattern), PATH).count() == 0


def test_decoding_ids(spark, frame):
    euro = [bpe.read_ranks(PATH).index(bytes([b])) for b in "€".encode()]
    got = bpe.decode(frame([(1, euro), (2, euro[:2]), (3, None), (4, [])], "doc_id long, ids array<int>"), PATH)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "€"), (2, "�"), (3, ""), (4, "")]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(frame([(1, [60_000])], "doc_id long, ids array<int>"), PATH).collect()


