"""Token-id files: canonical, length-limited Huffman codes of ids.

Writing: documents are range-partitioned and sorted by id; each partition (a
shard) is tokenized once into blocks of whole documents, kept in the shared
folder.  Counts of ids over all blocks (at most one row per id of the
vocabulary) give the code lengths by package-merge, none above ``MAX_BITS``;
the canonical code follows from the lengths alone.  The files hold one row per
block: its documents, its number of ids, the code bits, and the bit offset of
every ``STEP``-th id.  They are Parquet files in one folder per shard,
committed by Spark, so they work in any store and survive lost executors.

Reading: a block is decoded without any other; each checkpoint starts a lane,
and all lanes of a batch advance together, one id a step, by a table of
2^``MAX_BITS`` entries.

Defined cases: a null text is empty and holds the end id only; an empty table
gives no rows; equal rows and equal doc ids are all written, equal ids ordered
by text; a null doc_id comes first; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as T
from .encoding import Encoder, batches
from .shared import Scratch, id_and_text

MAX_BITS, STEP, BLOCK_IDS = 18, 128, 1 << 16
TEXT_PER_SHARD = 64 << 20
BLOCKS = "block int, first_id long, ids binary, docs array<long>, sizes array<int>"
FILES = "shard int, block int, n_ids int, first_id long, docs array<long>, sizes array<int>, marks binary, bits binary"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for symbols with these counts (all above 0), by package-merge."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    assert n <= 1 << limit, "the limit leaves too few codes"
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        level = both[by]
        is_leaf.append(by < n)
    lengths, take = np.zeros(n, np.int64), 2 * (n - 1)
    for flags in reversed(is_leaf):
        k = int(flags[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """The canonical code of ``lengths`` (by symbol; 0: none): codes ascend by length, then by symbol."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((symbols, lengths))
        symbols, lengths = np.asarray(symbols)[order], np.asarray(lengths)[order]
        width = (1 << MAX_BITS) >> lengths
        first = np.cumsum(width) - width
        assert not len(width) or width.sum() <= 1 << MAX_BITS
        top = int(symbols.max()) + 1 if len(symbols) else 0
        self.code, self.length = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code[symbols] = first >> (MAX_BITS - lengths)
        self.length[symbols] = lengths
        self.table = np.zeros(1 << MAX_BITS, np.uint32)
        self.table[: int(width.sum())] = np.repeat(symbols.astype(np.uint32) << 5 | lengths.astype(np.uint32), width)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """The bits, in 32-bit words from the highest bit down, and the bit offset of every STEP-th id."""
        size = self.length[ids]
        end = np.cumsum(size)
        at = end - size
        word = at >> 5
        shifted = self.code[ids] << (64 - (at & 31) - size).astype(np.uint64)
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        summed = np.add.reduceat(shifted, heads)
        out = np.zeros(int(end[-1] >> 5) + 3, np.uint64)
        out[word[heads]] += summed >> np.uint64(32)
        out[word[heads] + 1] += summed & np.uint64(0xFFFFFFFF)
        return at[::STEP].astype("<u4").tobytes(), out.astype("<u4").tobytes()

    def decode(self, blocks: list[tuple[int, bytes, bytes]]) -> list[np.ndarray]:
        """The ids of blocks (number of ids, marks, bits)."""
        words, lane_at, lane_ids, base = [], [], [], 0
        for n, marks, bits in blocks:
            w = np.frombuffer(bits, "<u4")
            m = np.frombuffer(marks, "<u4").astype(np.int64)
            lane_at.append(m + base * 32)
            lane_ids.append(np.minimum(STEP, n - np.arange(len(m)) * STEP))
            words.append(w)
            base += len(w)
        if not blocks:
            return []
        w = np.concatenate(words).astype(np.uint64)
        wide = (w[:-1] << np.uint64(32)) | w[1:]
        at, left = np.concatenate(lane_at), np.concatenate(lane_ids)
        out = np.zeros((STEP, len(at)), np.uint32)
        full, mask = int(left.min()) if len(left) else 0, np.uint64((1 << MAX_BITS) - 1)
        for step in range(STEP):
            live = slice(None) if step < full else np.flatnonzero(left > step)
            p = at[live]
            got = self.table[(wide[p >> 5] >> (64 - MAX_BITS - (p & 31)).astype(np.uint64)) & mask]
            out[step, live] = got >> 5
            at[live] += got & 31
        lanes, done = np.cumsum([0] + [len(x) for x in lane_at]), []
        for i, (n, _, _) in enumerate(blocks):
            done.append(out[:, lanes[i] : lanes[i + 1]].T.reshape(-1)[:n])
        return done


def _tokenize(path: str, end_id: int):
    """Sorted (doc_id, text) to blocks of whole documents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, first, held, docs, sizes, total = Encoder.of(path, spaced=True), 0, 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([ids.astype("<u2" if ids.max() < 65536 else "<u4").tobytes()], pa.binary()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32()))], names=["block", "first_id", "ids", "docs", "sizes"])

        for batch in it:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for a, b in batches(texts):
                ids, count = encoder.encode(texts.slice(a, b - a))
                ends = np.cumsum(count)
                ids = np.insert(ids, ends, end_id)
                lo = 0
                for j, hi in enumerate((ends + np.arange(1, len(ends) + 1)).tolist()):
                    docs.append(doc_ids[a + j])
                    sizes.append(int(count[j]) + 1)
                    total += sizes[-1]
                    if total >= BLOCK_IDS or j == len(ends) - 1:
                        held.append(ids[lo:hi])
                        lo = hi
                    if total >= BLOCK_IDS:
                        yield block()
                        number, first, held, docs, sizes, total = number + 1, first + total, [], [], [], 0
        if docs:
            yield block()

    return run


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in it:
        for raw, sizes in zip(batch.column("ids").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
            got = np.bincount(_ids(raw, sum(sizes)), minlength=len(total))
            got[: len(total)] += total
            total = got
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])


def write(docs: DataFrame, scratch: Scratch, path: str, end_id: int = 0, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Writes the files; returns them (see FILES) and the code book (id, length), both as read back."""
    spark = docs.sparkSession
    rows = id_and_text(docs)
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TEXT_PER_SHARD))
    blocks = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(_tokenize(path, end_id), BLOCKS)
    blocks = scratch.write(blocks.select(F.spark_partition_id().alias("shard"), "*"), "blocks")
    counts = blocks.select("ids", "sizes").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = counts.column("id").to_numpy(), counts.column("n").to_numpy()
    order = np.argsort(ids)
    lengths = code_lengths(n[order])
    book = spark.createDataFrame(list(zip(ids[order].tolist(), lengths.tolist(), strict=True)), "id long, length int")
    book = scratch.write(book.coalesce(1), "codebook")
    held = spark.sparkContext.broadcast((ids[order], lengths))

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*held.value)
        for batch in it:
            for row in batch.to_pylist():
                total = sum(row["sizes"])
                marks, bits = code.encode(_ids(row["ids"], total))
                one = {"shard": row["shard"], "block": row["block"], "n_ids": total, "first_id": row["first_id"], "docs": row["docs"], "sizes": row["sizes"], "marks": marks, "bits": bits}
                yield pa.RecordBatch.from_pylist([one], schema=ARROW)

    files = blocks.sortWithinPartitions("shard", "block").mapInArrow(encode, FILES)
    out = f"{scratch.root}/files"
    files.sortWithinPartitions("shard", "block").write.partitionBy("shard").option("compression", "none").parquet(out)
    return spark.read.schema(FILES).parquet(out), book


ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int32()), ("first_id", pa.int64()), ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("marks", pa.binary()), ("bits", pa.binary())])


def read(files: DataFrame, book: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, and the ids' crc32."""
    got = book.toArrow()  # a row per id of the vocabulary
    spark = files.sparkSession
    code = spark.sparkContext.broadcast((got.column("id").to_numpy(), got.column("length").to_numpy()))
    sums = files.groupBy("shard", "block").agg(F.sum("n_ids").alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").toArrow()  # a row per shard
    shard, n = sums.column("shard").to_numpy(), sums.column("n").to_numpy()
    before = dict(zip(shard.tolist(), (np.cumsum(n) - n).tolist(), strict=True))

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Code(*code.value)
        for batch in it:
            rows = batch.to_pylist()
            for lo in range(0, len(rows), 24):
                part = rows[lo : lo + 24]
                docs, starts, sizes, sums = [], [], [], []
                for row, ids in zip(part, table.decode([(r["n_ids"], r["marks"], r["bits"]) for r in part]), strict=True):
                    raw, at, first = ids.astype("<u4").tobytes(), 0, before[row["shard"]] + row["first_id"]
                    for doc, size in zip(row["docs"], row["sizes"], strict=True):
                        docs.append(doc)
                        starts.append(first + at)
                        sizes.append(size)
                        sums.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("shard", "n_ids", "first_id", "docs", "sizes", "marks", "bits").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
