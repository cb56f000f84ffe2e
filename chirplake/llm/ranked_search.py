"""The best documents for each query, by term weights and lengths, exactly and without scoring every document.

A document's score for a query is the sum, over the query's terms, of a weight
of the term times a saturated count of it in the document (whole numbers).
Three phases of uniform thresholds, over postings that are dealt by term:

1. The heads of all lists of a query name some documents; their scores, looked
   up exactly, give a bound that the ``top``-th best score reaches at least.
2. A document with that bound has in one of the query's m lists a part of
   bound / m or more.  From every list all parts from there on are fetched and
   summed.  What a list not met may still add is below the threshold, and no
   more than its head.  Documents that can't reach the bound so go; the bound is
   raised to the ``top``-th best of the sums.
3. What is left is looked up exactly.

Lists are dealt by term and a part of the document's number, as many parts as
the list needs to be of ``PART`` rows, so no list is in one task.  The index by
document, from which exact scores come, holds the terms of the queries alone.
Queries go in slices of ``SLICE_BYTES`` of their text, one after the other, so
the dictionary of their terms that workers get is bounded; a slice reads the
documents once.

Defined cases: a null or empty text has no terms and no score, in a document or
a query; each row of documents is a document of its own, whatever its id, and of
rows of one id all are ranked; equal scores go by ascending id, null first; rows
of queries with the same id are all answered, as one query with the terms of
all; a query without an id is left out; empty tables give no rows; further
columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as T
from .shared import Scratch, bounded_batches, id_and_text

#: Rows of a part of a list, bytes of queries answered together, bytes of a text whose terms are counted at once.
PART, SLICE_BYTES, TEXT_BYTES = 1 << 16, 4 << 20, 1 << 20
#: Terms looked up at once.
LOOKUPS = 1 << 21
#: Parts in which a query's candidates are ranked before the last few are.
RANKED_IN = 32
#: Term bytes: digits, letters (A-Z as a-z) and all that is not ASCII; others separate.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
FORWARD = "doc_id long, n long, terms array<int>, counts array<long>"


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """All terms of a UTF-8 text, in lists of bounded length."""
    spaced = (text or b"").translate(_TERMS)
    at = 0
    while at < len(spaced):
        end = spaced.find(b" ", at + TEXT_BYTES) if len(spaced) - at > TEXT_BYTES else -1
        end = len(spaced) if end < 0 else end
        yield spaced[at:end].split()
        at = end


def _binary(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.col("text").cast("binary"))


def query_terms(queries: DataFrame, id_col: str = "item_id") -> DataFrame:
    """(item, term, times) of all queries."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found: Counter = Counter()
                for some in terms_of(text):
                    found.update(some)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["item", "term", "times"])

    rows = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col("text").cast("string").alias("text"))
    return _binary(rows).mapInArrow(run, "item long, term binary, times long").groupBy("item", "term").agg(F.sum("times").alias("times"))


def forward_index(docs: DataFrame, words: list[bytes], scratch: Scratch, name: str) -> DataFrame:
    """Per row of documents: its number, id, number of terms, and the places in ``words`` and counts of the terms that are there."""
    held = docs.sparkSession.sparkContext.broadcast(words)  # the terms of a slice of queries

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(held.value)}.get
        for batch in it:
            sizes, terms, counts, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                found, n = Counter(), 0
                for some in terms_of(text):
                    n += len(some)
                    found.update(map(place, some))
                found.pop(None, None)
                at = sorted(found)
                sizes.append(n)
                terms += at
                counts += [found[i] for i in at]
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    rows = _binary(id_and_text(docs)).mapInArrow(run, FORWARD).where("n > 0")
    return scratch.write(rows.withColumn("row", F.monotonically_increasing_id()), name)


def _best(rows: DataFrame, value: str, top: int) -> DataFrame:
    """The ``top`` rows of each query by ``value``, of equal ones those of the smallest ids: the best of parts, then of all."""
    order = [F.col(value).desc(), F.col("doc_id").asc_nulls_first() if "doc_id" in rows.columns else F.col("row"), F.col("row")]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    some = rows.withColumn("_part", F.pmod("row", F.lit(RANKED_IN))).withColumn("_place", place("q", "_part")).where(F.col("_place") <= top)
    return some.withColumn("rank", place("q")).where(F.col("rank") <= top).drop("_part", "_place")


class Slice:
    """Queries that are answered together, their lists, and what the index knows of them."""

    def __init__(self, queries: DataFrame, docs: DataFrame, scratch: Scratch, name: str, top: int):
        self.spark, self.scratch, self.name, self.top = docs.sparkSession, scratch, name, top
        got = queries.toArrow()  # at most the terms of SLICE_BYTES
        items, words = got.column("item").to_numpy(), got.column("term").to_pylist()
        self.words = sorted(set(words))
        place = {w: i for i, w in enumerate(self.words)}
        term = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        self.items, q = np.unique(items, return_inverse=True)
        self.forward = forward_index(docs, self.words, scratch, f"{name}-forward")
        sums = self.forward.agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()  # one row
        self.docs, self.total = sums["docs"], sums["total"] or 0
        holding = np.zeros(len(self.words), np.int64)
        for row in self.forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row per term of the slice
            holding[row["term"]] = row["count"]
        self.holding = holding
        weight = np.array([math.floor(1000 * math.log((2 * self.docs + 2) / (2 * n + 1))) for n in holding.tolist()], np.int64)
        weight = weight[term] * got.column("times").to_numpy()
        useful = (weight > 0) & (holding[term] > 0)
        order = np.lexsort((term[useful], q[useful]))
        self.q, self.term, self.weight = (x[useful][order] for x in (q, term, weight))

    def frame(self, schema: str, *columns) -> DataFrame:
        """A table from arrays that the slice bounds."""
        names = [c.split()[0] for c in schema.split(", ")]
        return self.spark.createDataFrame(pa.table(dict(zip(names, map(pa.array, columns), strict=True)))).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")])

    def postings(self) -> DataFrame:
        """(term, row, part_of_score, place): all lists of the slice, dealt by term and part of it, with the places in each part from the highest on."""
        lists = self.frame("term int, parts int", np.arange(len(self.words)), 1 + self.holding // PART)
        each = self.forward.select("row", "n", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("row", F.col("x.terms").alias("term"), F.expr(f"(1000000000L * x.counts) div (1000L * x.counts + 8L * (25L + (75L * n * {self.docs}L) div {max(self.total, 1)}L))").alias("saturated"))
        dealt = each.join(F.broadcast(lists), "term").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")
        by = Window.partitionBy("term", "part").orderBy(F.col("saturated").desc(), "row")
        return self.scratch.write(dealt.withColumn("place", F.row_number().over(by)).drop("part"), f"{self.name}-postings")

    def scores(self, pairs: DataFrame) -> DataFrame:
        """(q, row, doc_id, score) of pairs (q, row), looked up in the index by document."""
        width, docs, total = max(len(self.words), 1), self.docs, max(self.total, 1)
        held = self.spark.sparkContext.broadcast((np.searchsorted(self.q, np.arange(len(self.items) + 1)), self.term, self.weight))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            edge, terms, weights = held.value
            for batch in it:
                lists, asked = batch.column("terms"), batch.column("asked")
                size, wanted = np.diff(lists.offsets.to_numpy()), np.diff(asked.offsets.to_numpy())
                count, n = batch.column("counts").flatten().to_numpy(), np.repeat(batch.column("n").to_numpy(), size)
                saturated = (1_000_000_000 * count) // (1000 * count + 8 * (25 + (75 * n * docs) // total))
                keys = np.repeat(np.arange(batch.num_rows), size) * width + lists.flatten().to_numpy()
                where, q = np.repeat(np.arange(batch.num_rows), wanted), asked.flatten().to_numpy()
                row, doc = batch.column("row").to_numpy(), batch.column("doc_id")
                for a, b in T.chunks(np.concatenate([[0], np.cumsum(edge[q + 1] - edge[q])]), LOOKUPS):
                    there, which = where[a:b], q[a:b]
                    each = edge[which + 1] - edge[which]
                    at = T.ranges(edge[which], each)
                    key = np.repeat(there, each) * width + terms[at]
                    found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    part = np.where(keys[found] == key, weights[at] * saturated[found], 0)
                    total_of = np.add.reduceat(part, np.cumsum(each) - each)
                    yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(row[there]), doc.take(pa.array(there)), pa.array(total_of)], names=["q", "row", "doc_id", "score"])

        by_row = pairs.groupBy("row").agg(F.collect_list("q").alias("asked"))  # at most the queries of the slice
        return self.forward.join(by_row, "row").mapInArrow(run, "q int, row long, doc_id long, score long")

    def bound(self, rows: DataFrame, value: str) -> np.ndarray:
        """Of each query the least ``value`` of its best rows; 0 where they are fewer than ``top``."""
        out = np.zeros(len(self.items), np.int64)
        for row in _best(rows, value, self.top).groupBy("q").agg(F.min(value).alias("least"), F.count("*").alias("n")).collect():  # a row per query of the slice
            out[row["q"]] = row["least"] if row["n"] >= self.top else 0
        return out

    def answer(self) -> DataFrame:
        """(q, row, doc_id, score, rank)"""
        lists = self.postings()
        # 1: heads of the lists, and what their documents score
        heads = self.scratch.write(lists.where(F.col("place") <= self.top), f"{self.name}-heads")
        head = np.zeros(len(self.words), np.int64)
        for row in heads.groupBy("term").agg(F.max("saturated").alias("most")).collect():  # a row per term of the slice
            head[row["term"]] = row["most"]
        asked = self.frame("q int, term int, weight long", self.q, self.term, self.weight)
        named = heads.join(F.broadcast(asked), "term").select("q", "row").distinct()
        least = self.bound(self.scores(named), "score")
        # 2: from every list what is not below an equal share of the bound
        n_lists = np.bincount(self.q, minlength=len(self.items))
        share = (least // np.maximum(n_lists, 1))[self.q]
        rest = np.minimum(np.maximum(share - 1, 0), self.weight * head[self.term])  # what a list not met may add
        room = np.zeros(len(self.items), np.int64)
        np.add.at(room, self.q, rest)
        wanted = self.frame("q int, term int, weight long, rest long, from long", self.q, self.term, self.weight, rest, -(-share // self.weight))
        parts = lists.join(F.broadcast(wanted), "term").where(F.col("saturated") >= F.col("from"))
        sums = parts.groupBy("q", "row").agg(F.sum(F.col("weight") * F.col("saturated")).alias("sum"), F.sum(F.col("weight") * F.col("saturated") - F.col("rest")).alias("above"))
        per = lambda bound: F.broadcast(self.frame("q int, need long", np.arange(len(self.items)), bound - room))
        left = self.scratch.write(sums.join(per(least), "q").where(F.col("above") >= F.col("need")).drop("need"), f"{self.name}-left")
        least = np.maximum(least, self.bound(left, "sum"))
        left = left.join(per(least), "q").where(F.col("above") >= F.col("need"))
        # 3: exact scores of what is left
        return _best(self.scores(left.select("q", "row")).where("score > 0"), "score", self.top)


def search(queries: DataFrame, docs: DataFrame, scratch: Scratch, top: int = 10, id_col: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): each query's ``top`` documents with a score above 0, the best first."""
    bounded_batches(docs.sparkSession)
    asked = scratch.write(query_terms(queries, id_col), "queries")
    size = asked.agg(F.sum(F.length("term") + 8)).first()[0] or 0
    slices, out = max(1, -(-size // SLICE_BYTES)), []
    for i in range(slices):
        one = Slice(asked.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == i), docs, scratch, f"slice-{i}", top)
        if len(one.q):
            names = one.frame("q int, item_id long", np.arange(len(one.items)), one.items)
            out.append(one.answer().join(F.broadcast(names), "q").select(F.col("item_id").alias(id_col), F.col("rank").cast("int"), "doc_id", "score"))
    if not out:
        return docs.sparkSession.createDataFrame([], f"{id_col} long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)
