"""Near-duplicate documents by min-max hashing.

A document is the set of its word shingles.  Under each of ``PERMS``
permutations of the hash space both the smallest and the largest shingle are
kept, two signature values for one evaluation; each equals that of another
document with the probability of their similarity.  Values are banded; two
documents that agree in a band share a bucket.

1. Equal sets form a class (a 128-bit cryptographic digest of the whole sorted
   set, and its size) with its smallest doc id for it.  Only class
   representatives go on.
2. Buckets with two or more representatives: a task gets them by bucket, with
   their signatures, and draws a spanning forest over the pairs whose
   signatures agree in ``PROBABLE`` or more of all values.  A true link agrees
   in 0.8 of them on average; ``PROBABLE`` lies many deviations below.  A
   bucket of more than ``BUCKET`` members is dealt out: its members are all
   joined to its smallest, which can only make the next step's clusters larger.
3. The forests' components are clusters that no link leaves.  A cluster's sets
   meet in one task if they are few.  A larger cluster is cut into blocks, each
   with a few pivots of the cluster, which mostly joins all of it; where it does
   not, the blocks of what is outside its largest component meet each other and
   those of that component.  Links are confirmed on the full sets: 100 * intersection >= 80 * union, counted through an inverted index,
   from each unvisited member on.  Only links that join something go out.
4. The components of the confirmed links, and each class's members, are the
   result.

No pair of copies is ever written, no bucket or cluster is cut short, and
nothing but counts comes to the driver.

Defined cases: null, empty and wordless texts have an empty set and are linked
with nothing; a text of fewer words than a shingle is one shingle; a repeated
doc id is one node with several rows, each answered, and linked by any of its
texts; a null doc id is in no component; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as T
from .components import components, forest
from .shared import Scratch, id_and_text, lean

PERMS, ROWS = 70, 5
BANDS = 2 * PERMS // ROWS
PROBABLE = 0.62
BUCKET, BLOCK, BLOCK_SHINGLES = 1024, 512, 500_000
#: Members of a large cluster that all its blocks are compared with first.
PIVOTS = 4
_MULT = (T._stream(0xAB, PERMS) >> T.U64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (T._stream(0xAC, PERMS) >> T.U64(32)).astype(np.uint32)
SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary"


def shingle_sets(raw: np.ndarray, offs: np.ndarray, a: int, b: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of documents a..b, ascending within each, and their numbers."""
    words = T.Words(raw, offs, a, b, T.NONSPACE)
    g = T.grams(words.hash, k)
    many = np.maximum(words.count - k + 1, 0)
    flat = g[T.ranges(words.first[:-1], many)] if len(g) else np.zeros(0, T.U64)
    edge = np.concatenate([[0], np.cumsum(many)])
    for i in range(b - a):
        flat[edge[i] : edge[i + 1]].sort()
    doc = np.repeat(np.arange(b - a), many)
    keep = np.ones(len(flat), bool)
    keep[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    flat, size = flat[keep], np.bincount(doc[keep], minlength=b - a)
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        at = np.cumsum(size)[short] - size[short]
        one = np.array([T.whole(words.hash[words.first[i] : words.first[i + 1]]) for i in short.tolist()], T.U64)
        flat, size[short] = np.insert(flat, at, one), 1
    return flat, size


def _sign(k: int):
    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, offs = T.flat(batch.column("text"))
            for a, b in T.chunks(offs):
                flat, size = shingle_sets(raw, offs, a, b, k)
                n = b - a
                bands, sketch = np.zeros((n, BANDS), np.int64), np.zeros((n, 2 * PERMS), np.uint8)
                edge = np.concatenate([[0], np.cumsum(size)])
                digests = [hashlib.blake2b(flat[i:j].astype("<u8").data, digest_size=16).digest() if j > i else b"" for i, j in zip(edge.tolist(), edge[1:].tolist(), strict=False)]
                full = np.flatnonzero(size)
                if len(full):
                    starts = edge[full]
                    low = (flat >> T.U64(32)).astype(np.uint32)
                    values = np.empty((len(full), 2 * PERMS), np.uint32)
                    for i in range(PERMS):
                        v = low * _MULT[i] + _ADD[i]
                        values[:, i] = np.minimum.reduceat(v, starts)
                        values[:, PERMS + i] = np.maximum.reduceat(v, starts)
                    sketch[full] = (values * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
                    grouped = values.reshape(len(full), BANDS, ROWS).astype(T.U64)
                    h = np.broadcast_to(T._stream(0xBA, BANDS), (len(full), BANDS)).copy()
                    for r in range(ROWS):
                        h = T.mix(h ^ grouped[:, :, r])
                    bands[full] = h.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, n), pa.array(size, pa.int64()), pa.array(digests, pa.binary()), T.lists(bands[full].reshape(-1), np.where(size > 0, BANDS, 0), pa.int64()), pa.array([x.tobytes() for x in sketch], pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "bands", "sketch"],
                )

    return run


@lean
def _probable(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, part): links of each group's likely forest."""

    def solve(rep: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        for i in range(len(rep) - 1):
            near = (n[i + 1 :] * 100 >= 80 * n[i]) & (n[i] * 100 >= 80 * n[i + 1 :])
            j = np.flatnonzero(near) + i + 1
            if len(j):
                j = j[(sketch[j] == sketch[i]).mean(1) >= PROBABLE]
                a.append(np.full(len(j), i))
                b.append(j)
        if not a:
            return rep[:0], rep[:0]
        label = forest(len(rep), np.concatenate(a), np.concatenate(b))
        at = np.flatnonzero(label != np.arange(len(rep)))
        return rep[at], rep[label[at]]

    held: list = []
    key = None

    def out(groups: list) -> pa.RecordBatch:
        a = np.concatenate([x for x, _ in groups]) if groups else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in groups]) if groups else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def close() -> tuple[np.ndarray, np.ndarray]:
        rep, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        return solve(rep, n, np.concatenate([h[2] for h in held]))

    for batch in it:
        if not batch.num_rows:
            continue
        bucket = batch.column("bucket").to_numpy()
        rep, n = batch.column("rep").to_numpy(), batch.column("n").to_numpy()
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, 2 * PERMS)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        done = []
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if held and bucket[i] != key:
                done.append(close())
                held = []
            key = bucket[i]
            held.append((rep[i:j], n[i:j], sketch[i:j]))
        yield out(done)
    if held:
        yield out([close()])


class _Cluster:
    """Sets of one group: docs, their shingles (numbered within the group), and an inverted index."""

    def __init__(self, docs: list[int], sides: list[int], sets: list[np.ndarray]):
        self.docs, self.side, self.size = np.array(docs), np.array(sides), np.array([len(s) for s in sets])
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.edge = np.concatenate([[0], np.cumsum(self.size)])
        self.owner = np.repeat(np.arange(len(docs)), self.size)
        order = np.argsort(self.flat, kind="stable")
        self.posted = self.owner[order]
        self.posts = np.concatenate([[0], np.cumsum(np.bincount(self.flat))])

    def links(self, percent: int) -> list[tuple[int, int]]:
        """Confirmed links that span each component, looked for from each member among those not yet reached."""
        n, out = len(self.docs), []
        new = np.ones(n, bool)
        for root in range(n):
            if not new[root]:
                continue
            new[root], queue = False, [root]
            while queue:
                i = queue.pop()
                mine = self.flat[self.edge[i] : self.edge[i + 1]]
                lo = self.posts[mine]
                both = np.bincount(self.posted[T.ranges(lo, self.posts[mine + 1] - lo)], minlength=n)
                found = np.flatnonzero(new & (100 * both >= percent * (self.size + self.size[i] - both)) & (both > 0))
                new[found] = False
                out += [(int(self.docs[i]), int(self.docs[j])) for j in found.tolist()]
                queue += found.tolist()
                if not new[root:].any():
                    break
        return out


def _confirm(k: int, percent: int):
    """Rows sorted by (cluster, part), each with a text: confirmed links."""

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, sets = None, [], []

        def close() -> pa.RecordBatch:
            found = _Cluster(docs, [0] * len(docs), sets).links(percent) if len(docs) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

        for batch in it:
            raw, offs = T.flat(batch.column("text"))
            keys = list(zip(batch.column("cluster").to_pylist(), batch.column("part").to_pylist(), strict=True))
            ids = batch.column("doc_id").to_pylist()
            for a, b in T.chunks(offs):
                flat, size = shingle_sets(raw, offs, a, b, k)
                edge = np.concatenate([[0], np.cumsum(size)])
                for i in range(a, b):
                    if keys[i] != key:
                        if docs:
                            yield close()
                        key, docs, sets = keys[i], [], []
                    docs.append(ids[i])
                    sets.append(flat[edge[i - a] : edge[i - a + 1]])
        if docs:
            yield close()

    return run


def _many(members: DataFrame, *by: str) -> DataFrame:
    """Into how many blocks of bounded size a cluster's members (or a part of them) go."""
    size = members.groupBy("cluster", *by).agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    return size.select("cluster", *by, F.greatest(F.ceil(F.col("docs") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))


def _blocks(sized: DataFrame) -> DataFrame:
    """(node, cluster, part): each member in its block, and the cluster's pivots in all of its blocks, so that most of a large cluster is joined at once."""
    placed = sized.join(_many(sized), "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long"))
    pivot = sized.groupBy("cluster").agg(F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(PIVOTS)])).alias("nodes"))
    spread = pivot.join(_many(sized).where("blocks > 1"), "cluster").select("cluster", F.explode("nodes").alias("node"), "blocks")
    spread = spread.select("node", "cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("part"))
    return placed.select("node", "cluster", "part").union(spread).distinct()


def _apart(large: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, cluster, part) of clusters that are not one component yet: blocks of all members but those of the largest component meet each other and that one's blocks.

    Members of the largest component do not meet again: they are joined already.
    """
    known = large.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    size = known.groupBy("cluster", "label").agg(F.count("*").alias("members"))
    most = size.groupBy("cluster").agg(F.max_by("label", F.struct("members", -F.col("label"))).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    cut = known.join(most, "cluster").withColumn("major", F.col("label") == F.col("top")).select("node", "cluster", "n", "major")
    many = _many(cut, "major")
    counts = many.groupBy("cluster").agg(F.max(F.when(F.col("major"), F.col("blocks"))).alias("majors"), F.max(F.when(~F.col("major"), F.col("blocks"))).alias("minors"))
    at = F.pmod(F.xxhash64("node"), F.when(F.col("major"), F.col("majors")).otherwise(F.col("minors"))).cast("long")
    placed = cut.join(counts, "cluster").withColumn("block", at)
    i, minors, majors = F.col("block"), F.col("minors").cast("long"), F.col("majors").cast("long")
    all_of = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # part numbers: minor i and major k meet in i * majors + k; minors i < j behind those
    with_majors = F.transform(all_of(majors), lambda j: i * majors + j)
    with_minors = F.transform(F.filter(all_of(minors), lambda j: j != i), lambda j: minors * majors + F.least(i, j) * minors + F.greatest(i, j))
    parts = F.when(F.col("major"), F.transform(all_of(minors), lambda j: j * majors + i)).otherwise(F.concat(with_majors, with_minors))
    return placed.select("node", "cluster", F.explode(parts).alias("part"))


def _met(texts: DataFrame, placed: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between members that are placed in one part of one cluster."""
    met = texts.join(placed, texts["doc_id"] == placed["node"]).select("cluster", "part", "doc_id", "text")
    return met.repartition("cluster", "part").sortWithinPartitions("cluster", "part", "doc_id").mapInArrow(_confirm(k, percent), "a long, b long")


def classes(docs: DataFrame, scratch: Scratch, k: int = 4, percent: int = 80) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id, kept, and the number of its set's class members."""
    assert percent >= 80, "bands are laid out for similarities of 0.8 or more"
    rows = id_and_text(docs)
    signed = scratch.write(rows.mapInArrow(_sign(k), SIGNED), "signed")
    same = ["digest", "n_shingles"]
    full = signed.where("n_shingles > 0 and doc_id is not null")
    kinds = scratch.write(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "kinds")
    reps = kinds.join(full.withColumnRenamed("doc_id", "rep"), [*same, "rep"]).dropDuplicates([*same, "rep"]).select("rep", F.col("n_shingles").alias("n"), "sketch", "bands")
    reps = scratch.write(reps, "reps")
    bands = reps.select("rep", F.explode("bands").alias("bucket"))
    buckets = bands.groupBy("bucket").agg(F.count("*").alias("members"), F.min("rep").alias("least")).where("members > 1")
    shared = scratch.write(bands.join(buckets, "bucket"), "buckets")
    large = shared.where(F.col("members") > BUCKET).select(F.col("rep").alias("a"), F.col("least").alias("b"))
    small = shared.where(F.col("members") <= BUCKET).select("bucket", "rep").join(reps.select("rep", "n", "sketch"), "rep")
    likely = small.repartition("bucket").sortWithinPartitions("bucket", "rep").mapInArrow(_probable, "a long, b long")
    # links are written before they are joined: two Python steps in one stage take two workers a core, and all of them stay
    likely = scratch.write(likely.union(large), "likely-links")
    clusters = components(likely, scratch, "likely").withColumnRenamed("label", "cluster")
    scratch.drop("buckets", "likely-links")
    sized = scratch.write(clusters.join(reps.groupBy(F.col("rep").alias("node")).agg(F.max("n").alias("n")), "node"), "clusters")
    # the clusters' texts are taken out once; all that follows moves only these
    texts = rows.where("doc_id is not null").join(sized.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    texts = scratch.write(texts, "texts")
    links = scratch.write(_met(texts, _blocks(sized), k, percent), "links-first")
    large = sized.join(_many(sized).where("blocks > 1").select("cluster"), "cluster", "left_semi")
    if not large.isEmpty():
        first = components(links, scratch, "first")
        second = scratch.write(_met(texts, _apart(large, first), k, percent), "links-second")
        links = first.select(F.col("node").alias("a"), F.col("label").alias("b")).union(second)
    # a repeated id joins the classes of all its texts
    several = full.join(kinds.select(*same, "rep"), [*same]).groupBy("doc_id").agg(F.collect_set("rep").alias("reps")).where("size(reps) > 1")
    again = several.select(F.explode("reps").alias("a"), F.array_min("reps").alias("b"))
    labels = components(links.union(again), scratch, "links")
    scratch.drop("reps", "clusters", "texts", "links-first", "links-second")
    named = kinds.join(labels, kinds["rep"] == labels["node"], "left").select(*same, F.coalesce("label", "rep").alias("component"), "copies")
    out = signed.select("doc_id", *same).join(named, [*same], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("copies", F.lit(1)).alias("copies"))


def one_of_each(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns as they are, with one of each group of near duplicates: its smallest doc_id, and one row of that."""
    found = scratch.write(classes(docs, scratch, k, percent), "classes")
    # the same join at every size: the ids that go are not bounded, so they are never broadcast
    gone = found.where(~F.col("kept")).select("doc_id").distinct().hint("merge")
    out = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti").select(*docs.columns).unionByName(docs.where("doc_id is null"))
    ids = found.where("doc_id is not null").agg(F.count("*"), F.count_distinct("doc_id")).first()
    if ids[0] == ids[1]:
        return out
    return out.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id is null"))
