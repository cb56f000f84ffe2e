"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other.  Each is a logistic regression
over the words of a text and over the first letters of its words, marked
present or not; a later one also sees the earlier categories' probabilities.
In training these come from models that did not see the document: the rows are
dealt into folds, and each fold is predicted by models of the others.  The
threshold of a category is taken from its out-of-fold predictions.

The models are fitted on the driver, on at most ``MAX_ROWS`` labelled documents
(drawn by a hash of their ids) and ``MAX_FEATURES`` features a category, so
what comes there is bounded.  All documents are scored, whole, by table
look-ups over hashed words.

Defined cases: null and empty texts have no features and get the models' base
rates; without labelled documents, or with one class only, a category's
probability is its (smoothed) rate and nothing is above the threshold; of
repeated labels the largest counts; labels of unknown documents and null labels
are left out; equal rows get equal scores; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as T
from .shared import id_and_text, lean

#: Labelled documents used, folds, hash space and features kept per category.  More features fit noise: of 9,000
#: labelled documents, fitted on 6,000, the held-out F1 of toxic is 0.998 as here, 0.997 without the two gates below
#: (LEAST_DOCS and a score of 3), 0.988 without them and with 12,000 features (low_quality: 0.58, 0.58, 0.64).
MAX_ROWS, FOLDS, HASH_BITS, MAX_FEATURES = 12_000, 5, 20, 3000
#: Features in fewer of the labelled documents tell nothing and are left out.
LEAST_DOCS = 3
#: Lengths of word beginnings (in bytes) that are features beside the whole word.
PREFIXES = (4, 5, 6)
STEPS, L2 = 150, 1e-4


@dataclass(frozen=True)
class Category:
    """A category, and the label expression that is 1 for its documents."""

    name: str
    label: str


#: In the order of the chain.
CHAIN = (Category("low_quality", "1 - quality"), Category("toxic", "toxic"))


def features(words: T.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, feature) of words and of their beginnings; repeated ones are not taken out."""
    shift, doc = T.U64(64 - HASH_BITS), words.doc()
    yield doc, (words.hash >> shift).astype(np.int64)
    n = len(words.bytes)
    up, down = T._powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, T.U64)
        np.cumsum(T._BYTE[words.bytes] * up[:n], out=total[1:])
        for size in PREFIXES:
            long = np.flatnonzero(words.end - words.start > size)
            s = words.start[long]
            yield doc[long], (T.mix((total[s + size] - total[s]) * down[s] + T.U64(size << 32)) >> shift).astype(np.int64)


@lean
def _train_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        raw, offs = T.flat(batch.column("text"))
        for a, b in T.chunks(offs):
            words = T.Words(raw, offs, a, b, T.ALNUM)
            pairs = np.unique(np.concatenate([(d << HASH_BITS) | f for d, f in features(words)]))
            size = np.bincount(pairs >> HASH_BITS, minlength=b - a)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("labels"), T.lists((pairs & ((1 << HASH_BITS) - 1)).astype(np.int32), size, pa.int32())], names=["doc_id", "labels", "features"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Rows:
    """Sparse rows: features of row i are ``flat[edge[i]:edge[i + 1]]``."""

    edge: np.ndarray
    flat: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        size = self.edge[rows + 1] - self.edge[rows]
        return Rows(np.concatenate([[0], np.cumsum(size)]), self.flat[T.ranges(self.edge[rows], size)])

    def only(self, keep: np.ndarray) -> Rows:
        """Without the entries that ``keep`` marks as false."""
        return Rows(np.concatenate([[0], np.cumsum(keep)])[self.edge], self.flat[keep])

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.edge) - 1, dtype=np.int32), np.diff(self.edge))


@dataclass
class Model:
    """A linear model: features in ascending order, their weights, weights of earlier probabilities, bias."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float
    threshold: float = 0.5

    def predict(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        z = np.full(len(rows.edge) - 1, self.bias) + earlier @ self.earlier
        if len(self.features):
            at = np.minimum(np.searchsorted(self.features, rows.flat), len(self.features) - 1)
            hit = self.features[at] == rows.flat
            z += np.bincount(rows.owner()[hit], weights=self.weights[at[hit]], minlength=len(z))
        return _sigmoid(z)


def fit(rows: Rows, y: np.ndarray, earlier: np.ndarray) -> Model:
    """Logistic regression with momentum, on the features whose document shares differ most surely between the classes."""
    n, good = len(y), float(y.sum())
    rate = (good + 0.5) / (n + 1)
    none = Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))))
    if good == 0 or good == n:
        return Model(none.features, none.weights, none.earlier, none.bias, 1.0)
    total = np.bincount(rows.flat, minlength=1 << HASH_BITS)
    inside = np.bincount(rows.take(np.flatnonzero(y)).flat, minlength=1 << HASH_BITS)
    a, b = (inside + 0.5) / (good + 1), (total - inside + 0.5) / (n - good + 1)
    sure = np.abs(a - b) / np.sqrt(a * (1 - a) / good + b * (1 - b) / (n - good) + 1e-12)
    sure[total < LEAST_DOCS] = 0
    best = np.argsort(-sure, kind="stable")[:MAX_FEATURES]
    best = np.sort(best[sure[best] > 3])
    where = np.full(1 << HASH_BITS, -1, np.int32)
    where[best] = np.arange(len(best))
    rows = rows.only(where[rows.flat] >= 0)
    owner, col, k = rows.owner(), where[rows.flat], len(best)
    weight = np.where(y > 0, n / (2 * good), n / (2 * (n - good)))
    w, v, bias, vb = np.zeros(k), np.zeros(k), none.bias, 0.0
    e, ve = np.zeros(earlier.shape[1]), np.zeros(earlier.shape[1])
    scale = 1 / np.sqrt(np.bincount(col, weights=weight[owner], minlength=k) / n + 1e-3)
    for _ in range(STEPS):
        z = bias + earlier @ e + np.bincount(owner, weights=w[col], minlength=n)
        g = weight * (_sigmoid(z) - y) / n
        v = 0.9 * v - 0.5 * scale * (np.bincount(col, weights=g[owner], minlength=k) + L2 * w)
        vb = 0.9 * vb - 0.5 * g.sum()
        ve = 0.9 * ve - 0.5 * (earlier.T @ g)
        w, bias, e = w + v, bias + vb, e + ve
    return Model(best.astype(np.int64), w, e, float(bias))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Between the two predictions where the F1 score is best; 1 where there is nothing to tell apart."""
    if not y.any() or y.all():
        return 1.0
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1
    i = int(f1.argmax())
    low = p[order][i + 1] if i + 1 < len(p) else 0.0
    return float((p[order][i] + low) / 2)


def fit_chain(rows: Rows, labels: np.ndarray, fold: np.ndarray) -> list[Model]:
    """The chain's models, each trained with out-of-fold probabilities of the earlier ones."""
    n, earlier, chain = len(labels), np.zeros((len(labels), 0)), []
    for c in range(labels.shape[1]):
        y, p = labels[:, c].astype(float), np.zeros(n)
        for f in range(FOLDS):
            inn, out = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if len(inn) and len(out):
                p[out] = fit(rows.take(inn), y[inn], earlier[inn]).predict(rows.take(out), earlier[out])
        model = fit(rows, y, earlier)
        if model.threshold < 1:
            model.threshold = best_threshold(p, y)
        chain.append(model)
        earlier = np.column_stack([earlier, p])
    return chain


def train(docs: DataFrame, labels: DataFrame, chain: tuple[Category, ...] = CHAIN) -> list[Model]:
    """Fits the chain on labelled documents; ``labels`` has doc_id and the columns that the categories name."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.array(*[F.expr(c.label).cast("int") for c in chain]).alias("y")).where("doc_id is not null and not exists(y, x -> x is null)")
    known = known.groupBy("doc_id").agg(*[F.max(F.get("y", F.lit(i))).alias(f"y{i}") for i in range(len(chain))])
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS).select("doc_id", F.array(*[F.col(f"y{i}") for i in range(len(chain))]).alias("labels"))
    rows = id_and_text(docs).join(F.broadcast(sample), "doc_id")  # at most MAX_ROWS rows of two numbers
    got = rows.mapInArrow(_train_rows, "doc_id long, labels array<int>, features array<int>").toArrow()
    ids = got.column("doc_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    y = np.array(got.column("labels").to_pylist(), np.int64).reshape(len(ids), len(chain))[order]
    lists = got.column("features").combine_chunks()
    every = Rows(lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy())
    del got, lists
    common = np.bincount(every.flat, minlength=1 << HASH_BITS) >= LEAST_DOCS
    every = every.only(common[every.flat])
    fold = (T.mix(ids.astype(np.uint64)) % T.U64(FOLDS)).astype(np.int64)[order]
    return fit_chain(every.take(order), y, fold)


def _score(models: list[Model], names: list[str], keep: list[str] | None):
    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.zeros(1 << HASH_BITS, bool)
        for m in models:
            chosen[m.features] = True
        for batch in it:
            raw, offs = T.flat(batch.column("text"))
            n = batch.num_rows
            p = np.zeros((n, len(models)))
            for a, b in T.chunks(offs):
                words = T.Words(raw, offs, a, b, T.ALNUM)
                found = []
                for d, f in features(words):
                    hit = np.flatnonzero(chosen[f])
                    found.append((d[hit] << HASH_BITS) | f[hit])
                pairs = np.unique(np.concatenate(found))
                size = np.bincount(pairs >> HASH_BITS, minlength=b - a)
                rows = Rows(np.concatenate([[0], np.cumsum(size)]), pairs & ((1 << HASH_BITS) - 1))
                for c, m in enumerate(models):
                    p[a:b, c] = m.predict(rows, p[a:b, :c])
            above = np.column_stack([p[:, c] > m.threshold for c, m in enumerate(models)])
            if keep is not None:
                yield batch.filter(pa.array(~above[:, -1]))
                continue
            columns = [batch.column("doc_id"), *[pa.array(p[:, c]) for c in range(len(models))], *[pa.array(above[:, c]) for c in range(len(models))], pa.array(~above[:, -1])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[f"p_{x}" for x in names], *names, "kept"])

    return run


def score(docs: DataFrame, models: list[Model], chain: tuple[Category, ...] = CHAIN) -> DataFrame:
    """One row per document row: each category's probability, whether it is above the threshold, and kept (not in the last category)."""
    names = [c.name for c in chain]
    schema = "doc_id long, " + ", ".join([f"p_{x} double" for x in names] + [f"{x} boolean" for x in names]) + ", kept boolean"
    return id_and_text(docs).mapInArrow(_score(models, names, None), schema)


def without_toxic(docs: DataFrame, models: list[Model]) -> DataFrame:
    """The documents, all columns as they are, without those of the chain's last category."""
    return docs.mapInArrow(_score(models, [], docs.columns), docs.schema)

