"""Toxicity by a counterfactually regularised classifier.

Logistic regression over the presence of hashed features (words, six-byte runs within words, seven-byte word beginnings),
of which the most telling are kept. For labelled texts that name a group, the group term is swapped for another, and the
loss has a penalty on the square of the change in log-odds, so that merely naming a group moves no score.

The classifier is fitted on at most `Toxicity.sample` labelled rows; every document is scored by its whole text.

Edge cases: a null text is empty; an empty text gets the base rate; several labels of a document count as toxic if any is;
labels null or without document are ignored; with no labels, or of one class only, every score is that class's smoothed rate;
repeated rows are scored each; a null doc_id is never held out (nor learnt from); a very long text is scored whole, in slices
of whole texts; an empty table gives an empty result; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .hashing import Slice, slices

BITS = 20
GROUPS = (
    ("women", "men", "girls", "boys", "trans"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous", "arab"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "natives", "foreigners", "refugees"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
)


@dataclass(frozen=True)
class Toxicity:
    """sample bounds the labelled rows that the classifier is fitted on, features its weights: with 32,768 of them fewer
    held-out rows came out right than with 4,096, as rare features fit the sample by chance."""

    sample: int = 20_000
    features: int = 4096
    counterfactual: float = 1.0
    decay: float = 1e-4
    steps: int = 300
    groups: tuple[tuple[str, ...], ...] = GROUPS


def hashed(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every occurrence in a slice; features are below 2**BITS."""
    data = s.lower()
    p, (start, stop, doc) = s.prefix(data), s.words()
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    down = np.uint64(64 - BITS)
    long = np.flatnonzero(stop - start >= 7)
    # six-byte runs within words: those whose place is at least six bytes before its word's end
    room = np.zeros(len(data) + 1, np.int32)
    room[start] += 1
    room[np.maximum(start, stop - 5)] -= 1
    at = np.flatnonzero(np.cumsum(room[:-1]))
    grams = s.run_hash(p, at, at + 6)
    docs = np.searchsorted(s.offsets, at, "right") - 1
    salt = np.uint64(0xA5A5A5A5A5A5A5A5)
    features = np.concatenate([s.run_hash(p, start, stop) >> down, (s.run_hash(p, start[long], start[long] + 7) ^ salt) >> down, (grams * np.uint64(3)) >> down])
    return np.concatenate([doc, doc[long], docs]), features.astype(np.int64)


def _per_text(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct features) of every text."""
    for s in slices(texts):
        doc, f = hashed(s)
        key = np.unique(doc << BITS | f)
        bounds = np.searchsorted(key, np.arange(len(s.offsets), dtype=np.int64) << BITS)
        for i in range(len(s.offsets) - 1):
            yield s.first + i, key[bounds[i] : bounds[i + 1]] & ((1 << BITS) - 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, toxic of at most `most` rows, in an order that depends on doc_id alone; held-out rows aren't among them."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    own = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")  # at most `most` rows of two numbers


def swapped(text: str, groups: tuple[tuple[str, ...], ...]) -> str | None:
    """The text with every group term replaced by the next of its group; None if it names none."""
    after = {w: g[(i + 1) % len(g)] for g in groups for i, w in enumerate(g)}
    words, found = re.split("([ \t\n\x0b\x0c\r]+)", text), False  # the white space that parts features
    for i, w in enumerate(words):
        bare = w.strip(".,;:!?\"'()[]").lower()
        if bare in after:
            words[i] = w.lower().replace(bare, after[bare])
            found = True
    return "".join(words) if found else None


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray | None]], size: int, params: Toxicity) -> np.ndarray:
    """Weights of the features 0 .. size - 1 and the bias, from (label, features, features of the swapped text or None)."""
    y = np.array([r[0] for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int64)
    pairs = [r for r in rows if r[2] is not None]
    cf_row = np.concatenate([np.full(len(r[1]) + len(r[2]), i) for i, r in enumerate(pairs)]) if pairs else np.zeros(0, np.int64)
    cf_col = np.concatenate([np.concatenate([r[1], r[2]]) for r in pairs]) if pairs else np.zeros(0, np.int64)
    cf_sign = np.concatenate([np.concatenate([np.ones(len(r[1])), -np.ones(len(r[2]))]) for r in pairs]) if pairs else np.zeros(0)
    rate = (y.sum() + 1) / (len(y) + 2)
    w, bias = np.zeros(size), np.log(rate / (1 - rate))
    if len(y) == 0 or y.min() == y.max():
        return np.append(w, bias)
    m, v, rate = np.zeros(size + 1), np.zeros(size + 1), 0.05
    for t in range(1, params.steps + 1):
        z = bias + np.bincount(row, w[col], len(y))
        error = (_sigmoid(z) - y) / len(y)
        g = np.bincount(col, error[row], size) + params.decay * w
        if pairs:
            change = np.bincount(cf_row, cf_sign * w[cf_col], len(pairs))
            g += 2 * params.counterfactual / len(pairs) * np.bincount(cf_col, cf_sign * change[cf_row], size)
        g = np.append(g, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return np.append(w, bias)


@dataclass
class Model:
    """slot: for each hashed feature the number of its weight, or -1; weights end with the bias."""

    slot: np.ndarray
    weights: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.empty(len(texts))
        size = len(self.weights)
        for s in slices(texts):
            doc, f = hashed(s)
            own = self.slot[f]
            hit = own >= 0
            key = np.unique(doc[hit] * size + own[hit])
            n = len(s.offsets) - 1
            out[s.first : s.first + n] = _sigmoid(self.weights[-1] + np.bincount(key // size, self.weights[key % size], n))
        return out


def train(docs: DataFrame, labels: DataFrame, params: Toxicity = Toxicity()) -> Model:
    sample, _ = materialize(labelled_sample(docs, labels, params.sample).repartition(8, "doc_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int64)
        total = np.zeros(2, np.int64)
        for batch in batches:
            y = [int(bool(t)) for t in batch.column(2).to_pylist()]
            for i, f in _per_text(batch.column(1)):
                n[y[i], f] += 1
                total[y[i]] += 1
        f = np.flatnonzero(n.sum(0) > 0)
        for k in range(0, len(f), 50_000):
            own = f[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[1, own]), pa.array(n[0, own])], names=["f", "toxic", "clean"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([total[1]]), pa.array([total[0]])], names=["f", "toxic", "clean"])

    counts, _ = materialize(sample.select("doc_id", "text", "toxic").mapInArrow(count, "f long, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    totals = counts.filter("f = -1").first()
    n1, n0 = (totals.toxic, totals.clean) if totals else (0, 0)
    # chi-square of each feature's two-by-two table
    a, b = F.col("toxic"), F.col("clean")
    c, d = F.lit(n1) - a, F.lit(n0) - b
    n = float(n1 + n0)
    det = (a * d - b * c).cast("double")
    chi = n * det * det / ((a + b).cast("double") * (c + d) * float(max(n1, 1)) * float(max(n0, 1)))
    chosen = counts.filter("f >= 0 and toxic + clean >= 3").withColumn("chi", F.when((c + d) > 0, chi).otherwise(0.0)).orderBy(F.desc("chi"), "f").limit(params.features)
    features = [r.f for r in chosen.select("f").collect()]
    slot = np.full(1 << BITS, -1, np.int32)
    slot[features] = np.arange(len(features))
    shared = docs.sparkSession.sparkContext.broadcast(slot)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())

        def kept(texts: pa.Array) -> list[np.ndarray]:
            out = [shared.value[f] for _, f in _per_text(texts)]
            return [x[x >= 0] for x in out]

        for batch in batches:
            y = batch.column(2).to_pylist()
            other = [swapped(t or "", params.groups) for t in batch.column(1).to_pylist()]
            own = kept(batch.column(1))
            changed = iter(kept(pa.array([t for t in other if t is not None], pa.string())))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0)), pa.array([int(bool(t)) for t in y], pa.int32()), pa.array([x.tolist() for x in own], kind), pa.array([None if t is None else next(changed).tolist() for t in other], kind)], names=["doc_id", "y", "own", "swapped"])

    rows = sample.select("doc_id", "text", "toxic").mapInArrow(vectors, f"doc_id {sample.schema['doc_id'].dataType.simpleString()}, y int, own array<int>, swapped array<int>").orderBy("doc_id").drop("doc_id").collect()
    weights = fit([(r.y, np.array(r.own, np.int64), None if r.swapped is None else np.array(r.swapped, np.int64)) for r in rows], len(features), params)
    return Model(slot, weights)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_counterfactual_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
