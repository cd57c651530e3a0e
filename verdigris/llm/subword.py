"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged per document, softmax output.

Features of a text, all with their multiplicity: each word; each run of two words; each run of 3 or 5 characters, in
which line ends differ from other white space.  Each kind is hashed to ``BUCKETS_EACH`` buckets of its own.  The document
vector is the mean of the feature vectors; output weights and feature vectors are learned by stochastic gradient
descent in numpy, in one task, from a bounded sample of labelled rows: the smallest by a hash of their id, at most
``TRAIN_ROWS`` of them and as long as their texts have ``TRAIN_CHARS`` characters together.  Executors compute their
feature counts; the driver only receives the model.  As output is linear in the mean, a text is scored exactly by
averaging each feature's projection on the output weights, so executors only need one number per bucket and class.

Defined results: null texts count as empty; a text without features gets the class prior; texts are read whole, also
for training (a single text that is longer than ``TRAIN_CHARS`` is not learned from); repeated rows are scored as
often as they occur, and all rows of a chosen id are learned from; an id with several labels has the smallest; if
fewer than two classes are labelled every score is the prior; an empty table gives an empty result; only named columns
are read, and kept columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import BASE, chunks, give_back, mix, _powers, small, Words
from .tables import free, in_arrow, named, table

BUCKETS_EACH = 1 << 17
BUCKETS = 3 * BUCKETS_EACH
GRAMS = (3, 5)
DIM = 8
EPOCHS = 8
RATE = 1.0
TRAIN_ROWS = 4000
TRAIN_CHARS = 8_000_000
FOLDS = 5
_U = np.uint64


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text index) of every feature of a chunk of texts."""
    space = ((w.cp == 32) | ((w.cp - np.uint32(9)) <= 4)) & (w.cp != 10)
    marked = np.where(space, np.uint32(0), w.cp)
    sums = np.zeros(len(marked) + 1, _U)
    np.cumsum((marked.astype(_U) + _U(1)) * _powers("p", BASE, len(marked)), out=sums[1:])
    inverse = _powers("q", pow(BASE, -1, 2**64), len(marked) + 1)
    of = np.repeat(np.arange(w.n_docs, dtype=np.int32), np.diff(w.doc_start))
    of[w.doc_start[1:] - 1] = -1  # what parts two texts belongs to neither
    buckets = [(mix(w.hash) >> _U(47)).astype(np.int32)]
    docs = [w.doc.astype(np.int32)]
    pair, first = w.grams(2)
    buckets.append((pair >> _U(47)).astype(np.int32) + BUCKETS_EACH)
    docs.append(docs[0][first])
    for n in GRAMS:
        m = len(marked) - n + 1
        if m <= 0:
            continue
        at = np.flatnonzero((of[:m] == of[n - 1 :]) & (of[:m] >= 0))
        h = mix((sums[at + n] - sums[at]) * inverse[at] + _U(n))
        buckets.append((h >> _U(47)).astype(np.int32) + 2 * BUCKETS_EACH)
        docs.append(of[at])
    return np.concatenate(buckets), np.concatenate(docs)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_ids(labels: DataFrame, target: Column, rows: int = TRAIN_ROWS) -> DataFrame:
    """(_id, _y) of at most ``rows`` labelled rows outside the held-out fold; one row for each id."""
    src = labels.select(F.col("doc_id").alias("_id"), target.cast("int").alias("_y")).where("_id is not null and _y is not null")
    src = src.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_y").alias("_y"))
    return src.orderBy(F.xxhash64("_id"), "_id").limit(rows)


def training_rows(docs: DataFrame, labels: DataFrame, target: Column, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    """(_id, _y, text) of the sample.  The driver receives an id and a length for each of at most ``rows`` ids."""
    spark = docs.sparkSession
    ids = training_ids(labels, target, rows)  # bounded by ``rows``
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("_id", "_y", "text")
    sizes = found.groupBy("_id", "_y").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n")).orderBy(F.xxhash64("_id"), "_id").collect()
    chosen, left = [], chars
    for r in sizes:
        if r["n"] <= left:
            chosen.append((r["_id"], r["_y"]))
            left -= r["n"]
    schema = T.StructType([T.StructField("_id", docs.schema["doc_id"].dataType), T.StructField("_y", T.IntegerType())])
    few = spark.createDataFrame(chosen, schema)
    return docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("_id")).select("_id", "_y", "text")


COUNTS = "id long, y int, at binary, n binary"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct buckets (32 bits each) and their counts (16 bits each, or 32 where one needs them)."""
    for batch in small(batches):
        texts = [t or "" for t in batch.column(2).to_pylist()]
        at, n = [], []
        for lo, hi in chunks(texts):
            bucket, doc = features(Words(texts[lo:hi]))
            key, count = np.unique(doc.astype(np.int64) * BUCKETS + bucket, return_counts=True)
            edge = np.searchsorted(key, np.arange(hi - lo + 1, dtype=np.int64) * BUCKETS)
            for a, b in zip(edge, edge[1:], strict=False):
                at.append((key[a:b] % BUCKETS).astype(np.int32).tobytes())
                wide = a < b and count[a:b].max() >= 1 << 16
                n.append(count[a:b].astype(np.uint32 if wide else np.uint16).tobytes())
        if texts:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["id", "y", "at", "n"])


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """Projection of each bucket on each class, and the bias in the last row: (BUCKETS + 1, classes).

    The step along a document's vector is the same for short and long ones: feature steps are divided by the sum of
    squared shares.  A rate that makes the numbers overflow is halved and learning begins anew.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        while not np.isfinite(out := _descend(rows, classes, dim, epochs, rate)).all():
            rate /= 2
    return out


def _descend(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, dim: int, epochs: int, rate: float) -> np.ndarray:
    rng = np.random.default_rng(7)
    prior = np.bincount([y for y, _, _ in rows], minlength=classes) + 0.5
    out = np.zeros((BUCKETS + 1, classes))
    out[-1] = np.log(prior / prior.sum())
    rows = [r for r in rows if len(r[1])]
    if np.count_nonzero(prior > 1) < 2 or not rows:
        return out
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    weights = rng.normal(0, 1, (classes, dim)).astype(np.float32)
    bias = out[-1].astype(np.float32)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            y, at, n = rows[i]
            share = n.astype(np.float32) / n.sum(dtype=np.int64)
            x = share @ vectors[at]
            z = weights @ x + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y] -= 1
            eta = rate * (1 - done / steps)
            back = weights.T @ g
            weights -= eta * np.outer(g, x)
            bias -= 0.1 * eta * g
            vectors[at] -= np.outer(share * (eta / np.square(share).sum()), back)
            done += 1
    out[:-1] = vectors @ weights.T
    out[-1] = bias
    return out


def _trained(classes: int):
    """Learns from all rows of one partition; yields the model as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(i, y, a, n) for b in batches for i, y, a, n in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got.sort()  # whatever the order of arrival
        got = [(y, np.frombuffer(a, np.int32), np.frombuffer(n, np.uint16 if len(n) * 2 == len(a) else np.uint32)) for _, y, a, n in got]
        model = train(got, classes)
        del got
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model.astype(np.float32).tobytes()], pa.binary())], ["model"])

    return run


def fit(docs: DataFrame, labels: DataFrame, target: Column, classes: int, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> np.ndarray:
    """The model, ``(BUCKETS + 1) * classes`` numbers of 32 bits whatever the input."""
    sample = training_rows(docs, labels, target, rows, chars).mapInArrow(_counts, COUNTS)
    got = sample.repartition(1).mapInArrow(_trained(classes), "model binary").toArrow()  # bounded by ``rows`` and ``chars``
    if not got.num_rows:
        return train([], classes).astype(np.float32)
    return np.frombuffer(got.column(0)[0].as_py(), np.float32).reshape(-1, classes)


def posteriors(docs: DataFrame, model: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns ``keep``, then ``p`` (array of doubles, one per class) and the number of words.  The model is
    ``BUCKETS + 1`` rows of one number per class whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(model[:-1].T), model[-1].astype(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, bias = shared.value
        for batch in small(batches):
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            parts, counts = [np.zeros((0, len(bias)))], [np.zeros(0, np.int64)]
            for lo, hi in chunks(texts):
                w = Words(texts[lo:hi])
                bucket, doc = features(w)
                total = np.maximum(np.bincount(doc, minlength=w.n_docs), 1)
                z = np.stack([np.bincount(doc, c[bucket], w.n_docs) / total for c in columns], 1) + bias
                p = np.exp(z - z.max(1, keepdims=True))
                parts.append(p / p.sum(1, keepdims=True))
                counts.append(w.count)
            p = np.concatenate(parts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(bias)), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), lists, pa.array(np.concatenate(counts).astype(np.int64))], names=[*keep, "p", "n_words"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("n_words", T.LongType())])
    text = free(keep, "text")
    return in_arrow(docs.select(*map(named, keep), F.col("text").alias(text)), run, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; learned only from rows that are not held out."""
    model = fit(docs, labels, F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0), 2)
    out = posteriors(docs, model, ["doc_id"])
    score = F.col("p")[1]
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
