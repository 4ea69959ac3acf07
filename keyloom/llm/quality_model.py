"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer numpy network.

Words and punctuation runs are hashed to VOCABULARY rows. Each row has a fixed sparse ternary index vector;
its word vector is the sum of its neighbours' index vectors over all documents (random indexing; no labels
are needed for it). A document is the mean and spread of its word vectors and a few ratios; two layers score
it, and a temperature fitted on texts kept out of the training calibrates the probability.

SAMPLE bounds the labelled rows that the network and its temperature are learnt from (those with the smallest
hash, over all of them); everything else covers all rows. Labels are learnt only where crc32(doc_id) mod 5 is not
0; of the rest, remainder 1 calibrates. doc_id, lang, source and labels are never inputs of a score.

Defined results: null and empty texts have a score like any other text (of no words). Without labels of
both kinds the score is the share of label 1 (0.5 without any). Rows of labels that repeat doc_id and label count
once; of documents that share a labelled doc_id the smallest text is learnt from. A null doc_id is not held out and
has no label. An empty table gives an empty one; texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm import words as W
from keyloom.llm.arrowmap import buffers, slices, with_arrow_columns
from keyloom.llm.license_scan import IN_WORD

SAMPLE = 20_000
VOCABULARY, WIDTH, NONZERO, WINDOW = 1 << 14, 48, 6, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 256, 3e-3, 1e-4
THRESHOLD = 0.3
#: Partitions of the sample.
SAMPLE_PARTS = 8
#: Values of a 64-bit hash.
HASHES = 2.0**64


def index_vectors() -> np.ndarray:
    """VOCABULARY sparse ternary rows, the same everywhere."""
    rng = np.random.default_rng(20)
    out = np.zeros((VOCABULARY, WIDTH), np.float32)
    at = np.argsort(rng.random((VOCABULARY, WIDTH)), axis=1)[:, :NONZERO]
    out[np.arange(VOCABULARY)[:, None], at] = rng.choice(np.array([-1, 1], np.float32), (VOCABULARY, NONZERO))
    return out


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary rows of the words and punctuation runs of texts, and the texts' bounds among them."""
    data, offsets = buffers(texts)
    data = W.LOWER[data]
    word = IN_WORD[data]
    marks = ~word & ~W.SPACE[data]
    a, b = W.spans(word, offsets), W.spans(marks, offsets)
    starts, ends = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(starts)
    starts, ends = starts[order], ends[order]
    return (W.span_hashes(data, starts, ends) & W.U(VOCABULARY - 1)).astype(np.int64), W.per_text(starts, offsets)


def contexts(texts: DataFrame) -> np.ndarray:
    """Word vectors: for each vocabulary row the sum of the index vectors around its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors().astype(np.int8), np.zeros((VOCABULARY, WIDTH), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, bounds = tokens(part.column(0))
                owner, own = W.owners(bounds), index[ids]
                # What stands around each word, then added up by word. Few small numbers: a byte holds them.
                around = np.zeros_like(own)
                for k in range(1, WINDOW + 1):
                    near = (owner[k:] == owner[:-k])[:, None]
                    around[:-k] += own[k:] * near
                    around[k:] += own[:-k] * near
                order = np.argsort(ids, kind="stable")
                rows, at = np.unique(ids[order], return_index=True)
                if len(rows):
                    total[rows] += np.add.reduceat(around[order], at, axis=0, dtype=np.int64)
        touched = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(touched, pa.int32()), pa.array([r.tobytes() for r in total[touched].astype(np.int32)], pa.binary())], names=["row", "sum"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((VOCABULARY, WIDTH), np.int64)
        for batch in batches:
            np.add.at(total, batch.column(0).to_numpy(), np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32).reshape(-1, WIDTH))
        touched = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(touched, pa.int32()), pa.array([r.tobytes() for r in total[touched]], pa.binary())], names=["row", "sum"])

    # Tables of any number of tasks are added up row by row; the driver gets each of VOCABULARY rows once.
    schema = "row int, sum binary"
    total = np.zeros((VOCABULARY, WIDTH), np.int64)
    for row, values in texts.select("text").mapInArrow(run, schema).repartition("row").mapInArrow(summed, schema).collect():
        total[row] = np.frombuffer(values, np.int64)
    return word_vectors(total.astype(np.float64))


def word_vectors(total: np.ndarray) -> np.ndarray:
    """Unit context vectors beside unit index vectors; a word without context has the latter alone."""
    norm = lambda x: (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    centred = total - total.mean(0) * (np.abs(total).sum(1, keepdims=True) > 0)
    return np.concatenate([norm(centred), norm(index_vectors())], axis=1)


def features(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Pooled vectors of the texts: mean, spread, and ratios of tokens; zeros without tokens."""
    ids, bounds = tokens(texts)
    n, width = len(texts), vectors.shape[1]
    out = np.zeros((n, 2 * width + 5), np.float32)
    sizes = np.diff(bounds)
    filled = np.flatnonzero(sizes)
    if len(filled):
        owner = W.owners(bounds)
        # Each distinct word of a text once, weighted by its count.
        pair, times = np.unique(owner * VOCABULARY + ids, return_counts=True)
        who, word = pair // VOCABULARY, pair % VOCABULARY
        at = np.searchsorted(who, filled)
        count = sizes[filled, None].astype(np.float32)
        for a in range(0, len(filled), 64):
            b = min(a + 64, len(filled))
            span = slice(at[a], at[b] if b < len(at) else len(who))
            rows = vectors[word[span]]
            weight = times[span, None].astype(np.float32)
            cut = at[a:b] - at[a]
            mean = np.add.reduceat(rows * weight, cut, axis=0) / count[a:b]
            square = np.add.reduceat(rows * rows * weight, cut, axis=0) / count[a:b]
            out[filled[a:b], :width] = mean
            out[filled[a:b], width : 2 * width] = np.sqrt(np.maximum(square - mean * mean, 0))
            out[filled[a:b], -1] = np.linalg.norm(mean[:, width // 2 :], axis=1)
        distinct = np.bincount(who, minlength=n)[filled]
        most = np.maximum.reduceat(times, at)
        same = np.zeros(len(ids), bool)
        same[1:] = (ids[1:] == ids[:-1]) & (owner[1:] == owner[:-1])
        out[filled, -5] = np.log1p(sizes[filled]) / 10
        out[filled, -4] = distinct / sizes[filled]
        out[filled, -3] = most / sizes[filled]
        out[filled, -2] = np.bincount(owner, same, n)[filled] / sizes[filled]
    return out


@dataclass
class Network:
    """tanh layer, linear layer, sigmoid at a temperature; inputs standardised."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x.astype(np.float64)) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def trained(x: np.ndarray, y: np.ndarray, hold: np.ndarray) -> Network:
    """A network fitted with Adam on the rows not in hold, calibrated on those in hold."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    fit = ~hold if (~hold).any() and 0 < y[~hold].mean() < 1 else np.ones(len(y), bool)
    mean, scale = (x[fit].mean(0), x[fit].std(0) + 1e-3) if len(y) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    share = y.mean() if len(y) else 0.5
    rng = np.random.default_rng(7)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    if not len(y) or not 0 < share < 1:
        odds = np.log(max(share, 1e-3) / max(1 - share, 1e-3)) if share != 0.5 else 0.0
        return Network(mean, scale, p[0] * 0, p[1], p[2] * 0, float(odds))
    xs, ys = (x[fit] - mean) / scale, y[fit]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(ys))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for a in range(0, len(ys), BATCH):
            xb, yb = xs[order[a : a + BATCH]], ys[order[a : a + BATCH]]
            h = np.tanh(xb @ p[0] + p[1])
            d = (_sigmoid(h @ p[2] + p[3]) - yb) / len(yb)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [xb.T @ dh + DECAY * p[0], dh.sum(0), h.T @ d + DECAY * p[2], d.sum(keepdims=True)]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    if hold.any():
        z, t = net.logits(x[hold]), y[hold]
        loss = lambda k: np.mean(np.logaddexp(0, z / k) - t * z / k)
        net.temperature = float(min(np.geomspace(0.25, 8, 141), key=loss))
    return net


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors and network from labels (doc_id, label) of docs (doc_id, text)."""
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.where("doc_id IS NOT NULL").distinct().withColumn("place", F.xxhash64("doc_id", "label"))
    # A threshold on the hash leaves little more than SAMPLE rows for the one task that takes the first of them.
    share = min(1.0, 1.05 * SAMPLE / max(known.count(), 1))
    chosen = known.where(F.col("place") <= F.lit(int(HASHES * (share - 0.5)) if share < 1 else (1 << 63) - 1)).orderBy("place", "doc_id", "label").limit(SAMPLE)
    # SAMPLE rows of ids at most, so a broadcast of it is bounded, and so is what is left of the texts.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "place").agg(F.min("text").alias("text"))
    rows = rows.select("text", "label", (fold(F.col("doc_id")) == 1).alias("hold"), "place").repartition(SAMPLE_PARTS, "place")
    vectors = contexts(docs)
    shared = spark.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column(0), shared.value)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), part.column(1), part.column(2), part.column(3)], names=["x", "label", "hold", "place"])

    got = rows.mapInArrow(run, "x binary, label int, hold boolean, place long").toPandas().sort_values(["place", "label", "x"])
    width = 2 * vectors.shape[1] + 5
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), width)
    return vectors, trained(x, (got["label"].to_numpy() == 1), got["hold"].to_numpy(bool))


ADDED = T.StructType([T.StructField("score", T.DoubleType())])


def scored(docs: DataFrame, vectors: np.ndarray, net: Network, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with score; an input column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def kernel(texts: pa.Array) -> list:
        vectors, net = shared.value
        return [pa.array(net.score(features(texts, vectors)))]

    return with_arrow_columns(docs, text, ADDED, kernel, keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    vectors, net = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, vectors, net, keep=["doc_id"])
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
