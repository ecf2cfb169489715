"""A quality classifier on random-indexing word vectors.

Every word has an index vector: NONZERO of DIMENSIONS entries are 1 or -1, drawn from its hash. A word's vector is the sum
of the index vectors of the words up to WINDOW places beside it, over all documents, scaled to length 1. Words are hashed
to BUCKETS rows, so the vectors are a table of fixed size whatever the corpus holds; words of one row share their vector
(about 20 of them in 10,000 documents, most of them rare), none is left out. A document is the mean and the
deviation of its words' vectors, with its number of words and the share of distinct ones; a network of two layers scores
it, and a temperature fitted on labelled documents that the network didn't see makes the scores probabilities.

Context sums are taken over all documents: each task sums its own, and the sums of FAN_IN tasks are added until one is
left, so no step sees more than FAN_IN tables' parts. The network learns from the SAMPLE labelled documents of the smallest hashes of
their doc_id, one text each, a documented bound. Scoring reads every whole text.

Cases: null and empty texts are scored like any other, from zeros; labels that are null or of no document are left out; of
repeated labels the smallest counts; without labels the score is 0.5; a null doc_id is never learned from and not held out;
an empty table gives an empty result; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import shared

BUCKETS, DIMENSIONS, NONZERO, WINDOW = 1 << 14, 32, 4, 2
SAMPLE, HIDDEN, STEPS, SEED = 8_000, 16, 400, 3
ACCEPT = 0.3
#: Buckets in a row of the shuffled sums, tasks whose sums are added at once, words counted at once, words a worker remembers.
ROWS, FAN_IN, CHUNK, WORDS = 256, 64, 400_000, 100_000

#: Runs of letters, of digits, and of other characters.
_WORD = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        self[word] = at = zlib.crc32(word) % BUCKETS
        return at


_BUCKETS = _Buckets()


def buckets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' buckets of all texts, and where each text's begin."""
    found = [[_BUCKETS[w] for w in _WORD.findall(x)] for x in texts]
    starts = np.r_[0, np.cumsum([len(x) for x in found], dtype=np.int64)]
    return np.fromiter((b for x in found for b in x), np.int32, int(starts[-1])), starts


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(BUCKETS + 1, NONZERO) places and signs; the last row, of no word, has signs 0."""
    draw = np.random.default_rng(SEED)
    places = np.argsort(draw.random((BUCKETS + 1, DIMENSIONS)), axis=1)[:, :NONZERO].astype(np.int32)
    signs = draw.choice([-1.0, 1.0], (BUCKETS + 1, NONZERO))
    signs[-1] = 0
    return places, signs


def context_sums(texts: list[bytes], into: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Adds to into (BUCKETS + 1, DIMENSIONS) the index vectors of each word's neighbours within its text."""
    bucket, starts = buckets_of(texts)
    # WINDOW places of no word between texts
    n = np.diff(starts)
    at = np.arange(len(bucket)) + np.repeat(np.arange(len(n)) * WINDOW, n)
    row = np.full(len(bucket) + WINDOW * len(n), BUCKETS, np.int64)
    row[at] = bucket
    flat, size = into.reshape(-1), into.size
    for start in range(0, len(row), CHUNK):
        part = row[start : start + CHUNK + WINDOW]
        for apart in range(1, WINDOW + 1):
            left, right = part[: min(CHUNK, len(part) - apart)], part[apart : apart + CHUNK]
            for k in range(NONZERO):
                flat += np.bincount(left * DIMENSIONS + places[right, k], signs[right, k], size).astype(np.int64)
                flat += np.bincount(right * DIMENSIONS + places[left, k], signs[left, k], size).astype(np.int64)


SUMS = "part int, task long, sums binary"


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS + 1, DIMENSIONS): the table of fixed size goes to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, (places, signs), seen = np.zeros((BUCKETS + 1, DIMENSIONS), np.int64), index_vectors(), 0
        for batch in shared.slices(batches):
            context_sums(shared.raw(batch.column(0)), total, places, signs)
            seen += batch.num_rows
        if seen:
            parts, task = [total[k : k + ROWS].tobytes() for k in range(0, BUCKETS, ROWS)], TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int64()), pa.array(parts, pa.binary())], [x.split()[0] for x in SUMS.split(", ")])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(ROWS * DIMENSIONS, np.int64)
        for x in table.column("sums").to_pylist():
            total += np.frombuffer(x, np.int64)
        return pa.table({"part": table.column("part")[:1], "task": table.column("task")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

    found = shared.scratch(shared.id_and_text(docs).select("text").mapInArrow(sums, SUMS), "sums")
    last = found.agg(F.max("task")).first()[0] or 0
    while last > 0:
        last //= FAN_IN
        found = shared.scratch(found.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("part", "task").applyInArrow(add, SUMS), "sums")
    out = np.zeros((BUCKETS + 1, DIMENSIONS), np.float32)
    for part, _, x in found.collect():  # BUCKETS / ROWS rows
        out[part * ROWS : (part + 1) * ROWS] = np.frombuffer(x, np.int64).reshape(ROWS, DIMENSIONS)
    return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """(texts, 2 * DIMENSIONS + 2): mean and deviation of the words' vectors, log of the number of words, share of distinct
    buckets. Each text goes by its distinct buckets and how often it has them."""
    bucket, starts = buckets_of(texts)
    n = np.diff(starts)
    out = np.zeros((len(texts), 2 * DIMENSIONS + 2), np.float32)
    if not len(bucket):
        return out
    key, times = np.unique(np.repeat(np.arange(len(n), dtype=np.int64), n) * BUCKETS + bucket, return_counts=True)
    text, row = key // BUCKETS, key % BUCKETS
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    some = text[first]
    x, weight = vectors[row], (times / n[text]).astype(np.float32)[:, None]
    mean = np.add.reduceat(x * weight, first, axis=0)
    square = np.add.reduceat(x * x * weight, first, axis=0)
    out[some, :DIMENSIONS], out[some, DIMENSIONS:-2] = mean, np.sqrt(np.maximum(0, square - mean * mean))
    out[some, -2:] = np.column_stack([np.log1p(n[some]), np.diff(np.r_[first, len(key)]) / n[some]])
    return out


@dataclass
class Scorer:
    """Centre and scale of the features, two layers, and the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray) -> Scorer:
    """Adam on the rows that aren't for calibration; the temperature that makes the others' likelihood largest."""
    draw, train = np.random.default_rng(SEED), ~calibrate if 0 < calibrate.sum() < len(y) else np.ones(len(y), bool)
    a, b = x[train].astype(float), y[train].astype(float)
    net = Scorer(a.mean(axis=0), a.std(axis=0) + 1e-3, [draw.normal(0, 0.2, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 0.2, HIDDEN), np.zeros(1)])
    a = (a - net.centre) / net.scale
    first, second = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers]
    for step in range(1, STEPS + 1):
        w1, b1, w2, b2 = net.layers
        h = np.tanh(a @ w1 + b1)
        e = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - b) / len(b)
        back = e[:, None] * w2 * (1 - h * h)
        for p, g, m, v in zip(net.layers, [a.T @ back + 1e-4 * w1, back.sum(axis=0), h.T @ e + 1e-4 * w2, e.sum(keepdims=True)], first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= 0.02 / (1 - 0.9**step) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    if calibrate.any():
        z, t = net.logits(x[calibrate].astype(float)), np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, np.where(y[calibrate] > 0, -z, z) / k).mean() for k in t]
        net.temperature = float(t[int(np.argmin(loss))])
    return net


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> Scorer | None:
    """None without labels. The labelled documents' features, not their texts, go to the driver."""
    marks = labels.where("quality is not null and doc_id is not null").where(remainder(5) != 0)
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    # labels that point at no document don't count against the bound
    marks = marks.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    marks = marks.orderBy(F.xxhash64(F.lit("quality"), F.col("doc_id")), "doc_id").limit(SAMPLE)
    rows = shared.id_and_text(docs).join(F.broadcast(shared.scratch(marks, "labels")), "doc_id").select("doc_id", "text", "quality")
    # the bound holds where ids repeat: of an id's texts the smallest is taken
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [x.tobytes() for x in pooled(shared.raw(batch.column(1)), sent.value)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["doc_id", "x", "quality"])

    found = shared.map_arrow(rows, "doc_id long, x binary, quality int", features).toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])
    if not found.num_rows:
        return None
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(found.num_rows, -1)
    calibrate = np.array([zlib.crc32(b"calibrate %d" % i) % 5 == 0 for i in found.column("doc_id").to_pylist()])
    return fit(x, found.column("quality").to_numpy(), calibrate)


def score(docs: DataFrame, scorer: Scorer | None, vectors: np.ndarray) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast((scorer, vectors))  # 2 MB of vectors, whatever the corpus

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer, vectors = sent.value
        found = scorer.scores(pooled(shared.raw(batch.column(1)), vectors).astype(float)) if scorer else np.full(batch.num_rows, 0.5)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return shared.map_arrow(shared.id_and_text(docs), "doc_id long, score double", add)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    vectors = word_vectors(docs)
    out = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), vectors), vectors)
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
