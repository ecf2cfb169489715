"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models over hashed words and beginnings of words; each model also gets the probabilities
of the categories before it. In training those are out-of-fold: the model of a category that scores a document was fitted
without the document's fold, so later models don't learn from scores that are better than they will be.

Labels: the last category is the table's own label, toxic. The ones before it are kinds of abuse found in the data: the
labelled toxic documents are clustered (spherical k-means, KINDS clusters) over the columns that mark toxic documents most.
No word list is used; in a corpus of several languages the kinds are mostly the languages' abuse.

Training uses the SAMPLE labelled documents of the smallest hashes of their doc_id, one text each, a documented bound.
Scoring reads every whole text.

Cases: null and empty texts have no words, and are scored by the intercepts; labels that are null, or that point at no
document, are left out; of repeated labels the largest counts; with labels of one value only, that value's share is the
probability; with no label the probability is 0; rows with repeated or without ids are scored each by its own text; an empty
table gives an empty result; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from folioflow.llm import shared

#: Clusters of toxic documents, the columns they are made over, and rounds of k-means.
KINDS, MARKS, ROUNDS = 3, 512, 12
FINAL = "toxic"
SAMPLE, FOLDS, WIDTH = 8_000, 4, 1 << 18
REJECT = 0.5
#: Of each model: passes over the sample, step, weight of the L1 term, and documents a word must be in.
#: APART: by how many standard deviations its documents' share of a class differs from all documents'.
PASSES, RATE, L1, SEEN, APART = 150, 0.3, 5e-4, 5, 5.0
#: Words a worker remembers.
WORDS = 50_000
#: Beginnings of words, in bytes, and how many words that share one make a column of their own.
PREFIXES, OFTEN = (5, 6, 7), 3

_WORD = re.compile(rb"[a-z\x80-\xff]+")


@dataclass(frozen=True)
class Chain:
    """One linear model for each category: weights of the columns used, of the earlier categories' probabilities, intercept."""

    names: tuple[str, ...]
    used: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: np.ndarray

    def probabilities(self, columns: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(documents, categories) of documents whose distinct words are columns[starts[i]:starts[i + 1]]."""
        columns, starts = _only(columns, starts, self.used)
        base = sums(self.weights[:, columns], starts) + self.intercept
        out = np.empty_like(base)
        for k in range(len(self.names)):
            out[:, k] = sigmoid(base[:, k] + out[:, :k] @ self.earlier[k, :k])
        return out


def names_of(kinds: int = KINDS) -> tuple[str, ...]:
    return (*(f"kind_{k + 1}" for k in range(kinds)), FINAL)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values (k, words) over each document's words, as (documents, k)."""
    total = np.concatenate([np.zeros((values.shape[0], 1)), np.cumsum(values, axis=1, dtype=np.float64)], axis=1)
    return (total[:, starts[1:]] - total[:, starts[:-1]]).T


class _Columns(dict):
    """The columns of each word and its beginnings, remembered."""

    def __missing__(self, word: bytes) -> np.ndarray:
        if len(self) > WORDS:
            self.clear()
        parts = [word, *(word[:k] + b"*" for k in PREFIXES if len(word) >= k)]
        self[word] = at = np.array([zlib.crc32(x) % WIDTH for x in parts], np.int32)
        return at


_COLUMNS = _Columns()


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The columns of each text, and where each text's begin.

    A text has the columns of its distinct words (runs of letters, A-Z lowered) and of their beginnings, and those of
    beginnings that OFTEN or more of its distinct words share once more, WIDTH further on: abuse is inflected.
    """
    found = []
    for text in texts:
        words = set(_WORD.findall(text.lower()))
        own, n = np.unique(np.concatenate([_COLUMNS[w] for w in words]), return_counts=True) if words else (np.zeros(0, np.int32), np.zeros(0, int))
        found.append(np.concatenate([own, own[n >= OFTEN] + np.int32(WIDTH)]))
    return np.concatenate([*found, np.zeros(0, np.int32)]), np.r_[0, np.cumsum([len(x) for x in found], dtype=np.int64)]


def _only(columns: np.ndarray, starts: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns in kept, numbered by their place in it."""
    number = np.full(2 * WIDTH, -1, np.int32)
    number[kept] = np.arange(len(kept))
    mine = number[columns] >= 0
    return number[columns[mine]], np.r_[0, np.cumsum(mine, dtype=np.int64)][starts]


def _rows(columns: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns of some documents."""
    lengths = np.diff(starts)[rows]
    at = np.repeat(starts[rows] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
    return columns[at], np.r_[0, np.cumsum(lengths)]


def marking(columns: np.ndarray, starts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of SEEN documents or more that aren't as frequent in both classes as chance would have it, and by how many
    standard deviations the class of 1 has more of them."""
    share = y.mean()
    n, n1 = np.bincount(columns, minlength=2 * WIDTH), np.bincount(columns[np.repeat(y > 0, np.diff(starts))], minlength=2 * WIDTH)
    apart = (n1 - n * share) / np.sqrt(np.maximum(1e-9, n * share * (1 - share)))
    kept = np.flatnonzero((n >= SEEN) & (np.abs(apart) > APART))
    return kept, apart[kept]


def fit_linear(columns: np.ndarray, starts: np.ndarray, extra: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression by full-batch Adagrad with soft thresholds: weights of columns, weights of extra, intercept.

    Only marking columns are used; both classes weigh the same.
    """
    w, v, share = np.zeros(2 * WIDTH, np.float32), np.zeros(extra.shape[1]), y.mean()
    b = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if y.min() == y.max():
        return w, v, b
    kept, _ = marking(columns, starts, y)
    columns, starts = _only(columns, starts, kept)
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    x, gw, gv, gb = np.zeros(len(kept)), np.full(len(kept), 1e-8), np.full(len(v), 1e-8), 1e-8
    balance = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    for _ in range(PASSES):
        e = (sigmoid(sums(x[None, columns], starts)[:, 0] + extra @ v + b) - y) * balance / len(y)
        dx, dv, db = np.bincount(columns, e[row], len(kept)), extra.T @ e + L1 * np.sign(v), e.sum()
        gw, gv, gb = gw + dx * dx, gv + dv * dv, gb + db * db
        x, v, b = x - RATE * dx / np.sqrt(gw), v - RATE * dv / np.sqrt(gv), b - RATE * db / np.sqrt(gb)
        x = np.sign(x) * np.maximum(0, np.abs(x) - RATE * L1 / np.sqrt(gw))
    w[kept] = x
    return w, v, b


def scores_of(columns: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of weights over each document's columns."""
    used = np.flatnonzero(weights)
    columns, starts = _only(columns, starts, used)
    return sums(weights[used][None, columns], starts)[:, 0]


def kinds_of(columns: np.ndarray, starts: np.ndarray, toxic: np.ndarray, kinds: int = KINDS) -> np.ndarray:
    """(kinds, documents): which toxic documents are of which kind, the largest kind first; those without a mark are of none.

    k-means by cosine from centres that are far apart: the document of the most marks, then the least alike to those before.
    """
    out = np.zeros((kinds, len(toxic)))
    if not kinds or not 0 < toxic.sum() < len(toxic):
        return out
    kept, apart = marking(columns, starts, toxic)
    kept = np.sort(kept[np.argsort(-apart, kind="stable")[:MARKS]])
    bad = np.flatnonzero(toxic)
    marks, at = _only(*_rows(columns, starts, bad), kept)
    x = np.zeros((len(bad), len(kept)), np.float32)
    x[np.repeat(np.arange(len(bad)), np.diff(at)), marks] = 1
    norm = np.sqrt(x.sum(axis=1))
    bad, x, norm = bad[norm > 0], x[norm > 0], norm[norm > 0]
    if not len(bad):
        return out
    x /= norm[:, None]
    centres = [x[int(norm.argmax())]]
    while len(centres) < kinds:
        centres.append(x[int((x @ np.array(centres).T).max(axis=1).argmin())])
    for _ in range(ROUNDS):
        of = (x @ np.array(centres).T).argmax(axis=1)
        means = [x[of == k].sum(axis=0) if (of == k).any() else centres[k] for k in range(kinds)]
        centres = [c / max(1e-9, float(np.linalg.norm(c))) for c in means]
    for place, k in enumerate(np.argsort(-np.bincount(of, minlength=kinds), kind="stable")):
        out[place, bad[of == k]] = 1
    return out


def fit_chain(texts: list[bytes], fold: np.ndarray, toxic: np.ndarray, kinds: int = KINDS) -> Chain:
    columns, starts = words_of(texts)
    labels = np.array([*kinds_of(columns, starts, toxic > 0, kinds), toxic > 0], float)
    n = len(labels)
    weights, earlier, intercept, before = np.zeros((n, 2 * WIDTH), np.float32), np.zeros((n, n)), np.zeros(n), np.zeros((len(texts), 0))
    for k, y in enumerate(labels):
        weights[k], earlier[k, :k], intercept[k] = fit_linear(columns, starts, before, y)
        if k == n - 1:
            break
        held = np.empty(len(texts))
        for f in range(FOLDS):
            out, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            if len(rest) and len(out):
                w, v, b = fit_linear(*_rows(columns, starts, rest), before[rest], y[rest])
                held[out] = sigmoid(scores_of(*_rows(columns, starts, out), w) + before[out] @ v + b)
            else:
                held[out] = y.mean()
        before = np.column_stack([before, held])
    used = np.flatnonzero(weights.any(axis=0))
    return Chain(names_of(kinds), used, weights[:, used], earlier, intercept)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, kinds: int = KINDS) -> Chain | None:
    """A chain of the labelled documents; None without any. Only their distinct words go to the driver."""
    rank = F.xxhash64(F.lit("toxic"), F.col("doc_id"))
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # labels that point at no document don't count against the bound
    marks = marks.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi").orderBy(rank, "doc_id").limit(sample)
    rows = shared.id_and_text(docs).join(F.broadcast(shared.scratch(marks, "labels")), "doc_id")
    # the bound holds where ids repeat: of an id's texts the smallest is taken
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))

    def brief(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [b" ".join(sorted(set(_WORD.findall(x.lower())))) for x in shared.raw(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), batch.column(2)], ["doc_id", "words", "toxic"])

    found = shared.map_arrow(rows, "doc_id long, words binary, toxic int", brief).toArrow().sort_by([("doc_id", "ascending")])
    if not found.num_rows:
        return None
    fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in found.column("doc_id").to_pylist()])
    return fit_chain(found.column("words").to_pylist(), fold, found.column("toxic").to_numpy(), kinds)


def scored(docs: DataFrame, chain: Chain | None, name: str, kinds: int = KINDS) -> DataFrame:
    """docs with a column of a name: an array of the categories' probabilities in the chain's order."""
    # numbered inside, as names with dots are not taken by mapInArrow
    names = [f"c{k}" for k in range(len(docs.columns) + 1)]
    at, rows, n = docs.columns.index("text"), docs.toDF(*names[:-1]), len(chain.names) if chain else kinds + 1
    # a bounded model: 2 * WIDTH weights for each category at most
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        if sent.value is None:
            found = np.zeros((batch.num_rows, n))
        else:
            found = sent.value.probabilities(*words_of([x or b"" for x in shared.raw(batch.column(at))]))
        lists = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * n, found.ravel())
        return pa.RecordBatch.from_arrays([*batch.columns, lists], names=names)

    schema = StructType([*rows.schema.fields, StructField(names[-1], ArrayType(DoubleType(), False), False)])
    return shared.map_arrow(rows, schema, add).toDF(*docs.columns, name)


def held_out(docs: DataFrame, labels: DataFrame, kinds: int = KINDS, sample: int = SAMPLE) -> dict[str, int]:
    """How a chain that learns from half of the labelled documents does on the other half: clean, rejected, toxic, missed."""
    half = F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2))
    marks = labels.where("toxic is not null").where(half == 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = scored(shared.id_and_text(docs), train(docs, labels.where(half == 0), sample, kinds), "scores", kinds).join(marks, "doc_id")
    bad, out = F.col("toxic") > 0, F.col("scores")[kinds] >= REJECT
    return found.agg(F.count_if(~bad).alias("clean"), F.count_if(~bad & out).alias("rejected"), F.count_if(bad).alias("toxic"), F.count_if(bad & ~out).alias("missed")).first().asDict()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, a column for each category, and predicted."""
    docs = shared.documents(spark, sf_dir)
    found = scored(shared.id_and_text(docs), train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "scores")
    return found.select("doc_id", *[F.col("scores")[k].alias(f"p_{x}") for k, x in enumerate(names_of())], (F.col("scores")[KINDS] >= REJECT).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't toxic; each row is judged by its own text."""
    name = shared.private(docs, "scores")
    found = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), name)
    return found.where(F.col(name)[KINDS] < REJECT).select(shared.columns(docs))
