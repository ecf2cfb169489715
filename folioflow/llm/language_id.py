"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of WINDOW bytes. One network reads each window forward, from MARGIN bytes before it on, and one
backward, from MARGIN bytes behind it on; a linear layer over both states labels every position of the window, and a
document's probabilities are the means over all its positions. States don't go over from window to window: what they know of the
text is at least MARGIN bytes on each side. Before a text's first and behind its last byte states are zero. The network is
trained in numpy by backpropagation through time.

Training uses WINDOWS windows, spread over the whole text, of each of the SAMPLE documents of the smallest hashes of their
doc_id, one text each: a documented bound on rows. Texts with fewer windows give all they have, so short ones are learned from
too. Prediction reads every byte of every text.

Cases: texts that are null or have no letter are `und` with score 0; labels that are null are not learned; without any
label all are `und`; ties go to the language that sorts first; a null doc_id is never learned from and not held out; an
empty table gives an empty result; columns besides doc_id, text and lang are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import shared

WINDOW, MARGIN, HIDDEN = 32, 8, 8
SPAN = WINDOW + 2 * MARGIN
SAMPLE, WINDOWS = 3000, 4
STEPS, BATCH, RATE, SEED = 240, 256, 0.03, 7
#: Windows that are run together.
BLOCK = 2048


@dataclass
class Network:
    """For each direction x (3H, 256), the input's part of update, reset and candidate gates by byte, and u (3H, H), the
    state's part; out (languages, 2H) and bias."""

    names: list[str]
    x: list[np.ndarray]
    u: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [*self.x, *self.u, self.out, self.bias]


def fresh(names: list[str], seed: int = SEED) -> Network:
    draw = np.random.default_rng(seed)
    normal = lambda scale, *shape: draw.normal(0, scale, shape).astype(np.float32)
    return Network(names, [normal(0.3, 3 * HIDDEN, 256) for _ in range(2)], [normal(0.3, 3 * HIDDEN, HIDDEN) for _ in range(2)], normal(0.3, len(names), 2 * HIDDEN), np.zeros(len(names), np.float32))


def _step(x: np.ndarray, u: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The gates (update, reset), the state's part of the candidate, the candidate and the new state."""
    part = u @ state
    gates = x[: 2 * HIDDEN] + part[: 2 * HIDDEN]
    gates *= 0.5
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    held = part[2 * HIDDEN :]
    candidate = gates[HIDDEN:] * held
    candidate += x[2 * HIDDEN :]
    np.tanh(candidate, out=candidate)
    new = state - candidate
    new *= gates[:HIDDEN]
    new += candidate
    return gates, held, candidate, new


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=0))
    p /= p.sum(axis=0)
    return p


def window_sums(net: Network, windows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(windows, languages): the sums of the positions' probabilities in each row of windows (n, SPAN), whose text is low to high."""
    found = np.empty((len(windows), len(net.names)), np.float32)
    for start in range(0, len(windows), BLOCK):
        byte = np.ascontiguousarray(windows[start : start + BLOCK].T)
        begin, end = low[start : start + BLOCK], high[start : start + BLOCK]
        n = byte.shape[1]
        state, ahead = np.zeros((HIDDEN, n), np.float32), np.empty((SPAN, len(net.names), n), np.float32)
        for t in range(MARGIN + WINDOW):
            state = _step(np.take(net.x[0], byte[t], axis=1, mode="clip"), net.u[0], state)[3]
            if t < MARGIN:
                state *= t >= begin
            else:
                np.matmul(net.out[:, :HIDDEN], state, out=ahead[t])
        state, total = np.zeros((HIDDEN, n), np.float32), np.zeros((len(net.names), n), np.float32)
        for t in range(SPAN - 1, MARGIN - 1, -1):
            inside = t < end
            state = _step(np.take(net.x[1], byte[t], axis=1, mode="clip"), net.u[1], state)[3]
            if not inside.all():
                state *= inside
            if t >= MARGIN + WINDOW:
                continue
            logits = ahead[t]
            logits += net.out[:, HIDDEN:] @ state
            logits += net.bias[:, None]
            p = np.exp(logits, out=logits)  # logits are small: at most the sum of the weights
            p /= p.sum(axis=0)
            if not inside.all():
                p *= inside
            total += p
        found[start : start + BLOCK] = total.T
    return found


def _gradients(net: Network, byte: np.ndarray, low: np.ndarray, high: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the cross-entropy of the positions of byte (SPAN, n), by backpropagation through time; a window's positions share its weight."""
    n, eye = byte.shape[1], np.eye(256, dtype=np.float32)
    steps = (range(MARGIN + WINDOW), range(SPAN - 1, MARGIN - 1, -1))
    inside = (np.arange(SPAN)[:, None] >= low) & (np.arange(SPAN)[:, None] < high)
    labelled = inside[MARGIN : MARGIN + WINDOW]
    share = (weight / np.maximum(1, labelled.sum(axis=0))).astype(np.float32)
    runs = []
    for d in range(2):
        state, kept = np.zeros((HIDDEN, n), np.float32), {}
        for t in steps[d]:
            gates, held, candidate, new = _step(net.x[d][:, byte[t]], net.u[d], state)
            kept[t] = (state, gates, held, candidate, new * inside[t])
            state = kept[t][4]
        runs.append(kept)
    dout, dbias, dstate = np.zeros_like(net.out), np.zeros_like(net.bias), ({}, {})
    hot = np.eye(len(net.names), dtype=np.float32)[:, target]
    for t in range(MARGIN, MARGIN + WINDOW):
        both = np.concatenate([runs[0][t][4], runs[1][t][4]])
        e = (softmax(net.out @ both + net.bias[:, None]) - hot) * (share * inside[t])
        dout += e @ both.T
        dbias += e.sum(axis=1)
        back = net.out.T @ e
        dstate[0][t], dstate[1][t] = back[:HIDDEN], back[HIDDEN:]
    dx, du = [np.zeros_like(a) for a in net.x], [np.zeros_like(a) for a in net.u]
    for d in range(2):
        carry = np.zeros((HIDDEN, n), np.float32)
        for t in reversed(steps[d]):
            state, gates, held, candidate, _ = runs[d][t]
            update, reset = gates[:HIDDEN], gates[HIDDEN:]
            dh = (dstate[d].get(t, np.float32(0)) + carry) * inside[t]
            dc = dh * (1 - update) * (1 - candidate * candidate)
            dz = dh * (state - candidate) * update * (1 - update)
            dr = dc * held * reset * (1 - reset)
            part = np.concatenate([dz, dr, dc * reset])
            du[d] += part @ state.T
            dx[d] += np.concatenate([dz, dr, dc]) @ eye[byte[t]]
            carry = dh * update + net.u[d].T @ part
    return [*dx, *du, dout, dbias]


def train(windows: np.ndarray, low: np.ndarray, high: np.ndarray, labels: np.ndarray, names: list[str]) -> Network:
    """Adam over random batches; languages weigh the same."""
    net, draw = fresh(names), np.random.default_rng(SEED)
    share = np.bincount(labels, minlength=len(names)) / len(labels)
    weight = (1 / np.maximum(share, 1e-9) / len(names))[labels].astype(np.float32)
    first, second = [np.zeros_like(a) for a in net.arrays()], [np.zeros_like(a) for a in net.arrays()]
    for step in range(1, STEPS + 1):
        at = draw.integers(0, len(windows), BATCH)
        rate = RATE * (1 - step / (STEPS + 1))
        for a, g, m, v in zip(net.arrays(), _gradients(net, windows[at].T, low[at], high[at], labels[at], weight[at] / BATCH), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (rate / (1 - 0.9**step)) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def cut(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a text with their margins, and where in each the text begins and ends."""
    n = -(-len(text) // WINDOW)
    padded = np.zeros(n * WINDOW + 2 * MARGIN, np.uint8)
    padded[MARGIN : MARGIN + len(text)] = np.frombuffer(text, np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(padded, SPAN)[::WINDOW] if n else np.zeros((0, SPAN), np.uint8)
    low, high = np.zeros(n, np.int64), np.minimum(SPAN, len(text) + MARGIN - WINDOW * np.arange(n))
    low[:1] = MARGIN
    return windows, low, high


def remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def sample(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]] | None:
    """Windows, their texts' begins and ends, labels and the languages' names of the documents to learn from; None without any."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and text <> ''").where(remainder(4) != 2)
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64(F.lit("lang"), F.col("doc_id")), "doc_id").limit(SAMPLE)
    rows = rows.join(F.broadcast(shared.scratch(chosen, "sample")), "doc_id")
    # the bound holds where ids repeat: of an id's rows the smallest is taken
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row")).select("doc_id", "row.lang", "row.text")

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for i, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shared.raw(batch.column(2)), strict=True):
            windows, low, high = cut(text)
            n = len(windows)
            for k in sorted({n * (2 * k + 1) // (2 * WINDOWS) for k in range(WINDOWS)}):
                out.append((i, k, lang, windows[k].tobytes(), low[k], high[k]))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "k", "lang", "cut", "low", "high"])

    found = shared.map_arrow(rows, "doc_id long, k long, lang string, cut binary, low int, high int", spread).toArrow().sort_by([("doc_id", "ascending"), ("k", "ascending")])
    if not found.num_rows:
        return None
    names = sorted(set(found.column("lang").to_pylist()))
    labels = np.array([names.index(x) for x in found.column("lang").to_pylist()])
    windows = np.frombuffer(b"".join(found.column("cut").to_pylist()), np.uint8).reshape(-1, SPAN)
    return windows, found.column("low").to_numpy(), found.column("high").to_numpy(), labels, names


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score, probabilities of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        net, n = sent.value, batch.num_rows
        texts = batch.column(1).to_pylist()
        known = [net is not None and any(map(str.isalpha, x)) for x in texts]
        best, score, p = ["und"] * n, np.zeros(n), np.zeros((n, len(net.names) if net else 0))
        if any(known):
            cuts = [cut(x.encode()) for x, k in zip(texts, known, strict=True) if k]
            sums = window_sums(net, *(np.concatenate([c[k] for c in cuts]) for k in range(3)))
            starts = np.r_[0, np.cumsum([len(c[0]) for c in cuts])[:-1]]
            total = np.add.reduceat(sums.astype(np.float64), starts, axis=0)
            at = np.flatnonzero(known)
            p[at] = total / total.sum(axis=1, keepdims=True)
            score[at] = p[at].max(axis=1)
            for i in at:
                best[i] = net.names[int(p[i].argmax())]
        lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * p.shape[1], p.ravel())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(best), pa.array(score), lists], ["doc_id", "lang_pred", "score", "probabilities"])

    return shared.map_arrow(shared.id_and_text(docs), "doc_id long, lang_pred string, score double, probabilities array<double>", label)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    found = sample(docs)
    out = identify(docs, train(*found) if found else None)
    return out.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
