"""Language-model scores of whole texts by an n-gram trie whose levels are Elias-Fano sequences.

The model: words have ids, dealt by a hash over parts of the vocabulary, and counts. A level holds the n-grams of one length
of the training texts, all of them: contexts, monotone pointers to their successors, and a quantised smoothed probability of
each. It is dealt over shards by context, and a context that holds much of the corpus over as many shards as its share asks
for, by the next word's hash. Each shard is one flat buffer (`elias_fano.Level`), a row of a table.

Smoothing: P(w | context) = (count(context w) + MU * P(w | shorter context)) / (count(context) + MU), from the add-one
probabilities of words up. They sum to 1 over the vocabulary and one unknown word. An n-gram that isn't there has the
shorter context's probability times MU / (count(context) + MU), so the context's count alone is needed for it.

Scoring: texts are cut into words and stored in blocks with a vocabulary each. A block asks each shard for the distinct
n-grams it has, ascending; the shard searches each among its context's successors and answers in the same order, a byte
each. What a block asks and is told is a share of its text, and nothing is held whole anywhere.

Cases: null text is empty and has the end alone; a null id counts as empty text where documents are held out, and stays null;
repeated rows count, and are scored, as often as they occur; without training texts each token has probability 1 by both
scores; an empty table gives an empty result; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import shared
from folioflow.llm.elias_fano import Level

ORDER, MU = 2, 32.0
#: Bytes of text in a block, tokens of the corpus for each shard of a level, blocks for each part of the vocabulary.
BLOCK, SHARD, PART = 16 << 20, 2_000_000, 4
#: Codes of probabilities: 1 to 255 are steps of STEP in the negative logarithm; 0 is an n-gram that isn't there.
STEP = 0.05
END = b"\n"

BLOCKS = "block long, docs array<long>, held array<boolean>, lengths array<long>, words binary, tokens binary"
ASKED = "shard long, block long, contexts binary, runs binary, words binary"
TAUGHT = "shard long, contexts binary, sizes binary, runs binary, words binary, counts binary, lower binary"
TOLD = "block long, level int, shard long, codes binary, nodes binary, counts binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0, as planes of their bytes without the empty ones."""
    wide = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([wide]) + np.ascontiguousarray(values, np.int64).view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()


def unpack(data) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8)
    planes = flat[1:].reshape(flat[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(np.int64).ravel()


def pack_runs(values: np.ndarray, runs: np.ndarray) -> bytes:
    """Numbers that ascend within runs, as differences."""
    steps = np.diff(values, prepend=0)
    starts = np.cumsum(runs) - runs
    steps[starts] = values[starts]
    return pack(steps)


def unpack_runs(data, runs: np.ndarray) -> np.ndarray:
    steps = unpack(data)
    sums, starts = np.cumsum(steps), np.cumsum(runs) - runs
    return sums - np.repeat(sums[starts] - steps[starts], runs)


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(p) / STEP) + 1, 1, 255).astype(np.uint8)


def probability(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** (-STEP * (codes.astype(np.float64) - 1))


def is_held(doc: int | None) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % 7 == 2


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    names, types = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types, strict=True)], list(names))


def table_of(schema: str, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch_of(schema, rows)])


def blocks(docs: DataFrame) -> DataFrame:
    """Texts as words, in blocks of BLOCK bytes or one text: each has its own vocabulary, whose first entry is the end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        number, found, size = shared.Numbers({END: 0}), [], 0

        def block():
            ids, lengths, tokens = zip(*found)
            return batch_of(BLOCKS, [((part << 24) + n, ids, list(map(is_held, ids)), lengths, b" ".join(number), np.concatenate(tokens).tobytes())])

        for batch in shared.slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), shared.raw(batch.column(1)), strict=True):
                words = text.lower().split()
                tokens = np.fromiter(map(number.__getitem__, words), np.uint32, len(words))
                found.append((doc, len(words) + 1, np.append(tokens, np.uint32(0))))
                size += len(text) + 16
                if size > BLOCK:
                    yield block()
                    number, found, size, n = shared.Numbers({END: 0}), [], 0, n + 1
        if found:
            yield block()

    return shared.bucketed(shared.id_and_text(docs).mapInArrow(cut, BLOCKS), "block", "blocks")


@dataclass(frozen=True)
class Block:
    """A block in the order of the model's ids: tokens are ranks of ids among the block's words, unknown words last."""

    docs: list
    held: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray
    ids: np.ndarray
    counts: np.ndarray

    @property
    def train(self) -> np.ndarray:
        return np.repeat(~self.held, self.lengths)

    @property
    def first(self) -> np.ndarray:
        """The place of each document's first token."""
        return np.cumsum(self.lengths) - self.lengths


def parts_of(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).astype(np.uint64) % np.uint64(parts)


def _row(table: pa.Table, name: str):
    return table.column(name)[0].as_py()


def block_of(own: pa.Table, told: pa.Table, parts: int) -> Block:
    words, tokens = _row(own, "words").split(b" "), np.frombuffer(_row(own, "tokens"), np.uint32)
    ids, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
    part = parts_of(words, parts)
    for level, shard, nodes, own_counts in zip(*(told.column(c).to_pylist() for c in ("level", "shard", "nodes", "counts")), strict=True):
        if level == 1:
            at = np.flatnonzero(part == shard)
            ids[at], counts[at] = unpack(nodes) - 1, unpack(own_counts)
    order = np.argsort(np.where(ids < 0, np.iinfo(np.int64).max, ids), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return Block(_row(own, "docs"), np.array(_row(own, "held"), bool), np.array(_row(own, "lengths"), np.int64), rank[tokens], ids[order], counts[order])


@dataclass
class Model:
    """Tables of the vocabulary and of levels 2 and up, and what is known of all of them."""

    order: int
    mu: float
    parts: int
    shards: int
    tokens: int
    distinct: int
    vocabulary: DataFrame
    levels: list[DataFrame] = field(default_factory=list)

    @property
    def facts(self) -> tuple[float, int, int, int, int]:
        return self.mu, self.parts, self.shards, self.tokens, self.distinct


@dataclass
class Step:
    """The n-grams of a block at one level: distinct ones by shard, context and word, and which of them each token ends."""

    contexts: np.ndarray
    sizes: np.ndarray
    words: np.ndarray
    shard: np.ndarray
    at: np.ndarray

    def runs(self, some: slice) -> tuple[np.ndarray, np.ndarray]:
        """Where contexts begin in a part, and how many words each has there."""
        own = self.contexts[some]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        return starts, np.diff(np.r_[starts, len(own)])

    def by_shard(self) -> Iterator[tuple[int, slice]]:
        if not len(self.shard):
            return
        starts = np.flatnonzero(np.r_[True, self.shard[1:] != self.shard[:-1]])
        for a, b in zip(starts, [*starts[1:], len(self.shard)], strict=True):
            yield int(self.shard[a]), slice(int(a), int(b))


def step_of(block: Block, contexts: np.ndarray, sizes: np.ndarray, shards: int, tokens: int) -> Step:
    """contexts and sizes: of each token, the node of the words before it, -1 if it isn't there, and its count."""
    word = block.ids[block.tokens]
    known = np.flatnonzero((contexts >= 0) & (word >= 0))
    nodes, inverse = np.unique(contexts[known], return_inverse=True)
    own, inverse = np.unique(inverse << 32 | block.tokens[known], return_inverse=True)
    contexts_, words = nodes[own >> 32], block.ids[own & 0xFFFFFFFF]
    # of what ends here any token tells the context's count
    one = np.empty(len(own), np.int64)
    one[inverse] = known
    size = sizes[one]
    spread = np.minimum(shards, 1 + (4.0 * size * shards / max(1, tokens)).astype(np.int64))
    mixed = (words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
    shard = (contexts_ + mixed % spread) % shards
    order = np.argsort(shard, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = np.full(len(word), -1, np.int64)
    at[known] = rank[inverse]
    return Step(contexts_[order], size[order], words[order], shard[order], at)


def before(block: Block, values: np.ndarray, start) -> np.ndarray:
    """Each token's predecessor's value; start for a document's first."""
    found = np.r_[values[:1], values[:-1]]
    found[block.first] = start
    return found


def steps(block: Block, told: pa.Table, facts: tuple, upto: int) -> tuple[np.ndarray, np.ndarray, Step | None]:
    """Add-one probabilities of the tokens; those by all levels below upto that are told; the n-grams of level upto."""
    mu, _, shards, tokens, distinct = facts
    base = (block.counts[block.tokens] + 1.0) / (tokens + distinct + 1.0)
    p, step = base.copy(), None
    nodes, counts = block.ids[block.tokens], block.counts[block.tokens]
    end = np.flatnonzero(block.lengths.cumsum() > 0)[:1]
    last = block.tokens[block.lengths.cumsum()[end] - 1]  # the end's rank
    start, start_count = (block.ids[last], block.counts[last]) if len(last) else (-1, 0)
    rows = list(zip(*(told.column(c).to_pylist() for c in ("level", "shard", "codes", "nodes", "counts")), strict=True))
    for level in range(2, upto + 1):
        contexts, sizes = before(block, nodes, start), before(block, counts, start_count)
        step = step_of(block, contexts, sizes, shards, tokens)
        if level == upto:
            break
        slices = dict(step.by_shard())
        codes, nodes_, counts_ = np.zeros(len(step.words), np.uint8), np.full(len(step.words), -1, np.int64), np.zeros(len(step.words), np.int64)
        for own, shard, c, n, k in rows:
            if own == level:
                codes[slices[shard]] = np.frombuffer(c, np.uint8)
                if n is not None:
                    nodes_[slices[shard]], counts_[slices[shard]] = unpack(n) - 1, unpack(k)
        has = step.at >= 0
        code = np.where(has, codes[step.at] if len(codes) else 0, 0)
        shorter = p * np.where(sizes > 0, mu / (sizes + mu), 1.0)
        p = np.where(code > 0, probability(code), shorter)
        nodes, counts = (np.where(has, x[step.at] if len(x) else e, e) for x, e in ((nodes_, -1), (counts_, 0)))
        start, start_count = -1, 0
    return base, p, step


def vocabulary(found: DataFrame, parts: int) -> DataFrame:
    """shard, words, counts (of training tokens), n, distinct: most frequent first. A word's id is its place times parts plus shard."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(batch.schema.get_field_index(c))[k].as_py() for c in ("held", "lengths", "words", "tokens")}
                words = np.array(row["words"].split(b" "), object)
                counts = np.bincount(np.frombuffer(row["tokens"], np.uint32)[np.repeat(~np.array(row["held"], bool), row["lengths"])], minlength=len(words))
                part = parts_of(words.tolist(), parts)
                for p in np.unique(part).tolist():
                    at = np.flatnonzero((part == p) & (counts > 0))
                    if len(at):
                        yield batch_of("shard long, words binary, counts binary", [(p, b" ".join(words[at].tolist()), pack(counts[at]))])

    def merge(table: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        for words, counts in zip(table.column("words"), table.column("counts"), strict=True):
            for w, n in zip(words.as_py().split(b" "), unpack(counts.as_buffer()).tolist(), strict=True):
                total[w] = total.get(w, 0) + n
        ranked = sorted(total.items(), key=lambda x: (-x[1], x[0]))
        counts = np.array([n for _, n in ranked], np.int64)
        return table_of("shard long, words binary, counts binary, n long, distinct long", [(_row(table, "shard"), b" ".join(w for w, _ in ranked), pack(counts), int(counts.sum()), len(ranked))])

    own = found.mapInArrow(emit, "shard long, words binary, counts binary")
    return shared.scratch(own.groupBy("shard").applyInArrow(merge, "shard long, words binary, counts binary, n long, distinct long"), "vocabulary")


def told_words(found: DataFrame, model: Model) -> DataFrame:
    """TOLD of level 1: the ids (and 1 more) and counts of each block's words."""
    parts = model.parts

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, joined in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.array(joined.split(b" "), object)
                part = parts_of(words.tolist(), parts)
                for p in np.unique(part).tolist():
                    yield batch_of("shard long, block long, words binary", [(p, block, b" ".join(words[part == p].tolist()))])

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        rank, counts, rows = {}, np.zeros(1, np.int64), []
        if own.num_rows:
            rank = {w: k for k, w in enumerate(_row(own, "words").split(b" "))}
            counts = np.r_[unpack(_row(own, "counts")), 0]
        for shard, block, words in zip(*(asked.column(c).to_pylist() for c in ("shard", "block", "words")), strict=True):
            at = np.fromiter((rank.get(w, -1) for w in words.split(b" ")), np.int64)
            rows.append((block, 1, shard, None, pack(np.where(at < 0, 0, at * parts + shard + 1)), pack(counts[at])))
        return table_of(TOLD, rows)

    asked = found.select("block", "words").mapInArrow(ask, "shard long, block long, words binary")
    return shared.bucketed(asked.groupBy("shard").cogroup(model.vocabulary.groupBy("shard")).applyInArrow(answer, TOLD), "block", "words")


def with_told(found: DataFrame, told: DataFrame, f, schema: str) -> DataFrame:
    """f of each block's row and what it was told."""
    return found.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(f, schema)


def level(found: DataFrame, told: DataFrame, model: Model, number: int) -> DataFrame:
    """shard, level, n: the n-grams of a length, from training texts."""
    facts, last = model.facts, number == model.order

    def teach(own: pa.Table, words: pa.Table) -> pa.Table:
        block = block_of(own, words, facts[1])
        _, p, step = steps(block, words, facts, number)
        train = np.flatnonzero(block.train & (step.at >= 0))
        counts = np.bincount(step.at[train], minlength=len(step.words))
        lower = np.zeros(len(step.words), np.uint8)
        lower[step.at[train]] = quantised(p[train])
        kept = np.flatnonzero(counts)
        step = Step(step.contexts[kept], step.sizes[kept], step.words[kept], step.shard[kept], step.at)
        counts, lower, rows = counts[kept], lower[kept], []
        for shard, some in step.by_shard():
            starts, runs = step.runs(some)
            contexts, one = step.contexts[some][starts], np.array([len(starts)])
            rows.append((shard, pack_runs(contexts, one), pack(step.sizes[some][starts]), pack(runs), pack_runs(step.words[some], runs), pack(counts[some]), lower[some].tobytes()))
        return table_of(TAUGHT, rows)

    def learn(table: pa.Table) -> pa.Table:
        parts = []
        for contexts, sizes, runs, words, counts, lower in zip(*(table.column(c).to_pylist() for c in TAUGHT.replace(" long", "").replace(" binary", "").split(", ")[1:]), strict=True):
            runs = unpack(runs)
            parts.append([np.repeat(unpack_runs(contexts, np.array([len(runs)])), runs), np.repeat(unpack(sizes), runs), unpack_runs(words, runs), unpack(counts), np.frombuffer(lower, np.uint8)])
        contexts, sizes, words, counts, lower = (np.concatenate(x) for x in zip(*parts))
        del parts
        nodes, inverse = np.unique(contexts, return_inverse=True)
        names, name = np.unique(words, return_inverse=True)
        own, first, inverse = np.unique(inverse << 32 | name, return_index=True, return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, inverse, counts)
        mu = facts[0]
        p = (total + mu * probability(lower[first])) / (sizes[first] + mu)
        made = Level.of(nodes[own >> 32], names[own & 0xFFFFFFFF], quantised(p), np.zeros(len(own), np.int64) if last else total)
        return table_of("shard long, level binary, n long", [(_row(table, "shard"), made.to_bytes(), len(own))])

    return shared.scratch(with_told(found, told, teach, TAUGHT).groupBy("shard").applyInArrow(learn, "shard long, level binary, n long"), f"level-{number}")


def told_level(found: DataFrame, told: DataFrame, model: Model, number: int) -> DataFrame:
    """TOLD of a level: codes of each block's n-grams, and of all levels but the last also their nodes (and 1 more) and counts."""
    facts, shards, last = model.facts, model.shards, number == model.order

    def ask(own: pa.Table, words: pa.Table) -> pa.Table:
        block = block_of(own, words, facts[1])
        step, rows = steps(block, words, facts, number)[2], []
        for shard, some in step.by_shard():
            starts, runs = step.runs(some)
            rows.append((shard, _row(own, "block"), pack_runs(step.contexts[some][starts], np.array([len(starts)])), pack(runs), pack_runs(step.words[some], runs)))
        return table_of(ASKED, rows)

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        level, rows = (Level.at(own.column("level")[0].as_buffer()) if own.num_rows else None), []
        for shard, block, contexts, runs, words in zip(*(asked.column(c).to_pylist() for c in ("shard", "block", "contexts", "runs", "words")), strict=True):
            runs = unpack(runs)
            contexts, words = np.repeat(unpack_runs(contexts, np.array([len(runs)])), runs), unpack_runs(words, runs)
            at = level.find(contexts, words) if level else np.full(len(words), -1, np.int64)
            there = np.flatnonzero(at >= 0)
            codes = np.zeros(len(at), np.uint8)
            nodes = counts = None
            if len(there):
                codes[there] = level.codes[at[there]]
            if not last:
                counts = np.zeros(len(at), np.int64)
                if len(there):
                    counts[there] = level.counts[at[there]]
                nodes, counts = pack(np.where(at < 0, 0, at * shards + shard + 1)), pack(counts)
            rows.append((block, number, shard, codes.tobytes(), nodes, counts))
        return table_of(TOLD, rows)

    asked = with_told(found, told, ask, ASKED)
    return shared.scratch(asked.groupBy("shard").cogroup(model.levels[number - 2].groupBy("shard")).applyInArrow(answer, TOLD), f"told-{number}")


def fitted(found: DataFrame, order: int = ORDER, mu: float = MU) -> tuple[Model, DataFrame]:
    """The model of the training texts among blocks, and what the blocks are told of all levels but the last."""
    n = found.agg(F.count("*"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    parts, shards = max(8, n[0] // PART), max(8, -(-(n[1] or 0) // SHARD))
    words = vocabulary(found, parts)
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    model = Model(order, mu, parts, shards, tokens, distinct, words.drop("n", "distinct"))
    told = told_words(found, model)
    for number in range(2, order + 1):
        model.levels.append(level(found, told, model, number))
        if number < order:
            told = told.unionByName(told_level(found, told, model, number))
    return model, told


def told_all(found: DataFrame, model: Model) -> DataFrame:
    """What other texts' blocks are told of all levels but the last."""
    told = told_words(found, model)
    for number in range(2, model.order):
        told = told.unionByName(told_level(found, told, model, number))
    return told


def scored(found: DataFrame, told: DataFrame, model: Model) -> DataFrame:
    """SCORES of each document of the blocks."""
    facts, order = model.facts, model.order
    if order > 1:
        told = told.unionByName(told_level(found, told, model, order))

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        block = block_of(own, told, facts[1])
        base, p, _ = steps(block, told, facts, order + 1)
        sums = [np.add.reduceat(x, block.first).tolist() for x in (np.log10(base), np.log10(p), (block.counts[block.tokens] > 0).astype(np.int64))]
        rows = zip(block.docs, block.held.tolist(), block.lengths.tolist(), sums[2], [facts[3]] * len(block.docs), sums[0], sums[1], strict=True)
        return table_of(SCORES, list(rows))

    return with_told(found, told, score, SCORES)


def score(docs: DataFrame, order: int = ORDER, mu: float = MU) -> DataFrame:
    """SCORES of every row of docs by the model of those that aren't held out."""
    found = blocks(docs)
    model, told = fitted(found, order, mu)
    return scored(found, told, model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(shared.documents(spark, sf_dir))
