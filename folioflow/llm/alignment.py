"""Alignment of two tokenizers' tokens over the corpus: which tokens of one stand for which tokens of the other.

Each tokenizer's token ends are a packed bitset over the bytes of the texts; the AND of both has the shared cuts. Popcounts of
the bits up to a cut say how many tokens of either end there, so consecutive cuts give the ranges of tokens between them: a
group. Within a group each token of the first is linked to each token of the second.

A text is cut beforehand before each space that follows anything but white space and isn't the last character: both tokenizers end a token there whatever
stands around. The first one's splitter does; that no piece of the second one goes over such a space is checked over its
vocabulary, and texts stay whole otherwise. So groups don't go over these cuts: stretches are aligned once, many at a time,
and remembered, and texts are put together from them.

How many documents hold a pair is counted over all documents. The counts go back to the documents by a broadcast table
where they are PAIRS at most, which is checked, and by a join beyond.

Cases: null and empty texts, and those that a tokenizer doesn't give back byte by byte, have no tokens: zeros, an empty
digest, and they hold no pair; documents are rows, so a repeated row is another document that holds its pairs; an empty table
gives an empty result; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import shared

#: Pairs whose counts are broadcast, 17 bytes each; stretches that a worker remembers.
PAIRS, STRETCHES = 1 << 21, 300_000
#: Links of a group that are put out one by one; what is repeated in a larger one is counted first.
LARGE = 4096
FOUND = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
#: How byte-level tokenizers split text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Bits:
    """A packed bitset with ranks: how many bits are set up to a place."""

    def __init__(self, at: np.ndarray, size: int):
        flags = np.zeros(-(-(size + 1) // 64) * 64, bool)
        flags[at] = True
        self.words = np.packbits(flags, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]

    def rank(self, at: np.ndarray) -> np.ndarray:
        upto = ~np.uint64(0) >> (63 - (at & 63)).astype(np.uint64)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & upto)


def groups(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shared cuts, and how many tokens of each end at or before them, from the bytes at which tokens end."""
    a, b = Bits(ends_a, size), Bits(ends_b, size)
    cuts = np.flatnonzero(np.unpackbits((a.words & b.words).view(np.uint8), bitorder="little"))
    return cuts, a.rank(cuts), b.rank(cuts)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones for themselves, those from 256 on for the others."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at starts, one after the other."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


class Aligner:
    """Two tokenizers, and the stretches of text that were aligned before."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        own = Tokenizer.from_file(path_a)
        own.encode_special_tokens = True  # their strings in a text are ordinary text
        byte, special = _byte_of(), own.get_added_tokens_decoder()
        vocabulary = {i: bytes(byte[c] for c in t) for t, i in own.get_vocab().items() if i not in special}
        self.bytes_a = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        self.encode_a = self.ranked(path_a, vocabulary) or (lambda texts: [x.ids for x in own.encode_batch(texts, add_special_tokens=False)])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_b = len(pieces)
        self.length_a, self.length_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(pieces)))]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.forget()

    @staticmethod
    def ranked(path: str, vocabulary: dict[int, bytes]):
        """A faster encoder of the same ids, where the file's merges are numbered as its entries are and its splitter is SPLIT."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        byte = _byte_of()
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        made = [bytes(byte[c] for c in x + y) for x, y in merges]
        level = told["pre_tokenizer"] or {}
        plain = level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space") and not told["normalizer"]
        if not plain or [vocabulary.get(256 + k) for k in range(len(made))] != made or len(vocabulary) != 256 + len(made):
            return None
        own = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={b: i for i, b in vocabulary.items()}, special_tokens={})
        return lambda texts: list(map(own.encode_ordinary, texts))

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.shown: list[str] = []
        #: Of each stretch: tokens of both, groups, links, whether it came back byte by byte; its pairs and their times.
        self.sums, self.held = np.zeros((5, 0), np.int64), np.zeros(0, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def stretches(self, text: str) -> list[str]:
        """Parts of the text, each after a space: they and the spaces make up a space and the text."""
        if not self.cuts:
            return [text]
        if not (text[:1] == " " or text[-1:] == " " or re.search(r"\s ", text)):
            return text.split(" ")
        return [s[1:] for s in re.split(r"(?s)(?<=\S)(?= .)", " " + text)]

    def learn(self, new: list[str]) -> None:
        """Aligns stretches, all of them at once."""
        if not new:
            return
        a, b = self.encode_a([" " + s for s in new]), self.b.encode(new, num_threads=1)
        raw = [(" " + s).encode() for s in new]
        back = np.ones(len(new), bool)
        for ids, entries in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join(entries[i] for x in ids for i in x) != b"".join(raw) or any(sum(len(entries[i]) for i in x) != len(r) for x, r in zip(ids, raw, strict=True)):
                back &= [b"".join(entries[i] for i in x) == r for x, r in zip(ids, raw, strict=True)]
        if not back.all():
            a, b = ([x if ok else [] for x, ok in zip(ids, back, strict=True)] for ids in (a, b))
        n_a, n_b = (np.array(list(map(len, x))) for x in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        cuts, upto_a, upto_b = groups(ends_a, ends_b, int(ends_a[-1]) if len(ends_a) else 0)
        if len(cuts):
            # each stretch ends at a cut: its groups are those whose last token is one of its own
            n_groups = np.diff(np.r_[0, np.searchsorted(upto_a, np.cumsum(n_a), "right")])
        else:
            n_groups = np.zeros(len(new), np.int64)
        from_a, from_b = np.r_[0, upto_a[:-1]][: len(cuts)], np.r_[0, upto_b[:-1]][: len(cuts)]
        size_a, size_b = upto_a - from_a, upto_b - from_b
        own = np.repeat(np.arange(len(new)), n_groups)
        links = size_a * size_b
        small = np.flatnonzero(links <= LARGE)
        k = np.repeat(small, links[small])
        within = np.arange(len(k)) - np.repeat(np.r_[0, np.cumsum(links[small])[:-1]], links[small])
        pairs = ids_a[from_a[k] + within // size_b[k]] * self.size_b + ids_b[from_b[k] + within % size_b[k]]
        whose, times = own[k], np.ones(len(k), np.int64)
        for g in np.flatnonzero(links > LARGE).tolist():
            mine, theirs = (np.unique(ids[start : start + size], return_counts=True) for ids, start, size in ((ids_a, from_a[g], size_a[g]), (ids_b, from_b[g], size_b[g])))
            more = (mine[0][:, None] * self.size_b + theirs[0]).ravel()
            pairs, times, whose = np.r_[pairs, more], np.r_[times, np.outer(mine[1], theirs[1]).ravel()], np.r_[whose, np.full(len(more), own[g])]
        if len(small) < len(links):
            order = np.argsort(whose, kind="stable")
            pairs, times, whose = pairs[order], times[order], whose[order]
        names_a, names_b = ([self.names[i] for i in ids.tolist()] for ids in (ids_a, ids_b))
        shown = [",".join(names_a[i:m]) + "|" + ",".join(names_b[j:n]) for i, m, j, n in zip(from_a.tolist(), upto_a.tolist(), from_b.tolist(), upto_b.tolist(), strict=True)]
        bounds = np.r_[0, np.cumsum(n_groups)].tolist()
        self.known.update(zip(new, range(len(self.shown), len(self.shown) + len(new)), strict=True))
        self.shown += [";".join(shown[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        sums = np.stack([n_a, n_b, n_groups, np.bincount(own, links, len(new)).astype(np.int64), ~back])
        self.sums, self.held = np.c_[self.sums, sums], np.r_[self.held, np.bincount(whose, minlength=len(new))]
        self.pairs, self.times = np.r_[self.pairs, pairs], np.r_[self.times, times]

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """n_a, n_b, n_groups, n_links of each text; digests of the groups; pairs, each once, and their times."""
        if len(self.known) > STRETCHES:
            self.forget()
        parts = [self.stretches(t) if t else [] for t in texts]
        self.learn([s for s in dict.fromkeys(chain.from_iterable(parts)) if s not in self.known])
        starts = np.r_[0, np.cumsum(self.held)[:-1]] if len(self.held) else self.held
        sums, digests, pairs, times = np.zeros((4, len(texts)), np.int64), [""] * len(texts), [], []
        for k, part in enumerate(parts):
            at = np.fromiter(map(self.known.__getitem__, part), np.int64, len(part))
            total = self.sums[:, at].sum(axis=1)
            if total[4] or not len(at):
                at = at[:0]
            else:
                sums[:, k] = total[:4]
                digests[k] = hashlib.sha256(";".join(map(self.shown.__getitem__, at.tolist())).encode()).hexdigest()
            places = ragged(starts[at], self.held[at]) if len(at) else at
            own, inverse = np.unique(self.pairs[places], return_inverse=True)
            pairs.append(own)
            times.append(np.bincount(inverse, self.times[places], len(own)).astype(np.int32))
        return sums, digests, pairs, times


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner_of(paths: tuple[str, str]) -> Aligner:
    """One for each Python worker, so that later tasks find the stretches of earlier ones."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def links(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """FOUND of every row of docs: its pairs of ids (the first's times the size of the second vocabulary, plus the second's), each
    once, and how many links each has."""

    def align(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums, digests, pairs, times = aligner_of(paths).texts(batch.column(1).to_pylist())
        offsets = pa.array(np.r_[0, np.cumsum(list(map(len, pairs)))], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (pairs, times)]
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), pa.array(digests, pa.string()), *lists], [x.split()[0] for x in FOUND.split(", ")])

    return shared.map_arrow(shared.id_and_text(docs), FOUND, align)


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """pair, documents (that hold it), best (no pair of its first id is held by more)."""
    rows = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("documents"))
    rows = shared.scratch(rows.withColumn("a", F.call_function("div", F.col("pair"), F.lit(size_b))), "pairs")
    most = rows.groupBy("a").agg(F.max("documents").alias("most"))
    return rows.join(most, "a").select("pair", "documents", (F.col("documents") == F.col("most")).alias("best"))


def scored(found: DataFrame, counts: DataFrame, most: int = PAIRS) -> DataFrame:
    """found with n_best and count_sum in place of its pairs."""
    shown = [c for c in found.columns if c not in ("pairs", "times")]
    counts = shared.scratch(counts, "counts")
    if counts.count() > most:
        rows = shared.scratch(found.withColumn("row", F.monotonically_increasing_id()), "rows")
        each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
        sums = each.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return rows.join(sums, "row", "left").select(*shown, zero("n_best"), zero("count_sum"))
    table = counts.orderBy("pair").toArrow()  # `most` rows at most
    pairs, documents, best = (table.column(k).to_numpy() for k in range(3))
    known = found.sparkSession.sparkContext.broadcast((pairs, documents, best))

    def look_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs, documents, best = known.value
        held, times = (batch.column(batch.schema.get_field_index(c)) for c in ("pairs", "times"))
        times = times.flatten().to_numpy().astype(np.int64)
        at = np.searchsorted(pairs, held.flatten().to_numpy())
        upto = np.r_[0, np.cumsum(held.value_lengths().to_numpy())]
        sums = [np.diff(np.r_[0, np.cumsum(x)][upto]) for x in (times * best[at], times * documents[at])]
        return pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in shown], *map(pa.array, sums)], [*shown, "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*shown).schema.fields)
    return shared.map_arrow(found, f"{schema}, n_best long, count_sum long", look_up)


def align(docs: DataFrame, paths: tuple[str, str] | None = None, most: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row of docs."""
    import sentencepiece

    paths = paths or default_tokenizers()
    size_b = sentencepiece.SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    found = shared.scratch(links(docs, paths), "links")
    return scored(found, pair_counts(found, size_b), most)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(shared.documents(spark, sf_dir))
