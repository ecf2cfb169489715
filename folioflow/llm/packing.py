"""Best-fit packing by sums of squares.

Documents are tokenized and cut into pieces that fit a sequence. Each piece goes where the sum over all gaps g of
(number of open sequences with g tokens left) squared becomes smallest; a new sequence is one of the choices.

Pieces are dealt by a hash into groups of bounded size that are packed independently. What each group leaves open is packed
again, as items of its filled length, in fewer and fewer groups, so that independent groups leave few sequences part empty.

Cases: null text is empty and has the end id alone; pieces as long as a sequence take one each; repeated rows are packed
as often as they occur; an empty table gives an empty result; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import os
import string
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import shared

LENGTH = 2048
END = b"\0\0\0\0"
PUNCTUATION = string.punctuation.encode()
#: Pieces in a group, in the mean; groups that meet in one when what they left open is packed again.
GROUP, FAN_IN = 1 << 14, 32
#: Sequences with a smaller gap are left as they are.
SMALL_GAP = 16
#: Words whose ids a worker remembers; it starts anew beyond.
WORDS = 150_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_characters() -> list[str]:
    """The character that byte-level BPE writes for each byte: printable ones stand for themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordTokenizer(dict):
    """Ids of texts under a tokenizer that never joins what white space separates; words are looked up once.

    White space here is ASCII's, which the tokenizer's own \\s holds; other white space is left inside the words. The
    tokenizer lower-cases, so A-Z are lowered before the look-up, unless the text may hold a special token. Words of
    Latin letters, also with ASCII punctuation behind, are what the tokenizer's splitter makes of them, and go to its
    model directly; all others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own, self.characters = Tokenizer.from_file(path), _byte_characters()
        self.model, self.letters = self.own.model, {}

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _letters(self, word: bytes) -> bytes | None:
        """The ids of a word of Latin letters, None for another."""
        if word in self.letters:
            return self.letters[word]
        if word.isalpha():  # ASCII letters, lowered already
            mapped = word.decode()
        else:
            text = word.decode()
            if not text.isalpha() or max(text) > "\u024f":
                return None
            text = "".join(c.lower() for c in unicodedata.normalize("NFC", text))
            if not text.isalpha():
                return None
            mapped = "".join(map(self.characters.__getitem__, text.encode()))
        self.letters[word] = ids = self._bytes([t.id for t in self.model.tokenize(mapped)])
        return ids

    def __missing__(self, word: bytes) -> bytes:
        """The ids of a word seen for the first time."""
        base = word.rstrip(PUNCTUATION)
        tail = word[len(base) :]
        ids = self._letters(base) if base else None
        if ids is None:
            ids = self._bytes(self.own.encode(word.decode(), add_special_tokens=False).ids)
        elif tail:
            ids += self[tail]
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if b"<|" in text:
            return self._bytes(self.own.encode(text.decode(), add_special_tokens=False).ids)
        if len(self) > WORDS:
            self.clear()
            self.letters.clear()
        return b"".join(map(self.__getitem__, text.lower().split()))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_of(path: str) -> WordTokenizer:
    """One for each Python worker, so that later tasks find the words of earlier ones."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """The pieces of each document: its ids and the end id, cut where longer than a sequence."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, rows = tokenizer_of(tokenizer), []
        for doc, text in zip(batch.column(0).to_pylist(), shared.raw(batch.column(1)), strict=True):
            ids = own.encode(text) + END
            n = len(ids) // 4
            for k, start in enumerate(range(0, n, length)):
                rows.append((doc, k, start, min(length, n - start), zlib.crc32(ids[4 * start : 4 * (start + length)])))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return shared.map_arrow(shared.id_and_text(docs), PIECES, cut)


def sum_of_squares(lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each item, placed in the order given."""
    count = np.zeros(length + 1, np.int64)  # of open sequences by gap
    open_, placed, offset, made = {}, np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        # the change in the sum of squares for each gap from size on; one sequence leaves its gap and enters gap - size
        change = 2 * (count[: length - size] - count[size:length]) + 2
        change[:1] -= 2 * count[0] + 1  # a full sequence isn't counted
        change[count[size:length] == 0] = far
        gap = int(change.argmin()) + size if len(change) else length
        if gap == length or change[gap - size] == far or change[gap - size] > 2 * count[length - size] + 1:
            at, gap = made, length
            made += 1
        else:
            at = open_[gap].pop()
            count[gap] -= 1
        placed[i], offset[i] = at, length - gap
        if left := gap - size:
            count[left] += 1
            open_.setdefault(left, []).append(at)
    return placed, offset


def _packed(items: DataFrame, level: int, groups: int, length: int) -> DataFrame:
    """key, size -> key, seq, at: packed in groups by a hash of the key, longest first."""

    def pack(table: pa.Table) -> pa.Table:
        keys, sizes, group = table.column("key").to_pylist(), table.column("size").to_numpy(), table.column("group")[0].as_py()
        order = np.array(sorted(range(len(keys)), key=lambda i: (-sizes[i], keys[i])))
        seq, at = sum_of_squares(sizes[order], length)
        return pa.table({"key": pa.array([keys[i] for i in order], pa.string()), "seq": pa.array((level << 58) + (group << 28) + seq, pa.int64()), "at": pa.array(at, pa.int64())})

    dealt = items.withColumn("group", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(pack, "key string, seq long, at long")


def pack(found: DataFrame, length: int = LENGTH, group: int = GROUP, fan_in: int = FAN_IN) -> DataFrame:
    """The rows of found (PIECES) with sequence_id and offset."""
    rows = found.withColumn("key", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string"), F.monotonically_increasing_id().cast("string")))
    rows = shared.scratch(rows, "pieces")
    groups = max(1, -(-rows.count() // group))
    placed = shared.scratch(_packed(rows.select("key", F.col("length").alias("size")), 0, groups, length), "placed")
    rows = shared.scratch(rows.join(placed, "key"), "packed")
    level = 0
    while groups > 1:
        level, groups = level + 1, -(-groups // fan_in)
        filled = rows.groupBy("seq").agg(F.sum("length").alias("size")).where(F.col("size") <= length - SMALL_GAP)
        moved = _packed(filled.select(F.col("seq").cast("string").alias("key"), "size"), level, groups, length)
        moved = shared.scratch(moved.select(F.col("key").cast("long").alias("old"), F.col("seq").alias("new"), F.col("at").alias("base")), "moved")
        rows = rows.join(moved, F.col("seq") == F.col("old"), "left").withColumns({"seq": F.coalesce("new", "seq"), "at": F.col("at") + F.coalesce("base", F.lit(0))}).drop("old", "new", "base")
        if groups > 1:
            rows = shared.scratch(rows, "packed")
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), F.col("at").alias("offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(shared.documents(spark, sf_dir), default_tokenizer()))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(pieces(docs, default_tokenizer()))
