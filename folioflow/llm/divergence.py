"""Source divergence audit: how a source's use of words differs from the other sources of its language, and by which words.

Texts are read once: each task writes what it counted of its own documents, where they are. Count-min sketches of document
frequencies by (lang, term) are added up from that; cells stop at the least frequency that is asked for. A sketch never
underestimates, so a term with a smaller cell can't be kept, and is dropped before any term is shuffled. What is left is
counted exactly, with exact document frequencies.

Divergences of pairs of sources are sums over all kept terms of the language. Terms that neither source has give the same
each; terms that one has are summed by their count (a count's share is the same for all terms); terms that both have come
from a join of the counts on (lang, term), where the smaller of two sources meets the larger once and both directions are
summed at once, before the shuffle.

Cases: null text, lang and source count as empty; documents are rows, so a repeated row is another document; a language that
keeps no term has pairs of value 0 and no terms; a lang with one source has no pairs; an empty table gives an empty result;
columns besides text, lang and source are not looked at. All arithmetic is on integers: shares in units of 1e-9.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm import shared

#: Documents of its language a term must be in; ranks of terms that are put out; shares are in units of 1 / UNIT.
LEAST, RANKS, UNIT = 3, 200, 1_000_000_000
#: The sketch: rows, and the binary logarithm of its cells in a row, which follows the number of documents between these bounds.
#: The largest sketch is DEPTH * 2 ** MOST cells: 64 MB in a task, and 8 MB of bits that are broadcast.
DEPTH, FEWEST, MOST = 4, 14, 24
#: Cells that are merged as one row, and (document, term) that a task gathers before it puts them out.
CHUNK, GATHERED = 1 << 14, 2_000_000
TALLIES = "lang string, words binary, sources array<string>, at array<binary>, n array<binary>, documents array<binary>"

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: Bytes of terms: A-Z in lower case, a-z and all above ASCII as they are; others part terms.
_TERMS = bytes(b + 32 if chr(b) in string.ascii_uppercase else b if chr(b) in string.ascii_lowercase or b > 127 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def cells(lang: str, words: list[bytes], width: int) -> np.ndarray:
    """The cell of each of a language's terms in each row of the sketch."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(xxhash.xxh64_intdigest(lang.encode()))), np.uint64, len(words))
    return np.stack([(((h * odd) ^ (h >> np.uint64(29))) * odd >> np.uint64(64 - width)).astype(np.int64) for odd in _ODD])


class Sketch:
    """Count-min sketch of document frequencies whose cells stop at LEAST."""

    def __init__(self, width: int):
        self.width, self.cells = width, np.zeros((DEPTH, 1 << width), np.uint8)

    def add(self, at: np.ndarray, documents: np.ndarray) -> None:
        for row, own in zip(at, self.cells, strict=True):
            sums = np.zeros(len(own), np.int32)
            np.add.at(sums, row, np.minimum(documents, LEAST).astype(np.int32))
            np.minimum(LEAST, sums + own, out=sums)
            own[:] = sums

    def chunks(self) -> Iterator[tuple[int, bytes]]:
        flat = self.cells.ravel()
        for k in range(0, len(flat), CHUNK):
            part = flat[k : k + CHUNK]
            if part.any():
                yield k // CHUNK, part.tobytes()


def counted(batches: Iterator[pa.RecordBatch], gathered: int) -> Iterator[tuple[str, list[bytes], dict[str, tuple[np.ndarray, np.ndarray]]]]:
    """A lang, terms of it, and by source the occurrences and documents of each term, from rows (text, lang, source); more of the
    same may come later."""
    number: dict[str, shared.Numbers] = {}
    found: dict[str, dict[str, list[np.ndarray]]] = {}
    n = 0

    def out():
        for lang, own in number.items():
            sums = {}
            for source, rows in found[lang].items():
                at, times = np.concatenate(rows, axis=1)
                sums[source] = np.bincount(at, times, len(own)).astype(np.int64), np.bincount(at, minlength=len(own))
            yield lang, list(own), sums

    for batch in shared.slices(batches):
        for text, lang, source in zip(shared.raw(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = terms(text)
            if words:
                own = number.setdefault(lang, shared.Numbers())
                each = Counter(words)
                at = np.stack([np.fromiter(x, np.int64, len(each)) for x in (map(own.__getitem__, each), each.values())])
                found.setdefault(lang, {}).setdefault(source, []).append(at)
                n += len(each)
        if n > gathered:
            yield from out()
            number, found, n = {}, {}, 0
    yield from out()


def _rows(docs: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("text"), text("lang"), text("source"))


def tallies(docs: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """What each task counted: terms of a language, and for each source which of them it has, how often, and in how many documents."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, sums in counted(batches, gathered):
            lists = [[], [], []]
            for times, documents in sums.values():
                at = np.flatnonzero(times)
                for own, x in zip(lists, (at.astype(np.int32), times[at], documents[at].astype(np.int32)), strict=True):
                    own.append(x.tobytes())
            binaries = [pa.array([x], pa.list_(pa.binary())) for x in lists]
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([b" ".join(words)], pa.binary()), pa.array([list(sums)], pa.list_(pa.string())), *binaries], [x.split()[0] for x in TALLIES.split(", ")])

    return shared.scratch(_rows(docs).mapInArrow(tally, TALLIES), "tallies", "zstd")


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]]]:
    """Each tally's lang, terms, and of each source the terms' places, occurrences and documents."""
    for batch in batches:
        for k in range(batch.num_rows):
            lang, words, sources, *lists = (c[k].as_py() for c in batch.columns)
            own = [[np.frombuffer(x, kind) for x in part] for part, kind in zip(lists, (np.int32, np.int64, np.int32), strict=True)]
            yield lang, words.split(b" "), list(zip(sources, *own, strict=True))


def frequent_cells(found: DataFrame, width: int) -> np.ndarray:
    """The merged sketch of tallies as bits: whether a cell reached LEAST. Chunks of cells are merged where they meet, a row at a time."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Sketch(width)
        for lang, words, sources in _told(batches):
            total = np.zeros(len(words), np.int64)
            for _, at, _, documents in sources:
                total[at] += documents
            own.add(cells(lang, words, width), total)
        for k, part in own.chunks():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.binary())], ["chunk", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= LEAST).tobytes()], pa.binary())], ["chunk", "bits"])

        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(part.as_buffer(), np.uint8)
                if k == at:
                    total = np.minimum(LEAST, total + part)
                    continue
                if at is not None:
                    yield row()
                at, total = k, part.copy()
        if at is not None:
            yield row()

    parts = found.mapInArrow(sketch, "chunk int, cells binary").repartition("chunk").sortWithinPartitions("chunk")
    bits = np.zeros(DEPTH << width >> 3, np.uint8)
    for r in parts.mapInArrow(merge, "chunk int, bits binary").toLocalIterator():  # DEPTH * 2 ** MOST bits at most
        bits[r.chunk * CHUNK >> 3 :][: len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return bits


def counts(docs: DataFrame, width: int | None = None) -> DataFrame:
    """lang, term, source, n, total (the term's in its language), first (one row of each lang and term): kept terms, counted exactly."""
    if width is None:
        width = max(FEWEST, min(MOST, (16 * docs.count()).bit_length() - 1))
    found = tallies(docs)
    bits = docs.sparkSession.sparkContext.broadcast(frequent_cells(found, width))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bits.value
        for lang, words, sources in _told(batches):
            frequent = np.ones(len(words), bool)
            for at in cells(lang, words, width) + (np.arange(DEPTH) << width)[:, None]:
                frequent &= (own[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            names = pa.array(words, pa.binary()).cast(pa.string())
            for source, at, times, documents in sources:
                kept = np.flatnonzero(frequent[at])
                if len(kept):
                    same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(kept), np.int32)))
                    yield pa.RecordBatch.from_arrays([same(lang), same(source), names.take(pa.array(at[kept])), pa.array(times[kept]), pa.array(documents[kept].astype(np.int64))], ["lang", "source", "term", "n", "documents"])

    rows = found.mapInArrow(count, "lang string, source string, term string, n long, documents long").repartition("lang", "term")
    rows = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    whole = Window.partitionBy("lang", "term")
    rows = rows.withColumns({"in_lang": F.sum("documents").over(whole), "total": F.sum("n").over(whole), "first": F.row_number().over(whole.orderBy("source")) == 1})
    return shared.scratch(rows.where(F.col("in_lang") >= LEAST).select("lang", "term", "source", "n", "total", "first"), "terms")


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + kept)), exact; null where no term is kept."""
    wide = lambda x: x.cast("decimal(20,0)")
    part = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(n + 1), wide(F.nullif(total + kept, F.lit(0))))
    return part + 1


def excess(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, size (of its kept occurrences), held (kept terms that it has), terms, lang_size, none (its share of an absent term)."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("held"))
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("terms"), F.sum("n").alias("lang_size"))
    rows = _rows(docs).select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    rows = rows.withColumn("none", share(F.lit(0).cast("long"), F.col("size"), F.col("terms")))
    return shared.scratch(rows, "groups")


def divergence(docs: DataFrame, width: int | None = None, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: each other source of the lang by its divergence, and the terms that stand out most."""
    kept = counts(docs, width)
    every, c = groups(docs, kept), F.col
    entries = kept.join(every, ["lang", "source"]).withColumn("p", share(c("n"), c("size"), c("terms")))

    stands_out = entries.withColumn("q", share(c("total"), c("lang_size"), c("terms"))).where("p > q")
    found = stands_out.select("lang", "source", F.lit("term").alias("part"), c("term").alias("item"), excess(c("p"), c("q")).alias("value"))

    mine = entries.select("lang", "term", c("source").alias("a"), c("p").alias("pa"), c("none").alias("za"))
    theirs = entries.select("lang", "term", c("source").alias("b"), c("p").alias("pb"), c("none").alias("zb"))
    # what a common term adds beyond the sums of each source's own terms
    beyond = lambda p, z, q, y: excess(p, q) - excess(p, y) - excess(z, q)
    both = mine.join(theirs.hint("merge"), ["lang", "term"]).where("a < b")
    both = both.groupBy("lang", "a", "b").agg(F.count("*").alias("common"), F.sum(beyond(c("pa"), c("za"), c("pb"), c("zb"))).alias("ab"), F.sum(beyond(c("pb"), c("zb"), c("pa"), c("za"))).alias("ba"))
    way = lambda x, y, v: F.struct(c(x).alias("source"), c(y).alias("item"), c(v).alias("beyond"))
    both = both.select("lang", "common", F.explode(F.array(way("a", "b", "ab"), way("b", "a", "ba"))).alias("w")).select("lang", "w.source", "w.item", "w.beyond", "common")

    other = every.select("lang", c("source").alias("item"), c("none").alias("y"), c("held").alias("theirs"))
    alike = entries.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("k"))  # terms of one count have one share
    met = alike.join(other, "lang").where("source <> item")
    ahead = met.groupBy("lang", "source", "item").agg(F.sum(c("k") * excess(c("p"), c("y"))).alias("own"))
    behind = met.groupBy("lang", c("item").alias("source"), c("source").alias("item")).agg(F.sum(c("k") * excess(c("y"), c("p"))).alias("others"))
    pairs = every.join(other, "lang").where("source <> item")
    for side in (ahead, behind, both):
        pairs = pairs.join(side, ["lang", "source", "item"], "left")
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    absent = (c("terms") - c("held") - c("theirs") + zero(c("common"))) * excess(c("none"), c("y"))
    value = zero(c("own")) + zero(c("others")) + zero(c("beyond")) + zero(absent)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    found = found.withColumn("rank", F.row_number().over(order)).where(c("rank") <= ranks)
    return found.unionByName(pairs.withColumn("rank", F.row_number().over(order)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(shared.documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, source, k, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kt AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kt USING (lang, term) GROUP BY ALL),
gs AS (SELECT lang, source, coalesce(sum(n), 0) AS size FROM g LEFT JOIN n USING (lang, source) GROUP BY ALL),
ls AS (SELECT lang, count(*) AS v, sum(total) AS size FROM kt GROUP BY lang),
p AS (SELECT g.lang, g.source, kt.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 1)) // (gs.size + ls.v) AS p, 1 + (1000000000::HUGEINT * (kt.total + 1)) // (ls.size + ls.v) AS q
 FROM g JOIN gs USING (lang, source) JOIN ls USING (lang) JOIN kt USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kt.term),
tv AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ps AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pv AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(ps.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN ps ON ps.lang = a.lang AND ps.source = a.source AND ps.item = b.source),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM tv UNION ALL SELECT * FROM pv))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200"""
