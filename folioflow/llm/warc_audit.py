"""Merkle fixity audit of WARC replicas.

A store is a table of WARC files' bytes: pages are dealt to shards by the leading bits of a key, the hash of page_id, a
shard's records are in the order of that key, and its bytes are kept in segments of whole records. An audit reads the
bytes of two stores, hashes each record, and builds a tree for each shard: records of one range of keys, which are one
range of offsets, make a node, and 16 neighbouring nodes make one above, up to the shard's root. Roots are compared, and only
below nodes that differ are the children of both compared, level by level. Records in the lowest nodes that differ are then
aligned by page_id, url and hash.

As nodes are ranges of keys, and hashes hold lengths but no offsets, a record that one replica lacks changes its own branch
only. A lowest node's hash is over sums of its records' hashes, made before the shuffle, so a page_id that repeats very
often costs no task more than a row; a node above has 16 children.

Cases: null url or html are empty; rows without page_id are known by their url and have a key of it; records that repeat are
records of their own; bytes that are no record are passed over up to the next one's beginning and reported as unreadable;
empty tables have no roots and nothing to report; columns besides page_id, url and html are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm import shared

#: Bytes of a shard and of a segment, in the mean; bits of a key; children of a node as bits; records of a lowest node, in the mean.
SHARD, SEGMENT, KEY, CHILDREN, LOWEST = 64 << 20, 1 << 20, 60, 4, 4
#: Segments that are read at once.
AT_ONCE = 8
END = "\r\n"
_ID = re.compile(r"<urn:page:(-?\d+)>")
STORE = "shard int, segment long, offset long, data binary"
RECORDS = "shard int, offset long, length long, page_id long, url string, hash binary, readable boolean, before_id long, before_url string"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC resource record as bytes; line ends in a url are escaped."""
    body, text = F.coalesce(html, F.lit("")), lambda c: F.coalesce(c.cast("string"), F.lit(""))
    uri = F.replace(F.replace(text(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(f"WARC/1.0{END}WARC-Type: resource{END}WARC-Record-ID: <urn:page:"), text(page_id), F.lit(f">{END}WARC-Target-URI: "), uri,
        F.lit(f"{END}Content-Type: text/html{END}Content-Length: "), F.octet_length(body).cast("string"), F.lit(END + END),
    )
    return F.concat(head, body, F.lit(END + END)).cast("binary")


def parse(archive: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes]]:
    """Offset, length, header and body of each record of a WARC file's bytes; header is None of a stretch that is no record."""
    at, lost = 0, None
    while at < len(archive):
        found = _record_at(archive, at)
        if found is None:
            lost = at if lost is None else lost
            at = archive.find(b"WARC/1.0\r\n", at + 1)
            at = len(archive) if at < 0 else at
            continue
        if lost is not None:
            yield lost, at - lost, None, archive[lost:at]
            lost = None
        header, start, size = found
        yield at, start + size + 4 - at, header, archive[start : start + size]
        at = start + size + 4
    if lost is not None:
        yield lost, len(archive) - lost, None, archive[lost:]


def _record_at(archive: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    end = archive.find(b"\r\n\r\n", at)
    if end < 0 or not archive.startswith(b"WARC/1.0\r\n", at):
        return None
    try:
        header = dict(line.split(": ", 1) for line in archive[at:end].decode().split(END)[1:])
        start, size = end + 4, int(header["Content-Length"])
    except (ValueError, KeyError):
        return None
    if size < 0 or archive[start + size : start + size + 4] != b"\r\n\r\n":
        return None
    return header, start, size


def key_of(page_id: Column, url: Column) -> Column:
    """KEY bits: the hash of page_id, or of the url where there is none."""
    name = F.coalesce(page_id.cast("string"), F.concat(F.lit("url "), F.coalesce(url, F.lit(""))))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, KEY // 4), 16, 10).cast("long")


def shard_bits(pages: DataFrame, shard_bytes: int = SHARD) -> int:
    """The number of leading bits of the key by which pages are dealt to shards."""
    size = pages.agg(F.sum(F.octet_length(F.coalesce("html", F.lit(""))))).first()[0] or 0
    return max(0, math.ceil(math.log2(size / shard_bytes))) if size else 0


def stored(pages: DataFrame, bits: int, segment: int = SEGMENT) -> DataFrame:
    """STORE of pages: the bytes of each shard's WARC file, cut between records into segments. One shuffle, by shard."""
    id_, url, html = (F.col(c) for c in ("page_id", "url", "html"))
    rows = pages.select(key_of(id_, url).alias("key"), id_.cast("long").alias("page_id"), record(id_, url, html).alias("record"))
    rows = rows.withColumn("shard", F.shiftright("key", KEY - bits).cast("int"))
    order = Window.partitionBy("shard").orderBy("key", "page_id", F.sha2("record", 256)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum(F.length("record").cast("long")).over(order), F.lit(0).cast("long")))

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("offset", "ascending")])
        data = b"".join(table.column("record").to_pylist())
        return pa.table([table.column("shard")[:1], table.column("segment")[:1], table.column("offset")[:1], pa.array([data], pa.binary())], [x.split()[0] for x in STORE.split(", ")])

    rows = rows.select("shard", F.floor(F.col("offset") / segment).alias("segment"), "offset", "record")
    return rows.groupBy("shard", "segment").applyInArrow(join, STORE)


def stored_twice(pages: DataFrame, other: Column, times: Column, bits: int, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """STORE of pages, and of a replica in which a page has another html (where that isn't null) and is there so many times.

    Both are cut from the same records, which are shuffled once; segments of both hold the same pages. All bytes of both are written.
    """
    id_, url, html = (F.col(c) for c in ("page_id", "url", "html"))
    rows = pages.select(key_of(id_, url).alias("key"), id_.cast("long").alias("page_id"), record(id_, url, html).alias("record"), F.when(other.isNotNull(), record(id_, url, other)).alias("other"), times.cast("int").alias("times"))
    rows = rows.withColumn("shard", F.shiftright("key", KEY - bits).cast("int"))
    order = Window.partitionBy("shard").orderBy("key", "page_id", F.sha2("record", 256)).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda size: F.coalesce(F.sum(size.cast("long")).over(order), F.lit(0).cast("long"))
    rows = rows.withColumns({"offset": before(F.length("record")), "second": before(F.col("times") * F.coalesce(F.length("other"), F.length("record")))})

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by([("offset", "ascending")])
        own = table.column("record").to_pylist()
        copies = [(o if o is not None else r) * n for r, o, n in zip(own, table.column("other").to_pylist(), table.column("times").to_pylist(), strict=True)]
        first = lambda name: [table.column(name)[0].as_py()] * 2
        columns = [pa.array(first("shard"), pa.int32()), pa.array(first("segment"), pa.int64()), pa.array([table.column(c)[0].as_py() for c in ("offset", "second")], pa.int64()), pa.array([b"".join(own), b"".join(copies)], pa.binary())]
        return pa.table([*columns, pa.array(["primary", "replica"])], [*(x.split()[0] for x in STORE.split(", ")), "replica"])

    rows = rows.select("shard", F.floor(F.col("offset") / segment).alias("segment"), "offset", "second", "record", "other", "times")
    path = shared.scratch_path(pages.sparkSession, "warc")
    rows.groupBy("shard", "segment").applyInArrow(join, STORE + ", replica string").write.partitionBy("replica").parquet(path, compression="zstd")
    return tuple(pages.sparkSession.read.schema(STORE).parquet(f"{path}/replica={name}") for name in ("primary", "replica"))


def records(store: DataFrame) -> DataFrame:
    """RECORDS of a store: what its bytes hold. An unreadable stretch is placed by the record before it, in before_id and before_url."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.int64(), pa.string())
        for batch in batches:
            for shard, base, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                out, last = [], (None, None)
                for at, length, header, _ in parse(data):
                    if header is not None:
                        found = _ID.fullmatch(header.get("WARC-Record-ID", ""))
                        last = (int(found[1]) if found else None, header.get("WARC-Target-URI", ""))
                    own = last if header is not None else (None, None)
                    out.append((shard, base + at, length, *own, hashlib.sha256(data[at : at + length]).digest(), header is not None, *last))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    return store.select("shard", "offset", "data").mapInArrow(read, RECORDS)


WORDS = [f"w{k}" for k in range(8)]


def leaves(store: DataFrame, replica: str) -> DataFrame:
    """replica, shard, key, page_id, url, readable, low, high, hash, and the hash's eight words."""
    rows = records(store).withColumns({"replica": F.lit(replica), "key": key_of(F.col("before_id"), F.col("before_url")), "high": F.col("offset") + F.col("length")})
    words = [F.conv(F.substring(F.hex("hash"), 8 * k + 1, 8), 16, 10).cast("long").alias(w) for k, w in enumerate(WORDS)]
    return rows.select("replica", "shard", "key", "page_id", "url", "readable", F.col("offset").alias("low"), "high", "hash", *words)


def trees(found: DataFrame, bits: int, depth: int) -> list[DataFrame]:
    """The levels of all trees, from the lowest nodes to the roots, which are the shards: replica, node, low, high (offsets), hash."""
    node = F.shiftright("key", KEY - bits - CHILDREN * depth).alias("node")
    text = F.concat_ws("|", *[F.sum(w).cast("string") for w in WORDS], F.count("*").cast("string"), F.sum(F.col("high") - F.col("low")).cast("string"))
    lowest = found.groupBy("replica", node).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sha2(text.cast("binary"), 256).alias("hash"))
    levels = [shared.scratch(lowest, "nodes")]
    for _ in range(depth):
        above = levels[-1].groupBy("replica", F.shiftright("node", CHILDREN).alias("node")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("below"))
        text = F.array_join(F.transform("below", lambda x: F.concat(x["node"].cast("string"), F.lit("="), x["hash"])), "|")
        levels.append(shared.scratch(above.select("replica", "node", "low", "high", F.sha2(text.cast("binary"), 256).alias("hash")), "nodes"))
    return levels


def compare(nodes: DataFrame) -> DataFrame:
    """node of one level at which the two replicas differ."""
    first, second = (F.max(F.when(own, F.col("hash"))) for own in (F.col("replica") == "primary", F.col("replica") != "primary"))
    both = nodes.groupBy("node").agg(first.alias("first"), second.alias("second"))
    return both.where(~F.col("first").eqNullSafe(F.col("second"))).select("node")


def aligned(found: DataFrame) -> DataFrame:
    """shard, page_id, low, high, status from the records of both replicas in nodes that differ.

    Records of equal page_id, url and hash cancel out, as often as both sides have them. Of what is left, records of one
    page_id and url are paired in their hashes' order as changed; those without a partner are missing or extra.
    """
    name = ["shard", "page_id", "url"]
    torn = found.where(~F.col("readable")).groupBy("shard", "hash", "low", "high").agg(F.count("*").alias("n")).where("n = 1")
    torn = torn.select("shard", F.lit(None).cast("long").alias("page_id"), "low", "high", F.lit("unreadable").alias("status"))
    same = Window.partitionBy("replica", *name, "hash").orderBy("low")
    lone = found.where("readable").withColumn("nth", F.row_number().over(same)).groupBy(*name, "hash", "nth")
    lone = lone.agg(F.count("*").alias("n"), F.max("replica").alias("replica"), F.max("low").alias("low"), F.max("high").alias("high")).where("n = 1")
    lone = lone.withColumn("nth", F.row_number().over(Window.partitionBy("replica", *name).orderBy("hash", "nth")))
    first, second = (F.max(F.when(own, F.struct("low", "high"))) for own in (F.col("replica") == "primary", F.col("replica") != "primary"))
    both = lone.groupBy(*name, "nth").agg(first.alias("first"), second.alias("second"))
    status = F.when(F.col("first").isNull(), "extra").when(F.col("second").isNull(), "missing").otherwise("changed")
    return both.withColumn("at", F.coalesce("first", "second")).select("shard", "page_id", "at.low", "at.high", status.alias("status")).unionByName(torn)


@contextmanager
def few_rows_at_once(spark: SparkSession, n: int):
    """Jobs inside read and send n rows at once, as a row of a store is large."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(name) for name in names]
    try:
        for name in names:
            spark.conf.set(name, n)
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def audit(primary: DataFrame, replica: DataFrame, bits: int) -> DataFrame:
    """shard, page_id, low, high, status of each record where the replica's store differs from the primary's: its range of
    offsets in the primary's WARC file, or in the replica's if the primary lacks it. bits: those of the stores' shards."""
    with few_rows_at_once(primary.sparkSession, AT_ONCE):
        found = shared.scratch(leaves(primary, "primary").unionByName(leaves(replica, "replica")), "leaves")
    n = found.count() / 2 / 2**bits
    depth = min((KEY - bits) // CHILDREN, max(1, math.ceil(math.log2(max(1.0, n / LOWEST)) / CHILDREN)))
    levels = trees(found, bits, depth)
    differ = shared.scratch(compare(levels[-1]), "differ")
    for below in reversed(levels[:-1]):
        inside = below.join(differ.withColumnRenamed("node", "above"), F.shiftright("node", CHILDREN) == F.col("above"), "left_semi")
        differ = shared.scratch(compare(inside), "differ")
    return aligned(found.withColumn("node", F.shiftright("key", KEY - bits - CHILDREN * depth)).join(differ, "node", "left_semi"))


def damage() -> tuple[Column, Column]:
    """The html (null: the same) and the times of a page in a replica to audit: one in 97 has its first character overwritten, one
    in 211 is lost, one in 307 is there twice."""
    hit = (F.col("page_id") % 97 == 13) & (F.substring("html", 1, 1) != "#")
    times = F.when(F.col("page_id") % 211 == 5, 0).when(F.col("page_id") % 307 == 7, 2).otherwise(1)
    return F.when(hit, F.concat(F.lit("#"), F.expr("substring(html, 2)"))), times


def damaged(pages: DataFrame) -> DataFrame:
    """pages as the replica of `damage` has them."""
    other, times = damage()
    rows = pages.withColumn("times", times).withColumn("html", F.coalesce(other, F.col("html"))).where("times > 0")
    return rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "k")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records in which the stored replica of a damaged copy of pages differs from the stored pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    bits = shard_bits(pages)
    primary, replica = stored_twice(pages, *damage(), bits)
    return audit(primary, replica, bits).select("shard", "page_id", "low", "high", (F.col("high") - F.col("low")).alias("record_bytes"), "status")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, CAST('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 15) AS BIGINT) AS k FROM pages),
b AS (SELECT CAST(greatest(0, ceil(log2(sum(strlen(html)) / 67108864.0))) AS INT) AS bits FROM p),
m AS (SELECT *, html[1] <> '#' AND html <> '' AND page_id % 97 = 13 AS hit, page_id % 211 = 5 AS lost, page_id % 307 = 7 AS twice FROM p),
r AS (SELECT 'primary' AS side, 1 AS nth, page_id, k, url, html, lost, hit FROM m
  UNION ALL SELECT 'replica', unnest(CASE WHEN twice THEN [1, 2] ELSE [1] END), page_id, k, url, CASE WHEN hit THEN '#' || html[2:] ELSE html END, lost, hit FROM m WHERE NOT lost),
n AS (SELECT *, CAST(k >> (60 - bits) AS INT) AS shard, CAST(strlen('WARC/1.0..WARC-Type: resource..WARC-Record-ID: <urn:page:' || page_id || '>..WARC-Target-URI: ' || url
  || '..Content-Type: text/html..Content-Length: ' || strlen(html) || '....' || html || '....') AS BIGINT) AS record_bytes FROM r, b),
o AS (SELECT *, CAST(sum(record_bytes) OVER (PARTITION BY side, shard ORDER BY k, page_id, nth) AS BIGINT) AS high FROM n)
SELECT shard, page_id, high - record_bytes AS low, high, record_bytes, CASE WHEN side = 'replica' THEN 'extra' WHEN lost THEN 'missing' ELSE 'changed' END AS status
FROM o WHERE (side = 'primary' AND (lost OR hit)) OR (side = 'replica' AND nth = 2)
"""
