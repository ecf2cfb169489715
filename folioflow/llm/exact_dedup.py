"""Exact dedup over a persistent digest index.

The index is a table (digest, keep_id), bucketed and sorted by digest. New data is reduced to one row per digest,
deduplicated against the index by a sort-merge anti-join on the digest, and what is new is appended. Within a batch the
largest doc_id keeps a text; between batches the one admitted first.

Cases: null text counts as empty; a null doc_id never wins over another; rows that repeat both doc_id and text are one
document: all its rows are marked as kept, and the pipeline's stage leaves one of them, the same in every run; an empty
table gives an empty result; columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import shared

#: Of the files below an index; another one is not read.
VERSION = 1
FORMAT = "version int, generation int, buckets int"
#: Digests in a bucket of a new index, in the mean.
BUCKET = 4_000_000


def digest(text: Column) -> Column:
    """SHA-256 of the text's UTF-8 after lower-casing A-Z only; null as empty."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(low, 256))


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"))


def _bucketed(spark: SparkSession, path: str, columns: str, buckets: int) -> str:
    """The name of a table at path, bucketed and sorted by digest; what is there already is kept."""
    name = _name(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.catalog.refreshTable(name)
    return name


def _name(path: str) -> str:
    return "digests_" + hashlib.sha256(path.encode()).hexdigest()[:16]


class DigestIndex:
    """The index at a path; opening an existing path goes on with it.

    The files are read by their buckets, so the number of buckets is kept with them: format/ has a row for each
    generation, and the last one's data-<generation>/ holds the digests. Opening with another number is an error;
    `compact` writes a new generation, with one sorted file a bucket, in any number of buckets. A new index has as many
    as there are shuffle partitions unless told otherwise, so that a batch that was grouped by digest meets the buckets,
    and is written into them, without another shuffle.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        found = self._format()
        if found is None:
            self._start(0, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
            found = self._format()
        if found["version"] != VERSION:
            raise ValueError(f"the index at {path} has format {found['version']}, not {VERSION}")
        if buckets not in (None, found["buckets"]):
            raise ValueError(f"the index at {path} has {found['buckets']} buckets, not {buckets}; compact() can change that")
        self._open(found["generation"], found["buckets"])

    def _format(self):
        """The last generation's row; None of a new index."""
        try:
            rows = self.spark.read.schema(FORMAT).json(f"{self.path}/format")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        return rows.agg(F.max(F.struct("generation", "buckets", "version"))).first()[0]

    def _start(self, generation: int, buckets: int) -> None:
        values = zip((VERSION, generation, buckets), ("version", "generation", "buckets"), strict=True)
        self.spark.range(0, 1, 1, 1).select(*[F.lit(v).alias(name) for v, name in values]).write.mode("append").json(f"{self.path}/format")

    def _open(self, generation: int, buckets: int) -> None:
        self.generation, self.buckets = generation, buckets
        self.name = _bucketed(self.spark, f"{self.path}/data-{generation}", "digest BINARY, keep_id BIGINT", buckets)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _by_bucket(self, rows: DataFrame, buckets: int) -> DataFrame:
        return rows if buckets == int(self.spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(buckets, "digest")

    def admit(self, rows: DataFrame) -> None:
        """Appends the digests of rows (doc_id, digest) that the index doesn't have; the largest doc_id is theirs.

        Equal digests are one before they are shuffled; the batch is bucketed as the index is, so the anti-join reads
        both in order. A batch that is admitted again changes nothing.
        """
        path = shared.scratch_path(self.spark, "batch")
        name = _bucketed(self.spark, path, "digest BINARY, last BIGINT", self.buckets)
        self._by_bucket(rows.groupBy("digest").agg(F.max("doc_id").alias("last")), self.buckets).write.insertInto(name)
        self.spark.catalog.refreshTable(name)
        self.spark.table(name).hint("merge").join(self.table(), "digest", "left_anti").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        self.spark.sql(f"DROP TABLE {name}")
        shared.delete(self.spark, path)

    def compact(self, buckets: int | None = None) -> None:
        """Writes the index anew, one sorted file a bucket; readers of the old generation are not disturbed until it is deleted."""
        old, name, buckets = f"{self.path}/data-{self.generation}", self.name, buckets or self.buckets
        new = _bucketed(self.spark, f"{self.path}/data-{self.generation + 1}", "digest BINARY, keep_id BIGINT", buckets)
        self.table().repartition(buckets, "digest").write.insertInto(new)
        self._start(self.generation + 1, buckets)
        self._open(self.generation + 1, buckets)
        self.spark.sql(f"DROP TABLE {name}")
        shared.delete(self.spark, old)


def _batches(found: DataFrame, low: int | None, high: int | None, n: int) -> list[DataFrame]:
    """found by falling ranges of doc_id, null last."""
    if n == 1 or low is None:
        return [found]
    edges = [low + (high + 1 - low) * k // n for k in range(n)]
    inside = [F.col("doc_id") >= edges[-1], *[F.col("doc_id").between(a, b - 1) for a, b in zip(edges[-2::-1], edges[:0:-1], strict=True)]]
    inside[-1] |= F.col("doc_id").isNull()
    return [found.where(x) for x in inside]


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 1) -> DataFrame:
    """doc_id, keep_id, group_size (in docs), kept, digest of every row of docs. The index is a new one in the shared folder
    unless given. With several batches, later ones have smaller doc_ids, so that the largest still keeps a text.

    Both sides of the last join are shuffled as they are, so Spark splits the rows of a text that very many share.
    """
    spark = docs.sparkSession
    found = shared.scratch(digests(docs), "digests")
    rows, low, high = found.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    own = index is None
    if own:
        path = shared.scratch_path(spark, "digest-index")
        index = DigestIndex(spark, path, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET)))
    for batch in _batches(found, low, high, batches):
        index.admit(batch)
    answer = shared.scratch(found.groupBy("digest").agg(F.count("*").alias("group_size")).hint("merge").join(index.table(), "digest"), "answers")
    if own:
        spark.sql(f"DROP TABLE {index.name}")
    return found.hint("merge").join(answer, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper half of the ids goes into a new index, the lower half into that."""
    out = exact_dedup(shared.documents(spark, sf_dir), batches=2)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that stay, with the columns of docs. A row is known by doc_id and digest, as ids may be null or repeat."""
    kept = shared.scratch(exact_dedup(docs).where("kept").select("doc_id", "digest"), "kept")
    mark = shared.private(docs, "digest")
    own = docs.withColumn(mark, digest(F.col("text")))
    rows = own.hint("merge").join(kept, own["doc_id"].eqNullSafe(kept["doc_id"]) & (own[mark] == kept["digest"]), "left_semi")
    if kept.count() > kept.select("digest").distinct().count():  # rows that repeat both: one of each stays
        rows = shared.one_of_each(rows, "doc_id", mark)
    return rows.select(shared.columns(docs))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
