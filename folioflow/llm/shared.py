"""What the corpus operators share: scratch tables in the shared folder, private column names, and Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset (tests), a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = tempfile.mkdtemp(prefix="folioflow-")
    spark.sparkContext.setCheckpointDir(found)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Scratch paths that are there, with the name of the table at each, if any.
_MADE: dict[str, str | None] = {}


def scratch_path(spark: SparkSession, name: str, table: str | None = None) -> str:
    """A new path in the shared folder; it is deleted when the driver's Python ends, or by `cleared`."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_delete_all, spark)
    _MADE[path] = table
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _delete_all(spark: SparkSession) -> None:
    for path in list(_MADE):
        del _MADE[path]
        try:
            if spark._jsc is not None:
                delete(spark, path)
        except Exception:  # the JVM may have ended before; nothing depends on it
            pass


@contextmanager
def cleared(spark: SparkSession):
    """Deletes the scratch tables that are made inside, at the end; what is returned must have been written elsewhere."""
    before = set(_MADE)
    try:
        yield
    finally:
        for path in [p for p in _MADE if p not in before]:
            if table := _MADE.pop(path):
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            delete(spark, path)
        spark._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files and broadcasts of what is gone


def scratch(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: later steps start from the files, whatever executors are lost."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """As scratch, dealt by key into as many buckets as there are shuffle partitions: later groups by key need no shuffle of it."""
    spark = df.sparkSession
    table = f"scratch_{uuid.uuid4().hex}"
    path = scratch_path(spark, name, table)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


class Numbers(dict):
    """Numbers new keys as they are met: map(numbers.__getitem__, keys)."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


def private(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(name: str) -> Column:
    """The column of a name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [named(c) for c in df.columns]


def one_of_each(df: DataFrame, *keys: str) -> DataFrame:
    """One row of each combination of keys: the one of the smallest hash over all columns, so reruns agree."""
    row, rank = private(df, "row"), F.xxhash64(*columns(df))
    found = df.groupBy(*map(named, keys)).agg(F.min_by(F.struct(*columns(df)), rank).alias(row))
    return found.select(*[named(row).getField(c).alias(c) for c in df.columns])


#: Rows and bytes that a function sees at once, a single row excepted; what it builds for them stays small beside the batch.
ROWS, BYTES = 1000, 16 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            part = batch.slice(start, ROWS)
            while part.num_rows > 1 and part.nbytes > BYTES:
                part = part.slice(0, part.num_rows // 2)
            start += part.num_rows
            yield part


def map_arrow(df: DataFrame, schema, f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """mapInArrow for a function of one batch of ROWS rows and about BYTES bytes at most, and one row at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return map(f, slices(batches))

    return df.mapInArrow(run, schema)


def id_and_text(df: DataFrame) -> DataFrame:
    """doc_id (long, null stays) and text (null becomes empty); other columns, whatever their names, are left out."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def raw(column: pa.Array) -> list[bytes]:
    """The strings of a column as UTF-8; null as None."""
    return column.cast(pa.large_binary()).to_pylist()


def parallel(df: DataFrame, size: int, bytes_each: int) -> int:
    """Tasks for a shuffle of size bytes: the session's number, or more where a task would have above bytes_each."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_each))
