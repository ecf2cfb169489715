"""Pages as they arrive: a file stream of stored pages, written once each.

A page that is stored already is left as it is, whatever arrives later; a run that was ended goes on from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.sources.blocks import RAW_PAGE

SCHEMA = "book_id string, " + RAW_PAGE


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


#: Folders of a store.
BUCKETS = 64


def bucket() -> Column:
    """The folder of a book, by a hash of its id: reading a book opens one folder, and a batch writes BUCKETS at most."""
    return F.pmod(F.xxhash64("book_id"), F.lit(BUCKETS)).cast("int")


def store_new(pages: DataFrame, path: str) -> None:
    """Appends pages that aren't in the store; of a page that comes twice in a batch the smaller is kept."""
    spark = pages.sparkSession
    new = pages.groupBy("book_id", "page").agg(F.min(F.struct("width", "height", "blocks")).alias("p")).select("book_id", "page", "p.*")
    try:
        stored = spark.read.schema(SCHEMA).parquet(path).select("book_id", "page")  # no text is read
        new = new.join(stored, ["book_id", "page"], "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.withColumn("bucket", bucket()).write.mode("append").partitionBy("bucket").parquet(path)


def stored_book(spark: SparkSession, path: str, book_id: str) -> DataFrame:
    """The stored pages of a book, from its folder alone."""
    number = spark.range(1).select(F.lit(book_id).alias("book_id")).select(bucket()).first()[0]
    return spark.read.schema(SCHEMA + ", bucket int").parquet(path).where((F.col("bucket") == number) & (F.col("book_id") == book_id)).drop("bucket")


def store_arriving(spark: SparkSession, folder: str, path: str, checkpoint: str) -> StreamingQuery:
    """Stores what has arrived so far, and ends."""
    return arriving(spark, folder).writeStream.foreachBatch(lambda df, _: store_new(df, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
