"""Margins of arriving pages: in any order, and after a restart, what the whole table gives."""

import random

from pyspark.sql import functions as F

from folioflow.operators import layout as L
from folioflow.sources import blocks as B
from folioflow.streaming import arrivals, margins


def test_margins_of_arriving_pages(spark, tmp_path):
    line = lambda book, p, k, t, y: (book, p, 1000, 1000, k, f"l{k}", t, 100, y, 800, y + 20, 1.0, k, "line")
    rows = [r for book, n in (("a", 25), ("b", 9)) for p in range(1, n + 1) if p != 7 for r in (line(book, p, 0, f"머리글 {p}" if p % 4 else f"장 {p // 4}", 20), line(book, p, 1, "본문이다.", 400), line(book, p, 2, f"{'abcdefghi'[p % 9]}장 {p + 3}", 960 if p < 20 else 940))]
    blocks = spark.createDataFrame(rows, B.BLOCKS)
    pages = B.nest_blocks(blocks).collect() + [spark.createDataFrame([("a", 7, 1000, 1000, [])], arrivals.SCHEMA).first()]
    pages += pages[3:9]  # some come again
    random.Random(3).shuffle(pages)
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def come(part):
        spark.createDataFrame(part, arrivals.SCHEMA).coalesce(1).write.mode("append").json(folder)

    def run():
        found = margins.arriving(arrivals.arriving(spark, folder))
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    for k in range(3):
        come(pages[k::3])
        run()  # each run goes on from the checkpoint of the last
    found = sorted(map(tuple, spark.read.parquet(out).collect()))
    wanted = sorted(map(tuple, L.margins(blocks).collect()))
    assert found == wanted and len(found) > 30


def test_candidates_keep_a_row_of_each_page(spark):
    pages = spark.createDataFrame([("a", 1, 10, 10, []), ("a", 2, 10, 10, None)], arrivals.SCHEMA)
    assert margins.candidates(pages).where(F.col("key").isNull()).count() == 2
