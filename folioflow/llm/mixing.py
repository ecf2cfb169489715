"""Mixing sources to target weights: which documents to take, and how often, by a hash threshold for each source.

Sizes are summed by source and hash bucket. In each source the buckets below its budget's threshold are taken; the bucket
the budget ends in is split by the next bits of the hash, and only its documents are summed again, until a bucket is one
document or bits run out. Documents are then filtered by comparing their hash with their source's threshold; nothing is
sorted.

A source whose target is k times its size and a bit takes every document k times and the documents below the threshold
once more, so no document is taken more than CAP times.

The hash is that of doc_id, text and source, and of the row's number among those that are equal in these, so that neither
null nor repeated ids, nor copies of one row, share a hash: a threshold takes some of them and leaves the others. Such rows
are numbered by their other columns, and rows that are equal in all by where they lie, which doesn't show in what is taken.

Cases: null text has size 0; null is a source of its own, the last; sources of size 0 have target 0 and take nothing; an
empty table gives an empty result. Equal input gives equal results, however it is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.llm import shared

WEIGHTS = (1, 2, 3)
CAP = 3
#: A bucket is split into 2 ** BITS; LEVELS * BITS bits of the hash can be used.
BITS, LEVELS = 10, 6


def size_of(text: Column) -> Column:
    """Words: runs of characters other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def keys_of(docs: DataFrame) -> tuple[Column, Column]:
    """A hash of a row's doc_id, text and source, and one of the whole row."""
    own = [F.col("doc_id").cast("long"), F.col("text"), F.col("source").cast("string")]
    return F.xxhash64(F.lit("mix"), *own), F.xxhash64(F.lit("row"), *shared.columns(docs))


def hash_of(key: Column, number: Column) -> Column:
    """A hash of BITS * LEVELS bits of a row and its number among equal ones."""
    return F.shiftrightunsigned(F.xxhash64(key, number.cast("long")), 64 - BITS * LEVELS)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, a, b (the row's keys), n (how many rows have the first key), h of every row of docs, written."""
    a, b = keys_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), a.alias("a"), b.alias("b"))
    rows = shared.scratch(rows.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "rows")
    # equal rows of one part are numbered there, and parts one after the other, so no task has all of them
    own = Window.partitionBy("a")
    parts = rows.groupBy("a", "b", "part").agg(F.count("*").alias("k"))
    parts = parts.withColumns({"before": F.sum("k").over(own.orderBy("b", "part")) - F.col("k"), "n": F.sum("k").over(own)}).drop("k")
    rows = rows.join(parts, ["a", "b", "part"]).withColumn("number", F.col("before") + F.row_number().over(Window.partitionBy("a", "b", "part").orderBy("at")) - 1)
    return shared.scratch(rows.select("doc_id", "source", "size", "a", "b", "n", hash_of(F.col("a"), F.col("number")).alias("h")), "sizes")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank: 0, 1, ... by code point, null last. Numbered within ranges of sources, whose row counts alone go to the driver."""
    key = [F.col("source").isNull(), F.col("source")]
    parts = shared.scratch(sources.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "sources")
    before, start = [], 0
    for part, n in sorted(parts.groupBy("part").count().collect()):
        before.append(F.when(F.col("part") == part, F.lit(start)))
        start += n
    within = F.row_number().over(Window.partitionBy("part").orderBy(*key)) - 1
    return parts.withColumn("rank", within + (F.coalesce(*before) if before else F.lit(0))).drop("part")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target. The target is min(cap * size, level * weight) with the level at which targets sum to all sizes.

    The level rises until no further source is above its cap; each step is one sum over the sources.
    """
    rows = ranked(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    rows = shared.scratch(rows, "weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("source_size") * cap
        n, fixed, free = rows.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("source_size") * cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))).first()
        if n == capped or not free:
            break
        level, capped = (total - fixed) / free, n
    return rows.select("source", "source_size", F.least(F.col("source_size") * F.lit(float(cap)), F.col("weight") * F.lit(float(level))).alias("target"))


def thresholds(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with times and threshold: each document of the source is taken `times` times, and once more if its h is below the threshold."""
    plan = plan.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("budget", F.col("target") - F.col("times") * F.col("source_size"))
    # edge: the boundary bucket's number among those of its level; low: what the buckets below it sum to
    edge = plan.select("source", "budget", F.lit(0).cast("long").alias("edge"), F.lit(0).cast("long").alias("low"))
    done = None
    for k in range(1, LEVELS + 1):
        bucket = F.shiftrightunsigned("h", BITS * (LEVELS - k))
        own = edge.select(F.col("source").alias("s"), "edge", "budget", "low")
        inside = docs.join(own, docs["source"].eqNullSafe(own["s"]) & (F.shiftrightunsigned(docs["h"], BITS * (LEVELS - k + 1)) == own["edge"]))
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.first("budget").alias("budget"), F.first("low").alias("low"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("upto", F.col("low") + upto)
        # the first bucket that ends above the budget; none: all are taken
        hit = sums.where("upto > budget").groupBy("source").agg(F.min(F.struct("bucket", "upto", "size", "n", "budget")).alias("b"))
        hit = shared.scratch(hit.select("source", F.col("b.bucket").alias("edge"), (F.col("b.upto") - F.col("b.size")).alias("low"), F.col("b.upto").alias("upto"), F.col("b.n").alias("n"), F.col("b.budget").alias("budget")), "edges")
        # a single document, or the last level: the bucket is taken if the sum is nearer to the budget with it
        last = F.lit(k == LEVELS) | (F.col("n") == 1)
        near = (F.col("upto") - F.col("budget") <= F.col("budget") - F.col("low")).cast("long")
        ended = hit.where(last).select("source", F.shiftleft(F.col("edge") + near, BITS * (LEVELS - k)).alias("threshold"))
        done = ended if done is None else done.unionByName(ended)
        edge = hit.where(~last).select("source", "budget", "edge", "low")
        if edge.isEmpty():
            break
    found = done.withColumnRenamed("source", "s")
    # a source without a boundary has a budget that its documents don't exceed
    return plan.join(found, plan["source"].eqNullSafe(found["s"]), "left").select("source", "source_size", "target", "times", F.coalesce("threshold", F.when(F.col("budget") > 0, F.shiftleft(F.lit(1).cast("long"), BITS * LEVELS)).otherwise(0)).alias("threshold"))


def planned(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """s, source_size, target, times, threshold for each source of rows (source, size, h)."""
    plan = thresholds(rows, targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    return shared.scratch(plan.withColumnRenamed("source", "s"), "thresholds")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of docs."""
    rows = sized(docs)
    plan = planned(rows, weights, cap)
    # small plans are broadcast by their file size; with others Spark splits the rows of a large source over tasks
    out = rows.join(plan, rows["source"].eqNullSafe(plan["s"])).withColumn("copies", F.col("times") + (F.col("h") < F.col("threshold")).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "h")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(shared.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


#: Copies of a row that are put out from one array.
COPIES = 4096


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, by its own source and size; rows of size 0 don't count against a budget and stay once.

    Rows that share their doc_id, text and source with no other are decided where they are read. Of the others, rows that are equal
    in all columns are one, put out as often as they are taken together.
    """
    rows = sized(docs)
    plan = planned(rows)
    a, b, own, n = (shared.private(docs, name) for name in ("a", "b", "copies", "n"))
    taken = lambda size, h, times="times", threshold="threshold": F.when(size == 0, 1).otherwise(shared.named(times) + (h < shared.named(threshold)).cast("long"))
    again = rows.where("n > 1").join(plan, rows["source"].eqNullSafe(plan["s"]))
    again = shared.scratch(again.groupBy(F.col("a").alias(a), F.col("b").alias(b)).agg(F.sum(taken(F.col("size"), F.col("h"))).alias(own)), "equal")

    first, second = keys_of(docs)
    found = docs.withColumns({a: first, b: second})
    some = not again.isEmpty()
    one = found.join(again, [a, b], "left_anti") if some else found
    whose, times, threshold = (shared.private(docs, name) for name in ("s", "times", "threshold"))
    one = one.join(plan.select(F.col("s").alias(whose), F.col("times").alias(times), F.col("threshold").alias(threshold)), shared.named("source").cast("string").eqNullSafe(shared.named(whose)))
    one = one.select(*shared.columns(docs), taken(size_of(shared.named("text")), hash_of(shared.named(a), F.lit(0)), times, threshold).alias(own))
    if some:
        row = shared.private(docs, "row")
        each = found.join(again.drop(own), [a, b], "left_semi").groupBy(shared.named(a), shared.named(b)).agg(F.first(F.struct(*shared.columns(docs))).alias(row))
        one = one.unionByName(each.join(again, [a, b]).select(*[shared.named(row).getField(c).alias(c) for c in docs.columns], own))
    one = one.where(shared.named(own) > 0).withColumn(n, F.explode(F.sequence(F.lit(0), (shared.named(own) - 1).cast("long"), F.lit(COPIES).cast("long"))))
    return one.withColumn(n, F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), shared.named(own) - shared.named(n)).cast("int")))).select(shared.columns(docs))
