"""Whole passes with an outside judge: boundaries, paragraphs, and rules over books.

A judge is a function of a DataFrame of questions (book_id, batch, id, and what it is asked about) to one of answers
(book_id, batch, id, answer: JSON). Only what local rules leave open is asked, and what a cache or the budget rules out isn't.
Questions and answers are written to a store before they are read, so a judge sees each question once; a store that holds
them already is read instead. `calls.judge` makes a judge of a service that is called batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import budget as U
from folioflow.operators import layout as L
from folioflow.operators import review as R
from folioflow.sources import stores

Judge = Callable[[DataFrame], DataFrame]
ITEM = f"ocr_edits {R.EDITS}, spacing_text string, anomalies array<string>, kind string, heading_level int, remove_glosses array<string>, figure_residue boolean"
CHANGE = "action string, text string"


def judged(asked: DataFrame, judge: Judge, store: str | None) -> tuple[DataFrame, DataFrame]:
    """The questions and the judge's answers, each written once."""
    spark, path, new = asked.sparkSession, (lambda name: store and f"{store}/{name}"), asked
    asked = stores.kept(spark, lambda: new, path("asked"))
    return asked, stores.kept(spark, lambda: judge(asked).select("book_id", "batch", "id", "answer"), path("answers"))


def boundaries(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs with left (the text before, where both may be one) and route: join, ask or split."""
    return L.neighbours(paragraphs).withColumn("route", F.when(F.col("left").isNotNull(), L.boundary_route(F.col("left"), F.col("text"))).otherwise("split"))


def joined_boundaries(paragraphs: DataFrame, judge: Judge, excerpt: int = 240, store: str | None = None) -> DataFrame:
    """Paragraphs united where local rules or the judge (answers true, or {"join": true}) say so."""
    return united(decided(paragraphs, judge, excerpt, store))


def decided(paragraphs: DataFrame, judge: Judge, excerpt: int = 240, store: str | None = None) -> DataFrame:
    """Paragraphs with joined (to the one before), and how that was decided: source is local, ai or fallback."""
    rows = boundaries(paragraphs)
    asked = rows.where("route = 'ask'").select("book_id", "ord", T.excerpt(F.col("left"), True, excerpt).alias("left"), T.excerpt(F.col("text"), False, excerpt).alias("right"))
    asked, answers = judged(R.batches(asked, "book_id", ["ord"], R.BOUNDARY).withColumnRenamed("slot", "id").withColumn("text", F.concat("left", "right")), judge, store)
    said = R.answered(asked, answers).join(asked.select("book_id", "batch", "id", "ord"), ["book_id", "batch", "id"])
    yes = (F.col("answer") == "true") | (F.get_json_object("answer", "$.join") == "true")
    said = said.select("book_id", "ord", F.coalesce(yes, F.lit(False)).alias("yes"), "source")
    rows = rows.join(said, ["book_id", "ord"], "left")
    return rows.withColumns({"joined": (F.col("route") == "join") | F.coalesce("yes", F.lit(False)), "source": F.coalesce("source", F.lit("local"))}).drop("yes")


united = L.united


def boundary_audit(rows: DataFrame) -> DataFrame:
    """book_id, ord, source, joined, left, right of the boundaries that were decided: excerpts where a judge was asked."""
    asked = F.col("source") == "ai"
    return rows.where("left is not null").select("book_id", "ord", "source", "joined", F.when(asked, T.excerpt(F.col("left"), True)).alias("left"), F.when(asked, T.excerpt(F.col("text"), False)).alias("right"))


def admitted_batches(asked: DataFrame, limit: float | None, price: float, output_price: float, spacing: bool = True) -> DataFrame:
    """book_id, batch of the batches that a book's budget admits, each at its largest cost."""
    each = asked.groupBy("book_id", "batch").agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("items"), F.sum(F.length("text")).alias("length"))
    most = U.output_ceilings(F.col("items"), F.col("size"), F.col("length"))["enhance_spacing" if spacing else "enhance"]
    each = each.withColumn("worst", ((F.col("size") + U.OVERHEAD) * F.lit(price) + most * F.lit(output_price)) / F.lit(1e6))
    return U.admitted(each, "book_id", ["batch"], limit).where("admitted").select("book_id", "batch")


def apply_item(rows: DataFrame) -> DataFrame:
    """text, kind, heading_level of rows (text, kind, item): edits, then glosses, spacing, kind, and residue last."""
    none = lambda c, t: F.coalesce(F.col(f"item.{c}"), F.array().cast(t))
    rows = rows.withColumn("text", R.apply_edits("text", none("ocr_edits", R.EDITS)))
    rows = rows.withColumn("text", R.apply_glosses(F.col("text"), none("remove_glosses", "array<string>")))
    rows = rows.withColumn("text", R.accept_spacing(F.col("text"), F.col("item.spacing_text")))
    return R.resolved(rows.withColumns({"new_kind": F.col("item.kind"), "heading_level": F.col("item.heading_level"), "figure_residue": F.col("item.figure_residue")})).drop("new_kind", "figure_residue")


def enhanced(paragraphs: DataFrame, judge: Judge, needs: Column, cache: DataFrame, model: str, features: list[str], limit: float | None = None, price: float = 0.0, output_price: float = 0.0, store: str | None = None) -> DataFrame:
    """paragraphs (book_id, ord, text, kind) with text, kind, heading_level, before, key, answer, and source: local (not asked), cache,
    ai or fallback (asked in vain, or past the budget). What came from ai can be put in the cache (key, answer as value).

    limit and prices rule out batches at their largest cost before any is asked; a judge that keeps a budget by itself
    (`calls.judge`) needs none of them."""
    rows = R.batches(paragraphs.where(needs), "book_id", ["ord"], R.ENHANCE).where(F.length("text") <= R.LONGEST).withColumn("key", R.cache_key(F.col("text"), model, features))
    hits, misses = R.split_cached(rows, cache.where(_item(F.col("value")).isNotNull()))
    asked = misses.withColumnRenamed("slot", "id").select("book_id", "batch", "id", "ord", "text", "kind", "key")
    open_, answers = judged(asked.join(admitted_batches(asked, limit, price, output_price, "spacing" in features), ["book_id", "batch"], "left_semi"), judge, store)
    said = R.answered(open_, typed(answers, _item)).join(open_.select("book_id", "batch", "id", "ord", "key"), ["book_id", "batch", "id"]).select("book_id", "ord", "key", "answer", "source")
    late = asked.join(open_, ["book_id", "batch"], "left_anti").select("book_id", "ord", "key", F.lit(None).cast("string").alias("answer"), F.lit("fallback").alias("source"))
    known = hits.select("book_id", "ord", "key", F.col("value").alias("answer"), F.lit("cache").alias("source"))
    found = paragraphs.join(said.unionByName(late).unionByName(known), ["book_id", "ord"], "left").withColumns({"source": F.coalesce("source", F.lit("local")), "before": F.col("text"), "item": _item(F.col("answer"))})
    return apply_item(found).drop("item")


def _item(answer: Column, kind: str = ITEM) -> Column:
    """An answer as a struct; null if it isn't an object, or a field has a value of another type."""
    found = F.from_json(answer, f"{kind}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return F.when(answer.rlike(r"\A\s*\{") & found["_bad"].isNull(), found)


def typed(answers: DataFrame, item) -> DataFrame:
    """answers without those of a batch in which any can't be read: the batch is then incomplete and falls back whole."""
    return answers.where(item(F.col("answer")).isNotNull())


def rule_plan(blocks: DataFrame, judge: Judge, clip: int = 2000, store: str | None = None) -> DataFrame:
    """The changes that a rule's judge proposes for blocks (book_id, document, idx, text); every block with text is asked about."""
    asked = R.batches(blocks.where(T.strip(F.col("text")) != ""), "book_id", ["document", "idx"], R.EDIT).withColumnRenamed("slot", "id")
    asked, answers = judged(asked.withColumn("shown", F.substring("text", 1, clip)), judge, store)
    change = lambda c: _item(c, CHANGE)
    said = R.answered(asked, typed(answers, change)).join(asked.select("book_id", "batch", "id", "document", "idx", "text"), ["book_id", "batch", "id"])
    said = said.withColumn("item", change(F.col("answer"))).select("book_id", "document", "idx", "text", F.col("item.action").alias("action"), F.col("item.text").alias("new_text"))
    return R.planned(said)


def audit_summary(found: DataFrame) -> DataFrame:
    """How many paragraphs of each book each source gave."""
    return found.groupBy("book_id").pivot("source", ["ai", "cache", "local", "fallback"]).count().na.fill(0)


def remaining(done: Column, total: Column, seconds: Column) -> Column:
    """Seconds that are left at the pace so far; null before the first is done."""
    return F.when(done > 0, seconds / done * (total - done))
