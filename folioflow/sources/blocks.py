"""Pages as one row per block, their validation, and an adapter that gives the lines of documents a page layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCKS = "book_id string, page int, width int, height int, pos int, id string, text string, x0 int, y0 int, x1 int, y1 int, confidence double, reading_order int, type string"
#: A page as it is stored: blocks nested, boxes as arrays.
RAW_PAGE = "page int, width int, height int, blocks array<struct<id:string,text:string,bbox:array<int>,confidence:double,reading_order:int,type:string>>"


def explode_pages(pages: DataFrame) -> DataFrame:
    """Stored pages (book_id and RAW_PAGE) as blocks."""
    b = F.col("b")
    rows = pages.select("book_id", "page", "width", "height", F.posexplode("blocks").alias("pos", "b"))
    box = [b["bbox"][k].alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.select("book_id", "page", "width", "height", "pos", b["id"].alias("id"), b["text"].alias("text"), *box, b["confidence"].alias("confidence"), b["reading_order"].alias("reading_order"), F.coalesce(b["type"], F.lit("line")).alias("type"))


def nest_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks as stored pages again, in their old order."""
    b = F.struct("pos", F.struct("id", "text", F.array("x0", "y0", "x1", "y1").alias("bbox"), "confidence", "reading_order", "type").alias("b"))
    rows = blocks.groupBy("book_id", "page", "width", "height").agg(F.array_sort(F.collect_list(b)).alias("all"))
    return rows.select("book_id", "page", "width", "height", F.transform("all", lambda x: x["b"]).alias("blocks"))


def region(id: Column) -> Column:
    """The part of an id before its colon, for ids of regions; else body."""
    return F.when(id.startswith("region-"), F.substring_index(id, ":", 1)).otherwise("body")


#: Pages of a book of documents at most.
PAGES = 500


def document_book() -> Column:
    return F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / PAGES).cast("string"))


def document_pages(spark: SparkSession, sf_dir: str, one_book: bool = False) -> DataFrame:
    """documents as pages of books, a row each: book_id, page, lines, n (of them), height; see `document_blocks`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("book_id", F.lit("all") if one_book else document_book())
    page = (F.col("doc_id") + 1).cast("int") if one_book else F.row_number().over(Window.partitionBy("book_id").orderBy("doc_id"))
    docs = docs.select("book_id", page.alias("page"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    return docs.withColumn("n", F.size("lines")).withColumn("height", F.greatest(F.lit(1000), 200 + 25 * F.col("n")))


def document_blocks(spark: SparkSession, sf_dir: str, one_book: bool = False) -> DataFrame:
    """documents as books (source, and each PAGES ids), pages (by doc_id) and blocks (lines), with a running head and a foot on
    each page. No book has more than PAGES pages, however large its source is; or all are one_book, whose pages are doc_id + 1."""
    return page_blocks(document_pages(spark, sf_dir, one_book))


def page_blocks(docs: DataFrame, *also: str) -> DataFrame:
    """The blocks of `document_pages`, and the columns also of their pages. A page's blocks are cut from one row, so they follow
    each other in their order."""
    head, foot = F.concat(F.lit("Running head "), F.col("page").cast("string")), F.concat(F.lit("Chapter "), F.char(97 + F.col("page") % 9), F.col("page").cast("string"))
    # only texts are exploded: what follows from a line's place and length are columns, made where they are read
    rows = docs.select("book_id", "page", "n", "height", *also, F.posexplode(F.concat(F.array(head), F.col("lines"), F.array(foot))).alias("pos", "text"))
    pos, i, n, length = F.col("pos"), F.col("pos") - 1, F.col("n"), F.length("text").cast("int")
    pick = lambda first, last, line: F.when(pos == 0, first).when(pos == n + 1, last).otherwise(line)
    x0, name = F.when(length % 7 == 0, 140).otherwise(100), F.concat(F.lit("l"), i.cast("string"))
    name = F.when(F.col("page") % 5 == 0, F.concat(F.lit("region-"), F.when(2 * i < n, "1").otherwise("2"), F.lit(":"), name)).otherwise(name)
    return rows.select(
        "book_id", "page", F.lit(1000).alias("width"), "height", "pos", pick(F.lit("head"), F.lit("foot"), name).alias("id"), "text",
        pick(F.lit(400), F.lit(400), x0).alias("x0"), pick(F.lit(5), F.col("height") - 25, 30 + 25 * i).alias("y0"),
        pick(F.lit(600), F.lit(600), F.least(F.lit(980), x0 + 12 * length)).alias("x1"), pick(F.lit(20), F.col("height") - 10, 45 + 25 * i + 5 * (length % 2)).alias("y1"),
        F.lit(1.0).alias("confidence"), pos.alias("reading_order"), pick(F.lit("line"), F.lit("line"), F.when(length.between(1, 20), "heading").otherwise("line")).alias("type"), *also,
    )


BLOCKS_SQL = """
dk AS (SELECT *, source || '/' || (doc_id // 500) AS book_id FROM documents),
pg AS (SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS INT) AS page, string_split(coalesce(text, ''), chr(10)) AS ls FROM dk),
ln AS (SELECT book_id, page, CAST(len(ls) AS INT) AS n, unnest(ls) AS text, CAST(unnest(range(len(ls))) AS INT) AS i FROM pg),
blocks AS (
SELECT book_id, page, 1000 AS width, greatest(1000, 200 + 25 * n) AS height, i + 1 AS pos,
  CASE WHEN page % 5 = 0 THEN 'region-' || CASE WHEN 2 * i < n THEN '1' ELSE '2' END || ':l' || i ELSE 'l' || i END AS id, text,
  CASE WHEN length(text) % 7 = 0 THEN 140 ELSE 100 END AS x0, 30 + 25 * i AS y0,
  least(980, CASE WHEN length(text) % 7 = 0 THEN 140 ELSE 100 END + 12 * length(text)) AS x1, 45 + 25 * i + 5 * (length(text) % 2) AS y1,
  1.0::double AS confidence, i + 1 AS reading_order, CASE WHEN length(text) BETWEEN 1 AND 20 THEN 'heading' ELSE 'line' END AS type FROM ln
UNION ALL SELECT book_id, page, 1000, greatest(1000, 200 + 25 * len(ls)), 0, 'head', 'Running head ' || page, 400, 5, 600, 20, 1.0, 0, 'line' FROM pg
UNION ALL SELECT book_id, page, 1000, greatest(1000, 200 + 25 * len(ls)), len(ls) + 1, 'foot', 'Chapter ' || chr(97 + page % 9) || page, 400, greatest(1000, 200 + 25 * len(ls)) - 25, 600, greatest(1000, 200 + 25 * len(ls)) - 10, 1.0, len(ls) + 1, 'line' FROM pg)"""


#: The same as one book.
ONE_BOOK_SQL = BLOCKS_SQL.replace("source || '/' || (doc_id // 500) AS book_id", "'all' AS book_id").replace("row_number() OVER (PARTITION BY book_id ORDER BY doc_id)", "doc_id + 1")


def violations(blocks: DataFrame) -> DataFrame:
    """book_id, page, id, problem of each block that breaks a rule; a page's repeated ids are reported once each."""
    c = F.col
    rules = {
        "bbox": (F.least("x0", "y0", "x1", "y1") < 0) | (c("x1") < c("x0")) | (c("y1") < c("y0")),
        "confidence": F.isnan("confidence") | ~c("confidence").between(0, 1),
        "id": F.coalesce(c("id"), F.lit("")) == "",
        "order": c("reading_order") < 0,
        "page": (c("page") < 1) | (c("width") < 1) | (c("height") < 1),
        "outside": (c("x1") > c("width")) | (c("y1") > c("height")),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(True)), name) for name, rule in rules.items()]), lambda x: x.isNotNull())
    each = blocks.select("book_id", "page", "id", F.explode(found).alias("problem"))
    twice = blocks.groupBy("book_id", "page", "id").count().where("count > 1").select("book_id", "page", "id", F.lit("duplicate").alias("problem"))
    return each.unionByName(twice)


def validated(blocks: DataFrame) -> DataFrame:
    """blocks; reading a block whose box, confidence, id or order breaks a rule is an error."""
    c = F.col
    good = (F.least("x0", "y0", "x1", "y1") >= 0) & (c("x1").between(c("x0"), c("width"))) & (c("y1").between(c("y0"), c("height"))) & c("confidence").between(0, 1) & (c("id") != "") & (c("reading_order") >= 0)
    return blocks.withColumn("id", F.when(F.coalesce(good, F.lit(False)), c("id")).otherwise(F.raise_error(F.concat(F.lit("invalid block "), F.coalesce("id", F.lit("?"))))))


def in_range(blocks: DataFrame, first: int, last: int) -> DataFrame:
    """Pages first to last; the filter reaches the scan, and prunes folders where pages are partitions."""
    if not 1 <= first <= last:
        raise ValueError(f"no such range: {first}-{last}")
    return blocks.where(F.col("page").between(first, last))


def missing_pages(totals: DataFrame, stored: DataFrame) -> DataFrame:
    """book_id, page of the pages that a run still has to read: 1 to n_pages of each book without those stored."""
    wanted = totals.where("n_pages > 0").select("book_id", F.explode(F.sequence(F.lit(1), F.col("n_pages"))).alias("page"))
    return wanted.join(stored.select("book_id", "page").distinct(), ["book_id", "page"], "left_anti")
