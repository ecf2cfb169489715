"""From blocks to paragraphs: margins, page numbers, simple and reconstructed paragraphs.

Margins are found by windows over pages, not by self-joins, so a text that is on every page costs one row for each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.sources import stores
from folioflow.sources.blocks import region


@dataclass(frozen=True)
class Layout:
    """Thresholds, in shares of the page or of a line's height."""

    zone: float = 0.15
    text_pages: int = 4
    offset_pages: int = 8
    near: float = 0.015
    least_pages: int = 3
    margin_height: float = 0.025


# Fixed values
TERMINAL = "[.!?。！？][”’\"')\\]}】》〉]*\\z"
LEFT_SUFFIX = "(?:의|을|를|은|는|이|가|에|에서|에게|께|으로|로|와|과|도|만|까지|부터|보다|처럼|하며|하고|하여|해서)\\z"
RIGHT_PREFIX = "\\A(?:때문(?:에|이다)|따라|위해|통해|관하여|대하여|비해|뿐만|등(?:은|을|이|의|과))(?:" + T.SPACE + "|\\z)"
LIST_ITEM = r"\A(?:(?U:\d)+[.)]|[•●])"
LEFT_OPEN, RIGHT_CLOSED = "[(\\[{〈《“\"]\\z", "\\A[)\\]}〉》,.:;]"
DEPENDENT_LAST = ("EC", "ETM", "JKS", "JKC", "JKG", "JKO", "JKB", "JKV", "JKQ", "JX", "JC", "MM", "XPN")
DEPENDENT_FIRST = "\\A(?:E|XS)"

KEYS = ["book_id", "page", "id"]


def page_number(layout: Layout = Layout()) -> Column:
    """Whether a block is a number of four digits at most, alone or between dashes, in a margin."""
    number = T.strip(F.col("text")).rlike(rf"\A(?:[-–—]{T.SPACE}*)?(?U:\d){{1,4}}(?:{T.SPACE}*[-–—])?\z")
    # boxes tell first, as in `margin_candidates`
    return ((F.col("y1") <= F.lit(layout.zone) * F.col("height")) | (F.col("y0") >= F.lit(1 - layout.zone) * F.col("height"))) & number


def margin_candidates(blocks: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """book_id, page, id, side, place, text of compact blocks that lie in the outer bands; text without white space."""
    c = F.col
    top = c("y1") <= c("height") * F.lit(layout.zone)
    # boxes tell first: texts of the page's middle aren't looked at
    rows = blocks.where(top | (c("y0") >= c("height") * F.lit(1 - layout.zone)))
    # a text's beginning tells whether it is too long; only of the others white space is taken out
    rows = rows.where(c("text").rlike(T.BARE % "2,60"))
    compact = (c("type") != "heading") & (c("y1") - c("y0") <= c("height") * F.lit(layout.margin_height))
    kept = lambda bare: compact & F.length(bare).between(2, 60) & ~bare.rlike(r"\A\p{Nd}+\z")
    # as one of an array, white space is taken out once; a filter of it would go below the column and take it out for each use
    bare = F.explode(F.filter(F.array(T.squeeze(c("text"))), kept))
    return rows.select("book_id", "page", "id", F.when(top, "top").otherwise("bottom").alias("side"), ((c("y0") + c("y1")) / (2 * c("height"))).alias("place"), bare.alias("text"))


def bands(blocks: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """blocks with side, place, text without white space, and kept: whether they are candidates."""
    c = F.col
    side = F.when(c("y1") <= c("height") * F.lit(layout.zone), "top").when(c("y0") >= c("height") * F.lit(1 - layout.zone), "bottom")
    rows = blocks.withColumn("side", side).withColumn("bare", T.squeeze(c("text")))
    kept = c("side").isNotNull() & (c("type") != "heading") & F.length("bare").between(2, 60) & ~c("bare").rlike(r"\A\p{Nd}+\z") & (c("y1") - c("y0") <= c("height") * F.lit(layout.margin_height))
    return rows.withColumns({"kept": F.coalesce(kept, F.lit(False)), "place": (c("y0") + c("y1")) / (2 * c("height")), "text": c("bare")}).drop("bare")


#: Pages of a range, and paragraphs of one, that are one unit of work in a book.
RANGE, PARAGRAPHS = 512, 4096


def range_of(at: Column, size: int = RANGE) -> Column:
    return F.floor(at / size).cast("int")


def carried(rows: DataFrame, range_: str, order: list[str], values: list[str]) -> DataFrame:
    """rows with last: a struct of the values of the row before in the book's order, null for a book's first.

    Ranges are ordered apart; the last row of each is carried to the next range that has rows.
    """
    own, value = Window.partitionBy("book_id", range_).orderBy(*order), F.struct(*values)
    rows = rows.withColumns({"last": F.lag(value).over(own), "final": F.lead(F.lit(True)).over(own).isNull(), "head": F.lag(F.lit(True)).over(own).isNull()})
    ends = rows.where("final").select("book_id", range_, value.alias("end"))
    ends = ends.withColumn("carry", F.lag("end").over(Window.partitionBy("book_id").orderBy(range_))).drop("end")
    return rows.join(ends, ["book_id", range_]).withColumn("last", F.when(F.col("head"), F.col("carry")).otherwise(F.col("last"))).drop("carry", "head", "final")


def counted(rows: DataFrame, range_: str, order: list[str], flag: Column, name: str) -> DataFrame:
    """rows with how many flags there are up to each in the book's order: counted in ranges, and before each range."""
    own, book = Window.partitionBy("book_id", range_), Window.partitionBy("book_id")
    rows = rows.withColumn("flag", flag.cast("long"))
    sums = rows.groupBy("book_id", range_).agg(F.sum("flag").alias("sum"))
    sums = sums.withColumn("before", F.sum("sum").over(book.orderBy(range_)) - F.col("sum")).drop("sum")
    rows = rows.withColumn(name, F.sum("flag").over(own.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(sums, ["book_id", range_]).withColumn(name, F.col(name) + F.col("before")).drop("before", "flag")


def _text_key() -> tuple[Column, Column]:
    """The key of a text without a page number fused to it, and whether there is one."""
    label = F.regexp_replace("text", r"\A(?U:\d){1,4}|(?U:\d){1,4}\z", "")
    return F.concat(F.lit("text "), label), F.length(label).between(2, 60)


def _offset_key() -> tuple[Column, Column]:
    """The key of the distance between the first number and the page's, and whether there is one."""
    number = F.regexp_extract("text", r"((?U:\d){1,4})", 1)
    return F.concat(F.lit("offset "), (T.ascii_digits(number).cast("int") - F.col("page")).cast("string")), number != ""


def keys_of(**pages: int) -> Column:
    """The keys that a candidate has (of text, offset), each with the pages within which it is looked for."""
    kinds = {"text": _text_key, "offset": _offset_key}
    keys = [F.when(there, F.struct(key.alias("key"), F.lit(n).alias("pages"))) for name, n in pages.items() for key, there in [kinds[name]()]]
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


def _recurring(candidates: DataFrame, layout: Layout, **pages: int) -> DataFrame:
    """Candidates that have a key (text, offset) in place on enough pages within so many pages; one window for all keys.

    Pages are dealt to ranges, and those near a range's ends go to its neighbour too, so a head that is on all pages of a very
    long book isn't one task.
    """
    rows = candidates.withColumn("k", F.explode(keys_of(**pages))).select(*KEYS, "side", "place", "k.key", "k.pages")
    widest, own = max(pages.values()), range_of(F.col("page"))
    # a key is one row of a page, however often the page has it
    rows = rows.groupBy("book_id", "side", "key", "pages", "page").agg(F.collect_list(F.struct("id", "place")).alias("found"), F.collect_set("place").alias("places"))
    met = F.sequence(range_of(F.col("page") - widest), range_of(F.col("page") + widest))
    rows = rows.withColumns({"own": own, "range": F.explode(met)})
    around = Window.partitionBy("book_id", "side", "key", "range").orderBy("page").rangeBetween(-widest, widest)
    rows = rows.withColumn("around", F.collect_list(F.struct("page", "places")).over(around)).where("range = own").where(F.size("around") >= layout.least_pages)
    near = lambda place: F.filter("around", lambda x: (F.abs(x["page"] - F.col("page")) <= F.col("pages")) & F.exists(x["places"], lambda p: F.abs(p - place) <= F.lit(layout.near)))
    rows = rows.withColumn("good", F.filter("places", lambda place: F.size(near(place)) >= layout.least_pages)).where(F.size("good") > 0)
    rows = rows.select("book_id", "page", F.explode(F.filter("found", lambda x: F.array_contains("good", x["place"]))).alias("f"))
    return rows.select("book_id", "page", "f.id")


def repeated_text(candidates: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Candidates whose text, without a page number fused to it, recurs in place on pages nearby."""
    return _recurring(candidates, layout, text=layout.text_pages)


def repeated_offset(candidates: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Candidates whose first number keeps one distance from the page's on pages nearby, whatever the label says."""
    return _recurring(candidates, layout, offset=layout.offset_pages)


def margins(blocks: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """book_id, page, id of repeated heads and feet."""
    return _recurring(margin_candidates(blocks, layout), layout, text=layout.text_pages, offset=layout.offset_pages).distinct()


def _height() -> Column:
    return F.when(F.length(T.strip(F.col("text"))) > 3, F.col("y1") - F.col("y0"))


def body_size(blocks: DataFrame) -> DataFrame:
    """book_id, page, size: the median height of blocks of more than three characters, 0 without any."""
    return blocks.groupBy("book_id", "page").agg(F.coalesce(F.median(_height()), F.lit(0.0)).alias("size"))


def without(blocks: DataFrame, *removed: DataFrame) -> DataFrame:
    """blocks that aren't among the removed ids."""
    for ids in removed:
        blocks = blocks.join(ids.select(*KEYS), KEYS, "left_anti")
    return blocks


def by_pages(removed: DataFrame) -> DataFrame:
    """book_id, page, gone: the removed ids of each page."""
    # keys come out of the aggregate as values: the join's filter of nulls stays above it, and doesn't make the margins' reading
    # of the blocks another one than that of the blocks themselves, which are then read and dealt once for both
    return removed.groupBy("book_id", "page").agg(F.collect_set("id").alias("gone"), F.max("book_id").alias("of"), F.max("page").alias("at")).select(F.col("of").alias("book_id"), F.col("at").alias("page"), "gone")


def flagged(blocks: DataFrame, removed: DataFrame, layout: Layout = Layout(), also: Column | None = None) -> DataFrame:
    """blocks with number (of a page), gone (among the removed ids, or also), and body (`body_size` of all blocks of the page).

    What follows reads these columns, so blocks are read once for their own sake and once for the margins.
    """
    # by pages, as all that follows is: blocks are shuffled once
    ids = by_pages(removed)
    rows = blocks.join(ids, ["book_id", "page"], "left")
    gone = F.coalesce(F.array_contains("gone", F.col("id")), F.lit(False))
    body = F.coalesce(F.median(_height()).over(Window.partitionBy("book_id", "page")), F.lit(0.0))
    return rows.withColumns({"number": page_number(layout), "gone": gone if also is None else gone | also, "body": body})


def simple_paragraphs(blocks: DataFrame, removed: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """book_id, page, first (position of the first line), text, ids, stray: lines of a page joined by gaps and indents.

    Stray ones, a lone block of noise, are marked and not left out, so their ids can be reported.
    """
    return paragraphs_of(flagged(blocks, removed, layout))


def paragraphs_of(rows: DataFrame) -> DataFrame:
    """`simple_paragraphs` of flagged blocks."""
    c = F.col
    order = Window.partitionBy("book_id", "page").orderBy("reading_order", "pos")
    rows = rows.where(~c("number") & ~c("gone")).withColumn("t", T.strip(c("text")))
    last = lambda x: F.lag(x).over(order)
    rows = rows.withColumns({"t0": last("t"), "type0": last("type"), "x00": last("x0"), "y10": last("y1"), "h0": F.greatest(F.lit(1), last(c("y1") - c("y0")))})
    starts = c("t0").isNull() | (c("t0") == "") | (c("type") == "heading") | (c("type0") == "heading") | (c("y0") - c("y10") > c("h0") * F.lit(0.9)) | (c("x0") - c("x00") > c("h0") * F.lit(1.5))
    rows = rows.withColumn("starts", starts).withColumn("para", F.sum(c("starts").cast("int")).over(order)).where("t <> ''")
    line = F.struct("reading_order", "pos", "t", "id", (c("x1") - c("x0")).alias("w"), (c("y1") - c("y0")).alias("h"), "body")
    found = rows.groupBy("book_id", "page", "para").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    one = c("lines")[0]
    stray = (F.size("lines") == 1) & T.is_stray(one["t"], one["w"], one["h"], one["body"])
    return found.select("book_id", "page", one["pos"].alias("first"), F.array_join(F.transform("lines", lambda x: x["t"]), " ").alias("text"), F.transform("lines", lambda x: x["id"]).alias("ids"), stray.alias("stray"))


def removed_ids(blocks: DataFrame, removed: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """book_id, page, ids: page numbers and removed blocks in the blocks' order, then strays."""
    return removed_of(flagged(blocks, removed, layout))


def removed_of(rows: DataFrame) -> DataFrame:
    """`removed_ids` of flagged blocks."""
    own = rows.where("number or gone").select("book_id", "page", F.lit(0).alias("part"), "pos", "id")
    stray = paragraphs_of(rows).where("stray").select("book_id", "page", F.lit(1).alias("part"), F.col("first").alias("pos"), F.col("ids")[0].alias("id"))
    rows = own.unionByName(stray).groupBy("book_id", "page").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "id"))).alias("all"))
    return rows.select("book_id", "page", F.array_join(F.transform("all", lambda x: x["id"]), ",").alias("ids"))


def body_lines(blocks: DataFrame, removed: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Blocks that are read: no page numbers, removed ones or blanks."""
    return lines_of(flagged(blocks, removed, layout))


def lines_of(rows: DataFrame) -> DataFrame:
    """`body_lines` of flagged blocks; body stays."""
    return rows.where(~F.col("number") & ~F.col("gone") & (T.strip(F.col("text")) != "")).drop("number", "gone")


def line_features(lines: DataFrame) -> DataFrame:
    """Lines with their region's measures (baseline, right, size, region_ord) and whether they begin something."""
    c = F.col
    lines = lines.withColumn("region", region(c("id"))).withColumn("t", T.strip(c("text")))
    if "ids" not in lines.columns:
        lines = lines.withColumn("ids", F.array("id"))
    whole, order = Window.partitionBy("book_id", "page", "region"), Window.partitionBy("book_id", "page", "region").orderBy("reading_order", "pos")
    lines = lines.withColumns({
        "baseline": F.min("x0").over(whole), "right": F.max("x1").over(whole), "size": F.median(F.greatest(F.lit(1), c("y1") - c("y0"))).over(whole),
        "region_ord": F.min(F.struct("reading_order", "pos")).over(whole), "above": F.lag("y1").over(order),
    })
    gap = F.coalesce(c("y0") - c("above"), F.lit(0))
    short = (c("x1") - c("x0")) < (c("right") - c("baseline")) * F.lit(0.78)
    heading = (c("type") == "heading") | (c("region") == "region-0") | (short & (gap > c("size") * F.lit(1.8)) & (F.length("t") < 50) & ~c("t").rlike("[.!?。]\\z"))
    lines = lines.withColumns({"first": c("above").isNull(), "gap": gap, "short": short, "heading": heading, "indented": c("x0") - c("baseline") > c("size") * F.lit(0.65), "item": c("t").rlike(LIST_ITEM)})
    return lines


def pieces_of(lines: DataFrame) -> DataFrame:
    """book_id, page, k, text, heading, sources, w, h, body of the pieces that paragraphs have on a page, k from 0; and what pages
    before and after ask: can, size (whether the page's first line can go on from the page before), open, over (whether its last one
    is left open, and by how much it is short of its region's edge)."""
    c = F.col
    order = ["region_ord", "reading_order", "pos"]
    own = Window.partitionBy("book_id", "page").orderBy(*order)
    rows = lines.withColumns({
        "can": c("first") & ~c("heading") & ~c("indented") & ~c("item") & (c("y0") < c("height") * F.lit(0.23)),
        "open": (c("y1") > c("height") * F.lit(0.84)) & ~c("heading") & ~c("t").rlike("[.!?。][”’\"')\\]]*\\z"),
        "over": c("right") - c("x1"), "begins": c("first") | c("heading") | c("indented") | c("item") | (c("gap") > c("size") * F.lit(1.8)),
    })
    last = lambda x: F.lag(x).over(own)
    rows = rows.withColumns({"heading0": last("heading"), "open0": last("open"), "over0": last("over")})
    starts = (c("begins") | c("heading0")) & ~_goes_on(c("can"), c("size"), c("open0"), c("over0"))
    rows = rows.withColumn("starts", F.when(c("heading0").isNotNull(), starts).cast("int"))
    rows = rows.withColumn("k", F.coalesce(F.sum("starts").over(own), F.lit(0)))
    line = F.struct(*order, "t", "ids", "heading", (c("x1") - c("x0")).alias("w"), (c("y1") - c("y0")).alias("h"), "body", "can", "size", "open", "over")
    found = rows.groupBy("book_id", "page", "k").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    one, end = c("lines")[0], F.element_at("lines", -1)
    sources = F.flatten(F.transform("lines", lambda x: F.transform(x["ids"], lambda i: F.struct(c("page").alias("page"), i.alias("block_id")))))
    return found.select("book_id", "page", "k", F.array_join(F.transform("lines", lambda x: x["t"]), " ").alias("text"), sources.alias("sources"), *[one[x].alias(x) for x in ("heading", "w", "h", "body", "can", "size")], end["open"].alias("open"), end["over"].alias("over"))


def _goes_on(can: Column, size: Column, open_: Column, over: Column) -> Column:
    return F.coalesce(can & open_ & (over < size * F.lit(1.2)), F.lit(False))


def reconstruct(lines: DataFrame, sizes: DataFrame | None = None, pages: int = RANGE, ranged: int | None = None) -> DataFrame:
    """book_id, ord, text, kind, sources, lone of paragraphs that may go on over regions and pages; strays are left out.

    lines: line_features of blocks or of visual lines, whose sources are all their runs; sizes: body_size of all blocks, where
    lines don't have it as body. Pages are cut into pieces of paragraphs, which are written; whether a page goes on from the one
    before, and how many paragraphs a book had before it, is told from a short row of each page, in ranges of pages, so a very
    long book is many tasks. ranged: paragraphs of a range of so many are dealt together, and range tells which, as
    `merge_by_context` asks.
    """
    c, spark = F.col, lines.sparkSession
    if sizes is not None:
        lines = lines.drop("body").join(sizes.withColumnRenamed("size", "body"), ["book_id", "page"])
    pieces = stores.kept(spark, lambda: pieces_of(lines))

    def before() -> DataFrame:
        ends = pieces.groupBy("book_id", "page").agg(F.max("k").alias("more"), F.min_by(F.struct("can", "size"), "k").alias("front"), F.max_by(F.struct("open", "over"), "k").alias("tail"))
        rows = carried(ends.withColumn("range", range_of(c("page"), pages)), "range", ["page"], ["page", "tail"])
        goes_on = _goes_on(c("front.can"), c("front.size"), c("last.tail.open"), c("last.tail.over")) & F.coalesce(c("page") - c("last.page") == 1, F.lit(False))
        rows = rows.select("book_id", "page", "range", "more", (c("more") + F.when(goes_on, 0).otherwise(1)).alias("n"))
        return counted(rows, "range", ["page"], c("n"), "ord").select("book_id", "page", (c("ord") - c("more")).alias("base"))

    rows = pieces.join(stores.kept(spark, before), ["book_id", "page"]).withColumn("ord", c("base") + c("k"))
    dealt = ["range"] if ranged else []
    if ranged:
        rows = rows.withColumn("range", range_of(c("ord"), ranged)).repartition("book_id", "range")
    found = rows.groupBy("book_id", *dealt, "ord").agg(F.array_sort(F.collect_list(F.struct("page", "k", "text", "heading", "sources", "w", "h", "body"))).alias("all"))
    one, sources = c("all")[0], F.flatten(F.transform("all", lambda x: x["sources"]))
    found = found.select("book_id", *dealt, "ord", "all", sources.alias("sources")).withColumn("lone", F.size("sources") == 1)
    found = found.where(~(c("lone") & T.is_stray(one["text"], one["w"], one["h"], one["body"])))
    return found.select("book_id", *dealt, "ord", F.array_join(F.transform("all", lambda x: x["text"]), " ").alias("text"), F.when(one["heading"], "heading").otherwise("body").alias("kind"), "sources", "lone")


def joins(left: Column, right: Column, tags: tuple[Column, Column] | None = None) -> Column:
    """Whether two paragraphs are one, by their end and beginning. tags: last and first part-of-speech tag, if an analyser gives them."""
    left, right = T.strip_end(left), T.strip_start(right)
    open_ = left.rlike(LEFT_OPEN) | right.rlike(RIGHT_CLOSED)
    words = left.rlike(LEFT_SUFFIX) | right.rlike(RIGHT_PREFIX)
    tagged = F.lit(False)
    if tags is not None:
        strong = tags[0].isin(*DEPENDENT_LAST)
        tagged = F.coalesce(strong, F.lit(False)) | F.coalesce(tags[1].rlike(DEPENDENT_FIRST), F.lit(False))
    return (left != "") & (right != "") & ~left.rlike(TERMINAL) & (open_ | tagged | words)


def neighbours(paragraphs: DataFrame, size: int = PARAGRAPHS) -> DataFrame:
    """Paragraphs with left (the text before) where both are body and lie on one page or two that follow."""
    last = F.element_at("sources", -1)["page"]
    rows = paragraphs if "range" in paragraphs.columns else paragraphs.withColumn("range", range_of(F.col("ord"), size))
    rows = carried(rows.withColumn("ends", last), "range", ["ord"], ["text", "kind", "ends"])
    next_to = (F.col("last.kind") == "body") & (F.col("kind") == "body") & (F.col("sources")[0]["page"] - F.col("last.ends")).isin(0, 1)
    return rows.withColumn("left", F.when(next_to, F.col("last.text"))).drop("last", "ends", "range")


def merge_by_context(paragraphs: DataFrame, join=joins, size: int = PARAGRAPHS) -> DataFrame:
    """Paragraphs united where join(left, right) says so; ord is the first one's.

    Those of a range are united where they are, and written; then a range's first and last one tell whether ranges go on.
    """
    c, spark = F.col, paragraphs.sparkSession
    own = Window.partitionBy("book_id", "range").orderBy("ord")
    met = lambda last, text, kind, page: F.coalesce((last["kind"] == "body") & (kind == "body") & (page - last["page"]).isin(0, 1) & join(last["text"], text), F.lit(False))

    def pieces() -> DataFrame:
        rows = paragraphs if "range" in paragraphs.columns else paragraphs.withColumn("range", range_of(c("ord"), size))
        rows = rows.withColumns({"begins": c("sources")[0]["page"], "tail": F.struct("text", "kind", F.element_at("sources", -1)["page"].alias("page"))})
        rows = rows.withColumns({"last": F.lag("tail").over(own), "tail": F.when(F.lead(F.lit(True)).over(own).isNull(), c("tail"))})
        rows = rows.withColumns({"new": (c("last").isNotNull() & ~met(c("last"), c("text"), c("kind"), c("begins"))).cast("int"), "front": F.when(c("last").isNull(), F.struct("text", "kind", c("begins").alias("page")))})
        rows = rows.withColumn("k", F.sum("new").over(own))
        return _one(rows.groupBy("book_id", "range", "k"), F.max("front").alias("front"), F.max("tail").alias("tail"))

    found = stores.kept(spark, pieces)

    def before() -> DataFrame:
        book = Window.partitionBy("book_id").orderBy("range")
        ends = found.groupBy("book_id", "range").agg(F.max("k").alias("more"), F.max("front").alias("front"), F.max("tail").alias("tail")).withColumn("last", F.lag("tail").over(book))
        ends = ends.withColumn("n", c("more") + F.when(met(c("last"), c("front.text"), c("front.kind"), c("front.page")), 0).otherwise(1))
        return ends.select("book_id", "range", (F.sum("n").over(book) - c("more")).alias("base"))

    rows = found.join(stores.kept(spark, before), ["book_id", "range"])
    return _united(rows.withColumn("group", c("base") + c("k")))


def united(rows: DataFrame, size: int = PARAGRAPHS) -> DataFrame:
    """book_id, ord, text, kind, sources of paragraphs, each joined to the one before where its row says so."""
    return _united(counted(rows.withColumn("range", range_of(F.col("ord"), size)), "range", ["ord"], ~F.col("joined"), "group"))


def _united(rows: DataFrame) -> DataFrame:
    """One paragraph of each group."""
    return _one(rows.groupBy("book_id", "group")).drop("group")


def _one(groups, *also: Column) -> DataFrame:
    """The groups' keys, and ord, text, kind, sources of the one paragraph that each makes."""
    found = groups.agg(F.array_sort(F.collect_list(F.struct("ord", "text", "kind", "sources"))).alias("all"), *also)
    one = [F.col("all")[0]["ord"].alias("ord"), F.array_join(F.transform("all", lambda x: x["text"]), " ").alias("text"), F.col("all")[0]["kind"].alias("kind"), F.flatten(F.transform("all", lambda x: x["sources"])).alias("sources")]
    return found.select(*[x for x in found.columns if x != "all"], *one)


def merge_with(paragraphs: DataFrame, analyse: Callable[[str], list[str]]) -> DataFrame:
    """Paragraphs united by `joins` with an analyser's tags of words: a text's last and first one.

    The left side is all that was joined so far, whose last tag may be another one than the last paragraph's. So each run of
    body paragraphs is one fold; runs are told apart first, and are the unit of work. Only tags come from Python: what local
    rules say of a boundary by its end and beginning is a column.
    """
    c = F.col
    rows = neighbours(paragraphs)
    rows = counted(rows.withColumn("range", range_of(c("ord"), PARAGRAPHS)), "range", ["ord"], c("left").isNull(), "run")
    rows = rows.withColumns({"local": F.coalesce(joins(c("left"), c("text")), F.lit(False)), "open": _is_open(c("left"), c("text"))})
    rows = rows.select("book_id", "run", "ord", "text", "local", "open").repartition("book_id", "run").sortWithinPartitions("book_id", "run", "ord")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, text = None, ""
        for batch in batches:
            joined = []
            for book, run, own, local, is_open in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5)), strict=True):
                same = last == (book, run)
                yes = same and (local or (is_open and _tagged(analyse(text), analyse(own))))
                joined.append(yes)
                last, text = (book, run), f"{text} {own}" if yes else own
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(joined, pa.bool_())], ["book_id", "ord", "joined"])

    kinds = dict(paragraphs.dtypes)
    told = rows.mapInArrow(fold, f"book_id string, ord {kinds['ord']}, joined boolean")
    return united(paragraphs.join(told, ["book_id", "ord"]))


def _is_open(left: Column, right: Column) -> Column:
    """Whether both sides have text and the left one doesn't end a sentence."""
    left = T.strip_end(left)
    return F.coalesce((left != "") & (T.strip(right) != "") & ~left.rlike(TERMINAL), F.lit(False))


def _tagged(left: list[str], right: list[str]) -> bool:
    return bool(left and left[-1] in DEPENDENT_LAST) or bool(right and re.match(DEPENDENT_FIRST, right[0]))


def boundary_route(left: Column, right: Column, join=joins) -> Column:
    """join, ask (an outside judgement) or split for each boundary."""
    trimmed = T.strip_end(left)
    return F.when(join(left, right), "join").when((T.strip(left) != "") & (T.strip(right) != "") & ~trimmed.rlike(TERMINAL), "ask").otherwise("split")


def listening(paragraphs: DataFrame) -> DataFrame:
    """What is read aloud: no brackets, no empty paragraphs."""
    # a filter would go below the column, and take the brackets out once more
    return paragraphs.withColumn("text", F.explode(F.filter(F.array(T.remove_parenthetical(F.col("text"))), lambda x: x != "")))
