"""What recognisers and text layers give, as blocks. Recognisers themselves are functions that callers pass in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T


def recognise(images: DataFrame, engine: Callable, schema: str) -> DataFrame:
    """engine: an iterator of pandas frames of images (binaryFile columns) to one of frames of recognised rows."""
    return images.mapInPandas(engine, schema)


def lines_of_words(words: DataFrame, key: list[str]) -> DataFrame:
    """Recogniser rows (level, page_num ... text, all strings, and pos) as line blocks of each key: word boxes united, words
    joined in order, confidence the mean of the words' between 0 and 1."""
    num = lambda c: F.col(c).cast("int")
    rows = words.where((num("level") == 5) & (T.strip(F.col("text")) != ""))
    line = [*key, "page_num", "block_num", "par_num", "line_num"]
    left, top = num("left"), num("top")
    found = rows.groupBy(*line).agg(
        F.min("pos").alias("first"), F.min(left).alias("x0"), F.min(top).alias("y0"), F.max(left + num("width")).alias("x1"), F.max(top + num("height")).alias("y1"),
        (F.avg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("conf").cast("double")))) / 100).alias("confidence"),
        F.array_sort(F.collect_list(F.struct("pos", T.strip(F.col("text")).alias("t")))).alias("words"),
    )
    order = (F.row_number().over(Window.partitionBy(*key).orderBy("first")) - 1).cast("int")
    return found.select(*key, order.alias("reading_order"), F.array_join(F.transform("words", lambda w: w["t"]), " ").alias("text"), "x0", "y0", "x1", "y1", "confidence")


def respaced(blocks: DataFrame, texts: DataFrame, key: list[str]) -> DataFrame:
    """blocks (in reading order) with the lines of a page's native text (native) in place of theirs; other characters or
    another number of lines than theirs is an error."""
    lines = texts.select(*key, F.filter(F.split("native", "\n"), lambda x: T.strip(x) != "").alias("lines"))
    n = F.count("*").over(Window.partitionBy(*key))
    rows = blocks.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("reading_order"))).withColumn("n", n).join(lines, key, "left")
    line = T.strip(F.get("lines", F.col("k") - 1))
    fits = (F.size("lines") == F.col("n")) & (T.squeeze(line) == T.squeeze(F.col("text")))
    return rows.withColumn("text", F.when(F.coalesce(fits, F.lit(False)), line).otherwise(F.raise_error(F.lit("the native text doesn't fit the recognised lines")))).drop("k", "n", "lines")


def polygon_blocks(results: DataFrame, key: list[str]) -> DataFrame:
    """Results (rec_texts, rec_scores, rec_polys, width, height) as blocks in the order of their boxes' top left corners."""
    clamp = lambda x, most: F.greatest(F.lit(0), F.least(most, x)).cast("int")
    same = (F.size("rec_texts") == F.size("rec_scores")) & (F.size("rec_texts") == F.size("rec_polys"))
    rows = results.withColumn("rec_texts", F.when(same, F.col("rec_texts")).otherwise(F.raise_error(F.lit("arrays of different lengths"))))
    rows = rows.select(*key, "width", "height", F.posexplode(F.arrays_zip("rec_texts", "rec_scores", "rec_polys")).alias("pos", "r"))
    at = lambda k: F.transform(F.col("r.rec_polys"), lambda p: p[k])
    box = {
        "x0": clamp(F.floor(F.array_min(at(0))), F.col("width")), "y0": clamp(F.floor(F.array_min(at(1))), F.col("height")),
        "x1": clamp(F.ceil(F.array_max(at(0))), F.col("width")), "y1": clamp(F.ceil(F.array_max(at(1))), F.col("height")),
    }
    rows = rows.withColumns(box).withColumn("reading_order", (F.row_number().over(Window.partitionBy(*key).orderBy("y0", "x0", "pos")) - 1).cast("int"))
    return rows.select(*key, "reading_order", F.col("r.rec_texts").alias("text"), F.col("r.rec_scores").alias("confidence"), "x0", "y0", "x1", "y1")


def text_layer(rects: DataFrame, key: list[str], dpi: int = 300, least: int = 20) -> DataFrame:
    """Rectangles in points from a page's foot (l, b, r, t, and page_w, page_h) as boxes in pixels from its head.

    A page with fewer than `least` characters has no usable layer and gives no rows; boxes without area are left out.
    """
    c, scale = F.col, F.lit(dpi / 72)
    width, height = F.bround(c("page_w") * scale).cast("int"), F.bround(c("page_h") * scale).cast("int")
    clamp = lambda x, most: F.greatest(F.lit(0), F.least(most, F.bround(x).cast("int")))
    rows = rects.withColumn("chars", F.sum(F.length(T.strip(c("text")))).over(Window.partitionBy(*key))).where((c("chars") >= least) & (T.strip(c("text")) != ""))
    rows = rows.withColumns({"width": width, "height": height}).withColumns({"x0": clamp(c("l") * scale, c("width")), "y0": clamp((c("page_h") - c("t")) * scale, c("height")), "x1": clamp(c("r") * scale, c("width")), "y1": clamp((c("page_h") - c("b")) * scale, c("height"))})
    return rows.where("x1 > x0 AND y1 > y0").select(*key, "pos", "text", "width", "height", "x0", "y0", "x1", "y1", F.lit(1.0).alias("confidence"))


def layer_summary(rects: DataFrame, book: str, page: str, least: int = 20) -> DataFrame:
    each = rects.groupBy(book, page).agg(F.sum(F.length(T.strip(F.col("text")))).alias("chars"))
    return each.groupBy(book).agg(F.count("*").alias("page_count"), F.count_if(F.col("chars") >= least).alias("pages_with_text_layer"))


def patched(blocks: DataFrame, crops: DataFrame, key: list[str]) -> DataFrame:
    """blocks, of which corrupt ones get the text read again from their crop (key, id, pos, text, confidence): lines in order,
    the lowest confidence. A crop without text changes nothing."""
    lines = crops.where(T.strip(F.col("text")) != "").groupBy(*key, "id").agg(F.array_sort(F.collect_list(F.struct("pos", T.strip(F.col("text")).alias("t")))).alias("l"), F.min("confidence").alias("c"))
    lines = lines.select(*key, "id", F.array_join(F.transform("l", lambda x: x["t"]), " ").alias("again"), "c")
    use = T.is_corrupt(F.col("text")) & F.col("again").isNotNull()
    rows = blocks.join(lines, [*key, "id"], "left")
    return rows.withColumns({"confidence": F.when(use, F.col("c")).otherwise(F.col("confidence")), "text": F.when(use, F.col("again")).otherwise(F.col("text"))}).drop("again", "c")


def in_page(blocks: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """Blocks read from regions (key, region, left, top) at their place on the page, with ids and order that tell the region."""
    rows = blocks.join(regions, [*key, "region"])
    moved = {"x0": F.col("x0") + F.col("left"), "x1": F.col("x1") + F.col("left"), "y0": F.col("y0") + F.col("top"), "y1": F.col("y1") + F.col("top"), "id": F.format_string("region-%d:%s", "region", "id")}
    order = F.row_number().over(Window.partitionBy(*key).orderBy("region", "reading_order")) - 1
    return rows.withColumn("reading_order", order.cast("int")).withColumns(moved).drop("left", "top")


def gutters(profile: DataFrame, key: list[str]) -> DataFrame:
    """key, gutter: the middle of the longest run of light columns in profile (x, dark) of a page's middle; the first of equals.

    Light: at most three above the least dark.
    """
    light = profile.withColumn("least", F.min("dark").over(Window.partitionBy(*key))).where("dark <= least + 3")
    runs = light.withColumn("run", F.col("x") - F.row_number().over(Window.partitionBy(*key).orderBy("x"))).groupBy(*key, "run").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    best = runs.groupBy(*key).agg(F.max_by(F.struct("a", "b"), F.struct(F.col("b") - F.col("a"), -F.col("a"))).alias("m"))
    return best.select(*key, F.floor((F.col("m.a") + F.col("m.b")) / 2).cast("int").alias("gutter"))


def title_bottoms(profile: DataFrame, key: list[str]) -> DataFrame:
    """key, bottom: the middle of the first wide gap under the title in profile (y, dark, width, height); 7.5 % of the height if none.

    Rows of text are those of 10 dark pixels up to two fifths of the width, from 7.5 % to 25 % of the height.
    """
    c, d = F.col, lambda x: F.lit(float(x))
    rows = profile.where((c("y") >= c("height") * d(0.075)) & (c("y") < c("height") * d(0.25)) & (c("dark") >= 10) & (c("dark") < c("width") * d(0.4)))
    rows = rows.withColumn("before", F.lag("y").over(Window.partitionBy(*key).orderBy("y")))
    gaps = rows.where((c("y") - c("before") > c("height") * d(0.025)) & (c("before") < c("height") * d(0.16)))
    first = gaps.groupBy(*key).agg(F.min(F.struct("before", "y")).alias("g")).select(*key, F.floor((c("g.before") + c("g.y")) / 2).cast("int").alias("middle"))
    pages = profile.groupBy(*key).agg(F.first("height").alias("height"))
    return pages.join(first, key, "left").select(*key, F.coalesce("middle", F.floor(c("height") * d(0.075)).cast("int")).alias("bottom"))


def spine_documents(spine: DataFrame, manifest: DataFrame, members: DataFrame) -> DataFrame:
    """book_id, ord, path of the readable documents in reading order: spine (ord, idref), manifest (id, path, media), members (path)."""
    items = manifest.where("media = 'application/xhtml+xml'").select("book_id", F.col("id").alias("idref"), "path")
    return spine.join(items, ["book_id", "idref"]).join(members, ["book_id", "path"], "left_semi").select("book_id", "ord", "path")


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def book_title(title: Column, path: Column) -> Column:
    """The title, or the file's name without its ending."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*\z", "")
    return F.coalesce(F.nullif(T.strip(title), F.lit("")), stem)
