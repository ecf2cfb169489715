"""Queries of recogniser results, page images' profiles, and packaged books."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from folioflow.operators import layout as L
from folioflow.plans.layouts import _SIMPLE
from folioflow.plans.texts import _STRIP, junk_sql
from folioflow.sources import archive as A
from folioflow.sources import blocks as B
from folioflow.sources import book_format
from folioflow.sources import images as I
from folioflow.sources import recognised as S
from folioflow.sources import stores

c = F.col


def words(spark, sf_dir):
    """Turns of conversations as a recogniser's rows: eight words a line, some blank or of another level."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = rows.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ")).alias("i", "text"))
    s = lambda x: x.cast("string")
    line = F.floor(c("i") / 8)
    return rows.select(
        "conv_id", (c("turn") * 100000 + c("i")).alias("pos"), F.when(c("i") % 11 == 10, "4").otherwise("5").alias("level"), F.lit("1").alias("page_num"), s(c("turn")).alias("block_num"), F.lit("1").alias("par_num"), s(line).alias("line_num"),
        s(10 + c("i") % 8 * 60).alias("left"), s(20 + line * 30 + c("i") % 3).alias("top"), F.lit("50").alias("width"), F.lit("20").alias("height"), s(c("i") % 13 * 10 - 5).alias("conf"), "text",
    )


_WORDS = f"""WITH w AS (SELECT conv_id, turn, unnest(ws) AS text, unnest(range(len(ws))) AS i FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS ws FROM conversations)),
l AS (SELECT conv_id, turn, i // 8 AS line, min(i) AS f, min(10 + i % 8 * 60) AS x0, min(20 + i // 8 * 30 + i % 3) AS y0, max(60 + i % 8 * 60) AS x1, max(40 + i // 8 * 30 + i % 3) AS y1,
 avg(greatest(0, least(100, i % 13 * 10 - 5))::double) / 100 AS confidence, string_agg({_STRIP % "text"}, ' ' ORDER BY i) AS text FROM w WHERE i % 11 <> 10 AND {_STRIP % "text"} <> '' GROUP BY ALL)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, f) - 1 AS INT) AS reading_order, text, x0, y0, x1, y1, confidence FROM l"""


def _lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("i", "text"))


_LINES = "WITH ln AS (SELECT doc_id, unnest(ls) AS text, CAST(unnest(range(len(ls))) AS INT) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"


def _polygons(spark, sf_dir):
    x, y = (c("i") % 3 * 300).cast("double") + 0.5, (F.floor(c("i") / 3) * 20).cast("double") - 0.25
    poly = F.array(F.array(x, y), F.array(x + 250, y + 1), F.array(x + 250, y + 15), F.array(x, y + 14))
    rows = _lines(spark, sf_dir).select("doc_id", F.struct(-c("i"), c("text").alias("t"), (F.lit(0.5) + c("i") % 5 / 10.0).alias("s"), poly.alias("p")).alias("r"))
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    pick = lambda n: F.transform("r", lambda x: x[n])
    results = rows.select("doc_id", F.lit(800).alias("width"), F.lit(1000).alias("height"), pick("t").alias("rec_texts"), pick("s").alias("rec_scores"), pick("p").alias("rec_polys"))
    return S.polygon_blocks(results, ["doc_id"])


_POLY = f"""{_LINES}, b AS (SELECT doc_id, i, text, 0.5::double + i % 5 / 10.0::double AS confidence, least(800, i % 3 * 300) AS x0, least(1000, greatest(0, i // 3 * 20 - 1)) AS y0, least(800, i % 3 * 300 + 251) AS x1, least(1000, i // 3 * 20 + 15) AS y1 FROM ln)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, i DESC) - 1 AS INT) AS reading_order, text, confidence, x0, y0, x1, y1 FROM b"""


def _respaced(spark, sf_dir):
    lines = _lines(spark, sf_dir).where(F.trim("text") != "")
    blocks = lines.select("doc_id", c("i").alias("reading_order"), F.replace("text", F.lit(" "), F.lit("")).alias("text"))
    native = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n\n").alias("native"))
    return S.respaced(blocks, native, ["doc_id"])


def _rects(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    y = F.lit(780.0) - c("i") * 14.5
    return rows.select("doc_id", (F.floor(c("i") / 40) + 1).alias("page"), c("i").alias("pos"), "text", F.lit(50.0).alias("l"), y.alias("b"), (50.0 + 3.7 * F.length("text")).alias("r"), (y + 11).alias("t"), F.lit(595.0).alias("page_w"), F.lit(842.0).alias("page_h"))


_RECT = f"""{_LINES}, r AS (SELECT doc_id, i // 40 + 1 AS page, i AS pos, text, 780.0::double - i * 14.5::double AS b, 50.0::double + 3.7::double * length(text) AS r, {_STRIP % "text"} AS t FROM ln),
s AS (SELECT *, sum(length(t)) OVER (PARTITION BY doc_id, page) AS chars FROM r),
x AS (SELECT doc_id, page, pos, text, t, chars, 2479 AS width, 3508 AS height, CAST(greatest(0, least(2479, round_even(50.0::double * (300 / 72::double), 0))) AS INT) AS x0, CAST(greatest(0, least(3508, round_even((842.0::double - (b + 11)) * (300 / 72::double), 0))) AS INT) AS y0,
 CAST(greatest(0, least(2479, round_even(r * (300 / 72::double), 0))) AS INT) AS x1, CAST(greatest(0, least(3508, round_even((842.0::double - b) * (300 / 72::double), 0))) AS INT) AS y1 FROM s)"""


def _profile(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", c("i").alias("x"), (F.length("text") % 10).alias("dark"))


_RUNS = f"""{_LINES}, p AS (SELECT doc_id, i, length(text) % 10 AS dark, min(length(text) % 10) OVER (PARTITION BY doc_id) AS low FROM ln), q AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM p WHERE dark <= low + 3),
r AS (SELECT doc_id, min(i) AS a, max(i) AS b FROM q GROUP BY doc_id, g) SELECT doc_id, CAST((a + b) // 2 AS INT) AS gutter FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b - a DESC, a) AS k FROM r) WHERE k = 1"""


def _rows_profile(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", (c("i") * 3).alias("y"), (F.length("text") % 50).alias("dark"), F.lit(100).alias("width"), F.lit(200).alias("height"))


_TITLE = f"""{_LINES}, p AS (SELECT doc_id, i * 3 AS y FROM ln WHERE i * 3 >= 200 * 0.075::double AND i * 3 < 50 AND length(text) % 50 >= 10 AND length(text) % 50 < 40), g AS (SELECT *, lag(y) OVER (PARTITION BY doc_id ORDER BY y) AS b FROM p),
m AS (SELECT doc_id, min((b, y)) AS k FROM (SELECT doc_id, b, y FROM g WHERE y - b > 5 AND b < 32) GROUP BY doc_id) SELECT doc_id, CAST(coalesce((k[1] + k[2]) // 2, 15) AS INT) AS bottom FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN m USING (doc_id)"""


def _crops(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("doc_id", c("i").cast("string").alias("id"), F.when(c("i") % 4 == 0, F.concat(F.lit("�"), c("text"))).otherwise(c("text")).alias("text"), F.lit(0.9).alias("confidence"))
    line = lambda k, t, x: F.struct(F.lit(k).alias("pos"), F.lit(t).alias("text"), F.lit(x).alias("confidence"))
    crops = rows.where("cast(id as int) % 8 = 0").select("doc_id", "id", F.explode(F.array(line(1, " second", 0.7), line(0, "first", 0.8), line(2, " ", 0.1))).alias("x")).select("doc_id", "id", "x.*")
    return S.patched(rows, crops, ["doc_id"])


def _moved(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("doc_id", (c("i") % 3).alias("region"), F.concat(F.lit("b"), c("i").cast("string")).alias("id"), c("i").alias("reading_order"), F.lit(5).alias("x0"), c("i").alias("y0"), F.lit(95).alias("x1"), (c("i") + 10).alias("y1"))
    regions = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("region"))
    return S.in_page(rows, regions.withColumns({"left": c("region") * 100, "top": 45 + c("region")}), ["doc_id"])


def _spine(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(c("source").alias("book_id"), "doc_id")
    name = F.concat(F.lit("c"), c("doc_id").cast("string"))
    manifest = docs.select("book_id", name.alias("id"), F.concat(name, F.lit(".xhtml")).alias("path"), F.when(c("doc_id") % 3 == 0, "image/png").otherwise(A.XHTML).alias("media"))
    spine = docs.select("book_id", c("doc_id").alias("ord"), name.alias("idref"))
    return S.spine_documents(spine, manifest, manifest.where("path not like '%7.xhtml'").select("book_id", "path"))


def paragraphs(spark, sf_dir):
    """The listening paragraphs of the books of documents, numbered; short ones are headings."""
    blocks = B.document_blocks(spark, sf_dir)
    rows = L.simple_paragraphs(blocks, L.margins(blocks)).where("not stray")
    order = F.row_number().over(L.Window.partitionBy("book_id").orderBy("page", "first"))
    return rows.select("book_id", order.alias("ord"), "text", F.when(F.length("text") <= 20, "heading").otherwise("body").alias("kind"), F.lit(0).alias("heading_level"))


def books(spark, sf_dir):
    return A.package(A.fragments(paragraphs(spark, sf_dir)))


def _round_trip(spark, sf_dir):
    """Blocks of the packaged books after every fifth one is replaced and every seventh taken out."""
    own = stores.kept(spark, lambda: books(spark, sf_dir))
    plan = A.read_blocks(own).where("idx > 0 and (idx % 5 = 0 or idx % 7 = 0)").select("book_id", "document", "idx", F.when(c("idx") % 7 != 0, F.concat(F.lit("<new> & "), c("text"))).alias("after"))
    return A.read_blocks(A.write_edited(own, plan))


@F.pandas_udf(BinaryType())
def _damaged(content: pd.Series, kind: pd.Series) -> pd.Series:
    """Books' files with a damage each: 1 no ZIP file, 2 another mimetype, 3 a byte of the chapter's compressed data, 4 a member
    less, 5 one that isn't XML, 6 a byte of the mimetype, 7 a chapter with capital tags and HTML's own entities, 8 with an unknown one."""

    def one(data: bytes, k: int) -> bytes:
        if k == 1:
            return b"no book"
        book, out = zipfile.ZipFile(io.BytesIO(data)), io.BytesIO()
        if k in (3, 6):
            info, raw = book.getinfo(A.MEMBERS[3] if k == 3 else "mimetype"), bytearray(data)
            raw[info.header_offset + 30 + len(info.filename) + info.compress_size // 2] ^= 0xFF
            return bytes(raw)
        with zipfile.ZipFile(out, "w") as z:
            for info in book.infolist():
                body = book.read(info)
                if k == 2 and info.filename == "mimetype":
                    body = b"text/plain"
                if k in (4, 5) and info.filename == A.MEMBERS[2]:
                    if k == 4:
                        continue
                    body = b"<html>"
                if k in (7, 8) and info.filename == A.MEMBERS[3]:
                    body = body.replace(b"<body>", b"<body><P>&check; planted</P>" if k == 7 else b"<body><p>&nosuch;</p>")
                z.writestr(info, body)
        return out.getvalue()

    return pd.Series([one(bytes(d), k) for d, k in zip(content, kind, strict=True)])


def damaged_books(spark, sf_dir):
    """Each book with the damage that its source's number names."""
    kind = F.regexp_extract("book_id", r"(\d+)/", 1).cast("int") % 9
    return stores.kept(spark, lambda: books(spark, sf_dir).select("book_id", _damaged("content", kind).alias("content")))


def _edit_damaged(spark, sf_dir):
    """Damaged books after an edit of their first block: what can't be read stays as it was, byte for byte."""
    own = damaged_books(spark, sf_dir)
    plan = own.select(c("book_id").alias("book_id"), F.lit(A.MEMBERS[3]).alias("document"), F.lit(0).alias("idx"), F.lit("edited").alias("after"))
    new = stores.kept(spark, lambda: A.write_edited(own, plan))  # read for its bytes and for its blocks
    first = A.read_blocks(new).where("idx = 0").select("book_id", c("text").alias("first"))
    return own.join(new.withColumnRenamed("content", "new"), "book_id").join(first, "book_id", "left").select("book_id", (c("content") == c("new")).alias("same"), "first")


def _stale(own):
    """A plan with a change of every third block, and one of a block that isn't there for each of them."""
    rows = A.read_blocks(own).where("idx % 3 = 1").select("book_id", "document", F.explode(F.array("idx", c("idx") + 100000)).alias("idx"))
    return rows.withColumn("after", F.concat(F.lit("new "), c("idx").cast("string")))


def _edit_stale(spark, sf_dir):
    """Blocks after a plan of which half is stale."""
    own = stores.kept(spark, lambda: books(spark, sf_dir))
    return A.read_blocks(A.write_edited(own, stores.kept(spark, lambda: _stale(own))))


def _unknown(spark, sf_dir):
    own = stores.kept(spark, lambda: books(spark, sf_dir))
    return A.unknown_changes(own, stores.kept(spark, lambda: _stale(own)))


def _source(spark, sf_dir):
    """The books' blocks after they were published as files and read by the data source, each split by its documents."""
    book_format.register(spark)
    path = stores.shared_path(spark, "books")
    books(spark, sf_dir).write.format("book").mode("append").save(path)
    return spark.read.format("book").option("split", 1).load(path)


def page_images(spark, sf_dir):
    """Each document as an image of 60 by 80: its characters' codes, again and again, with a light gutter and a gap under a title."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "x")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(text, F.lit("x")).alias("t"))

    # the text is repeated to the image's length and cut into rows once, so neither a pixel nor a row walks the text
    docs = docs.select("doc_id", F.regexp_extract_all(F.rpad("t", 4800, F.col("t")), F.lit(".{60}"), F.lit(0)).alias("rows"))
    gutter = F.greatest(F.lit(0), c("doc_id") % 6).cast("int")

    def row(own, y):
        parted = F.concat(F.substring(own, 1, 27), F.repeat(F.lit("x"), gutter), F.substring(own, gutter + 28, F.lit(60)))
        return F.when(y.between(9, 8 + c("doc_id") % 5), "x" * 60).when(y >= 20, parted).otherwise(own)

    pixels = F.array_join(F.transform("rows", row), "").cast("binary")
    return docs.select("doc_id", F.lit(60).alias("width"), F.lit(80).alias("height"), pixels.alias("pixels"))


#: Characters below @ are dark: blanks, digits, punctuation.
_INK = 64
_PIXELS = """WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', 'x', 'g') || 'x' AS t FROM documents), q AS (SELECT doc_id, t, CAST(unnest(range(4800)) AS INT) AS i FROM d),
px AS (SELECT doc_id, i % 60 AS x, i // 60 AS y, NOT ((i // 60 >= 20 AND i % 60 BETWEEN 27 AND 26 + doc_id % 6) OR i // 60 BETWEEN 9 AND 8 + doc_id % 5) AND ascii(substr(t, CAST(i % length(t) + 1 AS BIGINT), 1)) < 64 AS dark FROM q),
rw AS (SELECT doc_id, y FROM px WHERE y >= 6 AND y < 20 GROUP BY ALL HAVING count(*) FILTER (WHERE dark) >= 10 AND count(*) FILTER (WHERE dark) < 24),
gp AS (SELECT doc_id, y, lag(y) OVER (PARTITION BY doc_id ORDER BY y) AS b FROM rw), tp AS (SELECT doc_id, min((b, y)) AS k FROM gp WHERE y - b > 2 AND b < 12.8 GROUP BY doc_id),
cl AS (SELECT doc_id, x, count(*) FILTER (WHERE dark) AS n FROM px WHERE x >= 25 AND x < 34 AND y >= 20 AND y < 68 AND y % 2 = 0 GROUP BY ALL), lt AS (SELECT * FROM cl QUALIFY n <= min(n) OVER (PARTITION BY doc_id) + 3),
rn AS (SELECT doc_id, x, x - row_number() OVER (PARTITION BY doc_id ORDER BY x) AS g FROM lt), rs AS (SELECT doc_id, min(x) AS a, max(x) AS b FROM rn GROUP BY doc_id, g), gt AS (SELECT doc_id, (a + b) // 2 AS gutter FROM rs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY b - a DESC, a) = 1),
sp AS (SELECT doc_id, coalesce((k[1] + k[2]) // 2, 6) AS split, gutter FROM d LEFT JOIN tp USING (doc_id) LEFT JOIN gt USING (doc_id))"""


_PARAS = f"{_SIMPLE}, ps AS (SELECT book_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY page, first) AS INT) AS ord, text FROM simple WHERE NOT stray)"
_ESC = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_READ = f"{_PARAS}, rb AS (SELECT book_id, 'OEBPS/chapter.xhtml' AS document, ord AS idx, array_to_string(list_filter(string_split_regex(text, '[\\x{{09}}-\\x{{0d}}\\x{{1c}}-\\x{{20}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+'), lambda x: x <> ''), ' ') AS text FROM ps UNION ALL SELECT DISTINCT book_id, 'OEBPS/chapter.xhtml', 0, book_id FROM ps)"

_JUNK = junk_sql("p")

QUERIES = {
    "parse_tsv": lambda s, d: S.lines_of_words(words(s, d), ["conv_id"]),
    "polygon_blocks": _polygons,
    "native_spacing": _respaced,
    "text_layer_blocks": lambda s, d: S.text_layer(_rects(s, d), ["doc_id", "page"]),
    "text_layer_summary": lambda s, d: S.layer_summary(_rects(s, d), "doc_id", "page"),
    "dark_runs": lambda s, d: S.gutters(_profile(s, d), ["doc_id"]),
    "title_bottom": lambda s, d: S.title_bottoms(_rows_profile(s, d), ["doc_id"]),
    "crop_patches": _crops,
    "column_offsets": _moved,
    "spine_documents": _spine,
    "fingerprints": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", S.fingerprint(F.coalesce("html", F.lit("")).cast("binary")).alias("sha256"), S.book_title(F.lit(" "), c("url")).alias("title")),
    "book_fragments": lambda s, d: A.fragments(paragraphs(s, d)),
    "package_book": lambda s, d: books(s, d).select("book_id", F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes")),
    "structure_valid": lambda s, d: damaged_books(s, d).select("book_id", A.problem("content").alias("problem")),
    "read_damaged_books": lambda s, d: A.read_blocks(damaged_books(s, d)),
    "edit_damaged_books": _edit_damaged,
    "edit_with_stale_indexes": _edit_stale,
    "unknown_changes": _unknown,
    "books_source": _source,
    "page_splits": lambda s, d: I.splits(page_images(s, d), ["doc_id"], _INK),
    "page_regions": lambda s, d: I.regions(page_images(s, d), ["doc_id"], _INK),
    "read_blocks": lambda s, d: A.read_blocks(books(s, d)),
    "edit_round_trip": _round_trip,
    "junk_free_markup": lambda s, d: A.junk_free(s.read.parquet(f"{d}/pages.parquet").select("page_id", "html"), c("html")).select("page_id", "n", "p"),
}

ORACLE_SQL = {
    "parse_tsv": _WORDS,
    "polygon_blocks": _POLY,
    "native_spacing": f"{_LINES} SELECT doc_id, i AS reading_order, {_STRIP % 'text'} AS text FROM ln WHERE trim(text) <> ''",
    "text_layer_blocks": f"{_RECT} SELECT doc_id, page, pos, text, width, height, x0, y0, x1, y1, 1.0::double AS confidence FROM x WHERE chars >= 20 AND t <> '' AND x1 > x0 AND y1 > y0",
    "text_layer_summary": f"{_RECT} SELECT doc_id, count(*) AS page_count, count(*) FILTER (WHERE chars >= 20) AS pages_with_text_layer FROM (SELECT doc_id, page, max(chars) AS chars FROM s GROUP BY ALL) GROUP BY doc_id",
    "dark_runs": _RUNS,
    "title_bottom": _TITLE,
    "crop_patches": f"{_LINES} SELECT doc_id, CAST(i AS VARCHAR) AS id, CASE WHEN i % 8 = 0 THEN 'first second' WHEN i % 4 = 0 THEN chr(65533) || text ELSE text END AS text, CASE WHEN i % 8 = 0 THEN 0.7 ELSE 0.9 END::double AS confidence FROM ln",
    "column_offsets": f"{_LINES} SELECT doc_id, i % 3 AS region, 'region-' || i % 3 || ':b' || i AS id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i % 3, i) - 1 AS INT) AS reading_order, 5 + i % 3 * 100 AS x0, i + 45 + i % 3 AS y0, 95 + i % 3 * 100 AS x1, i + 55 + i % 3 AS y1 FROM ln",
    "spine_documents": "SELECT source AS book_id, doc_id AS ord, 'c' || doc_id || '.xhtml' AS path FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 10 <> 7",
    "fingerprints": "SELECT page_id, sha256(coalesce(html, '')) AS sha256, regexp_replace(string_split(url, '/')[-1], '(.)\\.[^.]*$', '\\1') AS title FROM pages",
    "book_fragments": f"{_PARAS} SELECT book_id, ord - 1 AS n, length(text) <= 20 AS heading, {_ESC} AS label, CASE WHEN length(text) <= 20 THEN '<h2 id=\"heading-' || (ord - 1) || '\">' || {_ESC} || '</h2>' ELSE '<p>' || {_ESC} || '</p>' END AS xhtml FROM ps",
    "structure_valid": f"""WITH {B.BLOCKS_SQL}, bk AS (SELECT DISTINCT book_id, CAST(regexp_extract(book_id, '(\\d+)/', 1) AS INT) % 9 AS kind FROM blocks)
SELECT book_id, CASE kind WHEN 1 THEN 'not a ZIP file' WHEN 2 THEN 'mimetype' WHEN 3 THEN 'damaged: OEBPS/chapter.xhtml' WHEN 4 THEN 'missing: OEBPS/nav.xhtml' WHEN 5 THEN 'not XML: OEBPS/nav.xhtml' WHEN 6 THEN 'mimetype'
 WHEN 7 THEN 'not XML: OEBPS/chapter.xhtml' WHEN 8 THEN 'not XML: OEBPS/chapter.xhtml' END AS problem FROM bk""",
    "read_damaged_books": f"""{_READ}, kd AS (SELECT *, CAST(regexp_extract(book_id, '(\\d+)/', 1) AS INT) % 9 AS kind FROM rb)
SELECT book_id, document, idx + CASE WHEN kind = 7 THEN 1 ELSE 0 END AS idx, text FROM kd WHERE kind NOT IN (1, 3, 8) UNION ALL SELECT DISTINCT book_id, document, 0, chr(10003) || ' planted' FROM kd WHERE kind = 7""",
    "edit_damaged_books": f"""{_READ}, kd AS (SELECT DISTINCT book_id, CAST(regexp_extract(book_id, '(\\d+)/', 1) AS INT) % 9 AS kind FROM rb) SELECT book_id, kind IN (1, 3, 8) AS same, CASE WHEN kind NOT IN (1, 3, 8) THEN 'edited' END AS first FROM kd""",
    "junk_free_markup": f"""WITH m AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?s)<p[^>]*>(.*?)</p>', 1) AS ps FROM pages), u AS (SELECT page_id, CAST(unnest(range(len(ps))) AS INT) AS n, unnest(ps) AS p FROM m) SELECT page_id, n, p FROM u WHERE NOT {_JUNK}""",
    "edit_with_stale_indexes": f"{_READ} SELECT book_id, document, idx, CASE WHEN idx % 3 = 1 THEN 'new ' || idx ELSE text END AS text FROM rb",
    "unknown_changes": f"{_READ} SELECT book_id, document, CAST(idx + 100000 AS INT) AS idx, 'new ' || (idx + 100000) AS after FROM rb WHERE idx % 3 = 1",
    "books_source": f"{_READ} SELECT * FROM rb",
    "page_splits": f"{_PIXELS} SELECT doc_id, CAST(split AS INT) AS bottom, CAST(gutter AS INT) AS gutter FROM sp",
    "page_regions": f"{_PIXELS} SELECT doc_id, CASE WHEN y < split THEN 0 WHEN x < gutter THEN 1 ELSE 2 END AS region, CAST(min(x) AS INT) AS left, CAST(min(y) AS INT) AS top, CAST(max(x) + 1 AS INT) AS right, CAST(max(y) + 1 AS INT) AS bottom FROM px JOIN sp USING (doc_id) WHERE dark GROUP BY ALL",
    "read_blocks": f"{_READ} SELECT * FROM rb",
    "edit_round_trip": f"{_READ} SELECT book_id, document, CAST(row_number() OVER (PARTITION BY book_id ORDER BY idx) - 1 AS INT) AS idx, CASE WHEN idx > 0 AND idx % 5 = 0 THEN '<new> & ' || text ELSE text END AS text FROM rb WHERE idx = 0 OR idx % 7 <> 0",
}
