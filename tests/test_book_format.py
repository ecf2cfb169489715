"""Books as a data source: splits, commits that publish, failures that leave nothing."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.sources import archive as A
from folioflow.sources import book_format as B


def book(spark, *texts, name="b/1"):
    rows = [(name, k, "h" if k == 0 else "p", k == 0, f"<p>{t}</p>") for k, t in enumerate(texts)]
    return A.package(spark.createDataFrame(rows, "book_id string, n int, label string, heading boolean, xhtml string"))


def two_documents(content: bytes) -> bytes:
    """The book with its chapter in the spine twice, under another name too."""
    old, out = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()
    chapter = old.read(A.MEMBERS[3])
    with zipfile.ZipFile(out, "w") as new:
        for i in old.infolist():
            data = old.read(i)
            if i.filename == A.MEMBERS[1]:
                data = data.replace(b"</manifest>", b'<item id="two" href="two.xhtml" media-type="application/xhtml+xml"/></manifest>').replace(b"</spine>", b'<itemref idref="two"/></spine>')
            new.writestr(i, data)
        new.writestr("OEBPS/two.xhtml", chapter)
    return out.getvalue()


def key(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("split", [1, 1 << 20])
def test_the_source_reads_what_read_blocks_reads(spark, tmp_path, split):
    B.register(spark)
    first = bytes(book(spark, "하나", "둘").first().content)
    books = spark.createDataFrame([("b/1", first), ("글 2", two_documents(first)), ("c", b"no book")], "book_id string, content binary")
    books.where("book_id <> 'c'").repartition(2).write.format("book").mode("append").save(str(tmp_path))
    (tmp_path / "c.epub").write_bytes(b"no book")
    (tmp_path / "note.txt").write_text("x")
    found = spark.read.format("book").option("split", split).load(str(tmp_path))
    assert key(found) == key(A.read_blocks(books)) and found.where("book_id = '글 2'").select("document").distinct().count() == 2
    assert len(B.BookReader({"path": str(tmp_path), "split": str(split)}).partitions()) == (4 if split == 1 else 1)
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted([B.file_name("b/1"), B.file_name("글 2"), "c.epub", "note.txt"])


def test_a_failed_task_publishes_nothing(spark, tmp_path):
    B.register(spark)
    good = book(spark, "하나", name="good")
    good.write.format("book").mode("append").save(str(tmp_path))
    bad = spark.createDataFrame([(f"n{k}", b"no book" if k == 3 else bytes(good.first().content)) for k in range(4)], "book_id string, content binary").repartition(4)
    with pytest.raises(Exception, match="not a ZIP file"):
        bad.write.format("book").mode("append").save(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["good.epub"]
    with pytest.raises(Exception, match="one name"):
        good.union(good).write.format("book").mode("append").save(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["good.epub"]
    good.withColumn("book_id", F.lit("new")).write.format("book").mode("overwrite").save(str(tmp_path))
    assert [p.name for p in tmp_path.iterdir()] == ["new.epub"]


def test_an_empty_folder_has_no_blocks(spark, tmp_path):
    B.register(spark)
    assert spark.read.format("book").load(str(tmp_path)).count() == 0


def test_regions_of_pixels(spark):
    """A title, a gap, two columns with a gutter; a page without ink; one too narrow for columns; and one that is cut short."""
    from folioflow.sources import images as I

    page = np.full((400, 200), 255, np.uint8)
    page[32:40, 50:120] = 0  # a title of eight rows
    page[80:380, 10:90] = page[80:380, 110:190] = 0
    page[60, 0:20] = 159
    schema = "id string, width int, height int, pixels binary"
    rows = [("two", 200, 400, page.tobytes()), ("blank", 200, 400, b"\xff" * 80000), ("thin", 1, 10, bytes(10)), ("small", 200, 400, np.where(page == 159, 160, page).astype(np.uint8).tobytes())]
    images = spark.createDataFrame(rows, schema)
    split = {r.id: (r.bottom, r.gutter) for r in I.splits(images, ["id"]).collect()}
    # rows 32-39 and 60 have ink enough: the first wide gap; from row 80 on rows are too dark to be a title's
    assert split == {"two": (49, 99), "blank": (30, 99), "thin": (0, None), "small": (30, 99)}
    found = {(r.id, r.region): tuple(r)[2:] for r in I.regions(images, ["id"]).collect()}
    assert found[("two", 0)] == (50, 32, 120, 40) and found[("two", 1)] == (0, 60, 90, 380) and found[("two", 2)] == (110, 80, 190, 380)
    assert not [k for k in found if k[0] == "blank"] and found[("thin", 1)] == (0, 0, 1, 10) and len(found) == 6
    with pytest.raises(Exception, match="width times height"):
        I.splits(spark.createDataFrame([("x", 3, 3, b"1")], schema), ["id"]).collect()
