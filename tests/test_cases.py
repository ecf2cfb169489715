"""Literal cases of single operators."""

import zipfile
from io import BytesIO

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import budget as U
from folioflow.operators import layout as L
from folioflow.operators import notes as N
from folioflow.operators import review as R
from folioflow.sources import archive as A
from folioflow.sources import blocks as B
from folioflow.sources import recognised as S
from folioflow.streaming import arrivals

BOX = "book_id string, page int, width int, height int, pos int, id string, text string, x0 int, y0 int, x1 int, y1 int, confidence double, reading_order int, type string"


def page(spark, rows, size=(1000, 1000)):
    """rows: (page, id, text, (x0, y0, x1, y1), type)."""
    made = [("b", p, *(s[0] if (s := rest[1:]) else size), k, i, t, *box, 1.0, k, rest[0] if rest else "line") for k, (p, i, t, box, *rest) in enumerate(rows)]
    return spark.createDataFrame(made, BOX)


def column(spark, f, texts):
    return [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(f(F.col("t"))).collect()]


@pytest.mark.parametrize(("text", "wanted"), [
    ("나무(표3:1)", "나무"), ("갔다(가) 또(나) 왔다.", "갔다 또 왔다."), ("겹친(하나(둘)셋) 글", "겹친 글"), ("넓은（괄호）글", "넓은글"), ("(모두 괄호)", ""), ("열림( 안", "열림( 안"), ("글이 끝났다 (보기).", "글이 끝났다."),
])
def test_remove_parenthetical(spark, text, wanted):
    assert column(spark, T.remove_parenthetical, [text]) == [wanted]


def test_spacing_takes_only_spaces_between_hangul(spark):
    pair = spark.createDataFrame([("바다노래를듣는다", "바다 노래를 듣는다"), ("바다노래", "바다 노러"), ("바다노래 Ann Lee (쪽 7:2)", "바다 노래 AnnLee(쪽7:2)")], "t string, p string")
    assert [r[0] for r in pair.select(T.correct_spacing(F.col("t"), F.col("p"))).collect()] == ["바다 노래를 듣는다", "바다노래", "바다 노래 Ann Lee (쪽 7:2)"]


def test_corruption_and_figures(spark):
    assert column(spark, T.is_corrupt, ["a�", "ㄱ", "", "\U000f0001", "정상 Text"]) == [True, True, True, True, False]
    assert column(spark, T.is_figure_residue, ["R ←", "P ∠", "K", "푸른 언덕", "맞는다."]) == [True, True, True, False, False]


def heads(spark, texts, y=(30, 45), pages=None, height=1000):
    return page(spark, [(p, "m", t, (760 if p % 2 else 600, y[0], 900, y[1])) for p, t in zip(pages or range(1, len(texts) + 1), texts, strict=True)], (800, height))


def test_margins(spark):
    ids = lambda b: sorted((r.page, r.id) for r in L.margins(b).collect())
    assert ids(heads(spark, ["같은 머리"] * 4)) == [(k, "m") for k in range(1, 5)]
    assert ids(heads(spark, ["같은 머리"] * 2)) == []
    assert ids(heads(spark, ["같은 머리"] * 3, pages=[1, 20, 40])) == []
    assert len(ids(heads(spark, [f"여는 말{n}" for n in range(9, 20)], pages=list(range(9, 20))))) == 11
    changing = heads(spark, [f"{chr(0xAC00 + n * 588)}제목{n - 1}" for n in range(1, 20)], (940, 955))
    assert len(ids(changing)) == 19
    assert ids(heads(spark, ["보기(표7:1)"] * 2, pages=[5, 6])) == []


def lines(spark, rows):
    return page(spark, [(1, f"l{k}", t, (x, y, x1, y + h), kind) for k, (t, y, x, x1, h, kind) in enumerate((*r, 100, 800, 20, "line")[: len(r)] + (100, 800, 20, "line")[len(r) - 2 :] for r in rows)])


def texts(df):
    return [r.text for r in df.where("not stray").orderBy("page", "first").collect()]


def test_simple_paragraphs(spark):
    none = page(spark, []).select("book_id", "page", "id")
    simple = lambda rows: texts(L.simple_paragraphs(lines(spark, rows), none))
    assert simple([("12", 10), ("2024", 200), ("- 13 -", 950)]) == ["2024"]
    assert simple([("가나다", 200), ("라마바", 225), ("사아자", 290)]) == ["가나다 라마바", "사아자"]
    assert simple([("표제", 100, 100, 800, 20, "heading"), ("본문", 125), ("들여쓰기", 150, 140)]) == ["표제", "본문", "들여쓰기"]
    assert simple([("77", 910)]) == []
    assert simple([("3장", 300), ("IV", 400)]) == ["3장", "IV"]
    assert simple([("본문입니다", 200), (";", 300, 100, 112, 15)]) == ["본문입니다"]
    assert simple([("본문입니다", 200), ("8", 300, 100, 104, 4)]) == ["본문입니다"]


def test_visual_lines_grow_with_their_runs(spark):
    runs = [("text-0", "그", (100, 200, 120, 220)), ("text-1", "집 은", (145, 200, 205, 220)), ("text-2", "크다", (230, 200, 280, 220)), ("text-3", ".", (281, 214, 285, 220)), ("text-4", "아래 줄이다.", (100, 225, 285, 245))]
    found = N.visual_lines(page(spark, [(1, i, t, b) for i, t, b in runs])).orderBy("line").collect()
    assert [r.text for r in found] == ["그 집 은 크다.", "아래 줄이다."]
    assert found[0].ids == ["text-0", "text-1", "text-2", "text-3"]
    apart = N.visual_lines(page(spark, [(1, "text-0", "왼쪽", (80, 200, 250, 220)), (1, "text-1", "오른쪽", (650, 200, 850, 220))]))
    assert apart.count() == 2


def test_a_text_layer_is_reconstructed_with_all_its_runs(spark):
    runs = [("text-0", "그", (100, 200, 120, 220)), ("text-1", "집은", (145, 200, 205, 220)), ("text-2", "크다.", (230, 200, 280, 220)), ("text-3", "아래 줄이다.", (100, 225, 285, 245))]
    blocks = page(spark, [(1, i, t, b) for i, t, b in runs])
    lines = L.line_features(N.visual_lines(L.body_lines(blocks, page(spark, []).select("book_id", "page", "id"))))
    found = L.reconstruct(lines, L.body_size(blocks)).collect()
    assert [(r.text, [s.block_id for s in r.sources], r.lone) for r in found] == [("그 집은 크다. 아래 줄이다.", [f"text-{k}" for k in range(4)], False)]
    apart = page(spark, [(1, "text-0", "왼쪽 글", (80, 200, 250, 220)), (1, "text-1", "오른쪽 글", (650, 200, 850, 220))])
    assert L.reconstruct(L.line_features(N.visual_lines(apart)), L.body_size(apart)).count() == 2


def test_lines_go_on_over_arrow_batches(spark):
    rows = [(p, f"text-{k}", f"w{k}", (100 + 40 * k, 200, 130 + 40 * k, 220)) for p in range(1, 8) for k in range(9)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        found = N.visual_lines(page(spark, rows).coalesce(1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted(r.page for r in found) == list(range(1, 8)) and {r.text for r in found} == {" ".join(f"w{k}" for k in range(9))}


def test_full_width_digits(spark):
    assert column(spark, T.ascii_digits, ["１２a", "٣"]) == ["12a", "3"]
    feet = heads(spark, [f"{chr(0xAC00 + n * 588)}장{''.join(chr(0xFF10 + int(d)) for d in str(n))}" for n in range(1, 8)], (940, 955))
    assert L.margins(feet).count() == 7
    numbers = page(spark, [(1, "a", "１２", (0, 10, 20, 20)), (1, "b", "-　７　-", (0, 960, 20, 970))])
    assert sorted(r.id for r in numbers.where(L.page_number()).collect()) == ["a", "b"]


def recon(spark, rows):
    blocks = page(spark, rows)
    none = page(spark, []).select("book_id", "page", "id")
    return L.merge_by_context(L.reconstruct(L.line_features(L.body_lines(blocks, none)), L.body_size(blocks))).orderBy("ord").collect()


def test_reconstruction_goes_on_over_pages(spark):
    across = [(1, "a", "문장이 이어지고", (100, 900, 800, 920)), (2, "b", "계속됩니다.", (100, 100, 800, 120))]
    found = recon(spark, across)
    assert [r.text for r in found] == ["문장이 이어지고 계속됩니다."]
    assert [tuple(s) for s in found[0].sources] == [(1, "a"), (2, "b")]
    assert len(recon(spark, [(1, "a", "끝났다.", (100, 900, 800, 920)), (2, "b", "새로 시작", (100, 100, 800, 120))])) == 2
    listed = [(1, "a", "첫 줄", (100, 200, 800, 220)), (1, "b", "이어짐", (100, 225, 800, 245)), (1, "c", "새 문단", (140, 250, 800, 270)), (1, "d", "1. 항목", (100, 275, 800, 295))]
    assert [r.text for r in recon(spark, listed)] == ["첫 줄 이어짐", "새 문단", "1. 항목"]


def test_context_joins_dependent_paragraphs(spark):
    pairs = spark.createDataFrame([("오래된 마을의", "골목을 걷는다."), ("끝났다.", "새 문단"), ("열림 (", "닫힘"), ("", "x")], "l string, r string")
    assert [r[0] for r in pairs.select(L.joins(F.col("l"), F.col("r"))).collect()] == [True, False, True, False]


def test_footnotes_and_references(spark):
    body = [(1, f"l{k}", "본문의 한 줄입니다", (100, 200 + 30 * k, 700 if k == 5 else 800, 225 + 30 * k)) for k in range(6)]
    extra = [(1, "ref", "18", (696, 349, 710, 362)), (1, "far", "18", (500, 300, 510, 313)), (1, "other", "19", (696, 352, 710, 365)), (1, "note", "18) 주석의 내용", (100, 800, 800, 818))]
    blocks = page(spark, body + extra)
    notes = N.footnotes(blocks)
    assert [r.id for r in notes.collect()] == ["note"]
    assert [r.id for r in N.superscripts(blocks, notes).collect()] == ["ref"]
    assert N.footnotes(page(spark, body)).count() == 0


def test_an_analysers_tags_join_paragraphs(spark):
    rows = [("앞 글", "뒤 글", "ETM", "NNG"), ("앞 글", "뒤 글", "NNG", "XSV"), ("앞 글", "뒤 글", "NNG", "NNG"), ("끝났다.", "뒤 글", "ETM", "XSV"), ("앞 글", "뒤 글", None, None)]
    pairs = spark.createDataFrame(rows, "l string, r string, a string, b string")
    assert [r[0] for r in pairs.select(L.joins(F.col("l"), F.col("r"), (F.col("a"), F.col("b")))).collect()] == [True, True, False, False, False]
    tags = lambda left, right: L.joins(left, right, (F.when(left.endswith("읽을"), "ETM"), F.lit(None).cast("string")))
    found = L.merge_by_context(spark.createDataFrame([("b", k, t, "body", [(1, f"l{k}")]) for k, t in enumerate(["내가 읽을", "책", "탁자"])], "book_id string, ord int, text string, kind string, sources array<struct<page:int,block_id:string>>"), tags)
    assert sorted(r.text for r in found.collect()) == ["내가 읽을 책", "탁자"]


def test_recognisers_are_passed_in(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.png").write_bytes(b"x" * (k + 1))

    def engine(frames):
        for frame in frames:
            yield pd.DataFrame({"page": [int(p.rsplit("/", 1)[1][0]) for p in frame["path"]], "text": [f"{len(c)} bytes" for c in frame["content"]]})

    found = S.recognise(spark.read.format("binaryFile").load(str(tmp_path)), engine, "page int, text string")
    assert sorted(map(tuple, found.collect())) == [(0, "1 bytes"), (1, "2 bytes"), (2, "3 bytes")]


def note_page(body=8, note_y=780, notes=7, h=15, texts=None):
    rows = [(1, f"l{k}", "본문의 한 줄입니다", (100, 200 + 30 * k, 800, 225 + 30 * k)) for k in range(body)]
    return rows + [(1, f"n{k}", (texts or {}).get(k, "주석이 이어진다"), (100, note_y + 20 * k, 800, note_y + 20 * k + h)) for k in range(notes)]


def test_runs_of_small_type_are_notes(spark):
    ids = lambda rows: sorted(r.id for r in N.footnotes(page(spark, rows)).collect())
    assert ids(note_page()) == [f"n{k}" for k in range(7)]  # set off by a gap, to the page's foot
    assert ids(note_page(notes=3)) == []  # ends above the foot
    assert ids(note_page(notes=3, texts={0: "1. 첫 주석"})) == ["n0", "n1", "n2"]
    assert ids(note_page(notes=1, note_y=850, texts={0: "* 별표 주석"})) == ["n0"]
    assert ids(note_page(notes=2, h=25, texts={0: "3) 같은 크기"})) == []
    assert ids(note_page(body=0)) == []
    assert ids(note_page(texts={0: "１２）x", 1: "１２) 넓은 숫자"}, notes=3)) == ["n1", "n2"]
    headed = note_page(notes=3, texts={0: "1. 첫 주석"})
    headed[-2] = (*headed[-2], "heading")
    assert ids(headed) == ["n0"]  # a heading ends the run


def test_paragraphs_without_notes_and_references(spark):
    rows = note_page(notes=2, texts={0: "18) 주석의 내용", 1: "이어진다"})
    rows.insert(8, (1, "ref", "18", (796, 409, 810, 422)))
    blocks = page(spark, rows)
    removed = N.note_ids(blocks)
    assert sorted(r.id for r in removed.collect()) == ["n0", "n1", "ref"]
    found = L.simple_paragraphs(blocks, removed).collect()
    assert len(found) == 1 and found[0].ids == [f"l{k}" for k in range(8)]
    assert L.removed_ids(blocks, removed).first().ids == "ref,n0,n1"


def test_edits_and_glosses(spark):
    e = "array<struct<before:string,after:string,confidence:double>>"
    long = "이것은 아주 긴 문장으로서 글자 하나를 고쳐도 비율이 크게 달라지지 않습니다 정말로"
    rows = spark.createDataFrame([(long, [("문장으로서", "문장으로써", 0.95)]), (long, [("문장으로서", "문장으로써", 0.5)]), ("짧은 글", [("짧은", "긴", 0.99)]), (long, None)], f"t string, e {e}")
    assert [r[0] for r in rows.select(R.apply_edits("t", "e")).collect()] == [long.replace("으로서", "으로써"), long, "짧은 글", long]
    g = spark.createDataFrame([("이 나무는 소나무(솔)라고 불리는 것이다", ["(솔)"]), ("짧다(아주길다)", ["(아주길다)"]), ("가가 나나", ["가"])], "t string, s array<string>")
    assert [r[0] for r in g.select(R.apply_glosses(F.col("t"), F.col("s"))).collect()] == ["이 나무는 소나무라고 불리는 것이다", "짧다(아주길다)", "가가 나나"]


def test_usage_parts_sum_exactly(spark):
    calls = spark.createDataFrame([(101, 21, 11, ["spacing", "glosses", "spacing"])], "input long, output long, cached long, features array<string>")
    found = U.split_usage(calls).orderBy("feature").collect()
    assert [sum(r[f"{c}_part"] for r in found) for c in ("input", "output", "cached")] == [101, 21, 11] and len(found) == 2


def test_budget_is_sticky(spark):
    calls = spark.createDataFrame([("b", 1, 0.3), ("b", 2, 0.5), ("b", 3, 0.4), ("b", 4, 0.1)], "k string, n int, worst double")
    assert [r.admitted for r in U.admitted(calls, "k", ["n"], 0.8).orderBy("n").collect()] == [True, True, False, False]
    assert [r.admitted for r in U.admitted(calls, "k", ["n"], 0.0).orderBy("n").collect()] == [False] * 4
    assert all(r.admitted for r in U.admitted(calls, "k", ["n"], None).collect())


def test_budget_gives_back_what_is_left(spark):
    calls = spark.createDataFrame([("b", n, 0.5, 0.1) for n in range(1, 7)], "k string, n int, worst double, cost double")
    ask = lambda flight: [r.admitted for r in U.admitted(calls, "k", ["n"], 0.8, "cost", flight).orderBy("n").collect()]
    assert ask(0) == [True] * 4 + [False] * 2
    assert ask(1) == [True] + [False] * 5


def test_durations(spark):
    rows = spark.createDataFrame([(0.4,), (61.0,), (3725.9,), (-3.0,)], "s double")
    assert [r[0] for r in rows.select(U.duration_text(F.col("s"))).collect()] == ["0:00", "1:01", "1:02:05", "0:00"]


def test_names():
    assert U.checked_name(2, "books", "test") == "002_books_test.epub"
    for stem in ("", "../x", "CON", "a|b"):
        with pytest.raises(ValueError):
            U.checked_name(1, "books", stem)


def test_books_round_trip(spark):
    rows = spark.createDataFrame([("책", 1, "첫 장", "heading", 0), ("책", 2, "한 문단 <&>이다.", "body", 0), ("책", 3, "R ←", "body", 0), ("책", 4, "또 한 문단이다.", "body", 0)], "book_id string, ord int, text string, kind string, heading_level int")
    books = A.package(A.fragments(rows)).cache()
    assert books.select(A.problem("content")).first()[0] is None
    read = A.read_blocks(books).orderBy("idx").collect()
    assert [r.text for r in read] == ["책", "첫 장", "한 문단 <&>이다.", "R ←", "또 한 문단이다."]
    plan = spark.createDataFrame([("책", read[0].document, 2, "고친 문단"), ("책", read[0].document, 3, None)], "book_id string, document string, idx int, after string")
    edited = A.write_edited(books, plan).cache()
    assert [r.text for r in A.read_blocks(edited).orderBy("idx").collect()] == ["책", "첫 장", "고친 문단", "또 한 문단이다."]
    old, new = (zipfile.ZipFile(BytesIO(df.first().content)) for df in (books, edited))
    assert new.namelist() == old.namelist() and all(new.read(n) == old.read(n) for n in old.namelist() if not n.endswith("chapter.xhtml"))
    bad = spark.createDataFrame([(bytearray(b"no"),)], "content binary")
    assert bad.select(A.problem("content")).first()[0] == "not a ZIP file"
    assert A.read_blocks(spark.createDataFrame([("x", bytearray(b"no"))], "book_id string, content binary")).count() == 0


def test_leaf_blocks_of_any_markup():
    root = A._parsed("<DIV>loose<P>a&check;&nbsp;b</P><div> </div><ul><LI>c <b>d</b></LI></ul><blockquote><p>e</p></blockquote></DIV>".encode())
    assert [(p.tag, e.tag, t) for p, e, t in A.leaf_blocks(root)] == [("DIV", "P", "a✓ b"), ("ul", "LI", "c d"), ("blockquote", "p", "e")]
    assert [t for *_, t in A.leaf_blocks(A._parsed(b"<p>alone</p>"))] == ["alone"]
    assert A._tried(A._parsed, b"<p>&nosuch;</p>") is None


def test_only_sound_books_are_published(spark, tmp_path):
    rows = spark.createDataFrame([(b, 1, "글", "body", 0) for b in ("가", "나")], "book_id string, ord int, text string, kind string, heading_level int")
    books = A.package(A.fragments(rows)).withColumn("content", F.when(F.col("book_id") == "나", F.lit(b"no")).otherwise(F.col("content")))
    out = str(tmp_path / "books")
    assert [(r.book_id, r.problem) for r in A.published(books, out).collect()] == [("나", "not a ZIP file")]
    assert [r.book_id for r in A.read_published(spark, out).collect()] == ["가"] and not (tmp_path / "books.pending").exists()
    with pytest.raises(FileExistsError):
        A.published(books, out)
    refuse = lambda c: F.lit("never")
    assert A.published(books, str(tmp_path / "none"), refuse).count() == 2 and A.read_published(spark, str(tmp_path / "none")).count() == 0


def test_titles_in_markup(spark):
    assert column(spark, A.markup_title, ["<metadata><dc:title>\n 바다  노래</dc:title>", "<p>x</p>"]) == ["바다 노래", None]


def test_recognised_lines(spark):
    head = "p int, level string, page_num string, block_num string, par_num string, line_num string, left string, top string, width string, height string, conf string, text string, pos int"
    rows = [(1, "5", "1", "1", "1", "1", "10", "20", "25", "10", "90", "한국어", 0), (1, "5", "1", "1", "1", "1", "40", "20", "25", "10", "80", "문장", 1), (1, "5", "1", "1", "1", "2", "10", "40", "20", "10", "-1", "둘째", 2)]
    found = S.lines_of_words(spark.createDataFrame(rows, head), ["p"]).orderBy("reading_order").collect()
    assert [(r.text, r.x0, r.y0, r.x1, r.y1, round(r.confidence, 6)) for r in found] == [("한국어 문장", 10, 20, 65, 30, 0.85), ("둘째", 10, 40, 30, 50, 0.0)]


def test_ragged_results_are_an_error(spark):
    r = spark.createDataFrame([(1, 100, 100, ["a", "b"], [0.5], [[[0.0, 0.0]]])], "p int, width int, height int, rec_texts array<string>, rec_scores array<double>, rec_polys array<array<array<double>>>")
    with pytest.raises(Exception, match="different lengths"):
        S.polygon_blocks(r, ["p"]).collect()


def test_native_text_must_fit(spark):
    b = spark.createDataFrame([(1, 0, "오 늘 은 좋은 날")], "p int, reading_order int, text string")
    good = spark.createDataFrame([(1, "오늘은 좋은 날")], "p int, native string")
    assert S.respaced(b, good, ["p"]).first().text == "오늘은 좋은 날"
    with pytest.raises(Exception, match="fit"):
        S.respaced(b, spark.createDataFrame([(1, "오늘은\n좋은 날")], "p int, native string"), ["p"]).collect()


def test_pages_are_stored_once(spark, tmp_path):
    page_json = lambda text: '{"book_id":"b","page":1,"width":10,"height":10,"blocks":[{"id":"a","text":"%s","bbox":[0,0,1,1],"confidence":1.0,"reading_order":0,"type":"line"}]}' % text  # noqa: E731, UP031
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    for k, text in enumerate(("first", "later")):
        (source / f"{k}.json").write_text(page_json(text))
        arrivals.store_arriving(spark, str(source), store, str(tmp_path / "state")).awaitTermination()
    found = B.explode_pages(spark.read.schema(arrivals.SCHEMA).parquet(store)).collect()
    assert [r.text for r in found] == ["first"]
    assert len(list((tmp_path / "store").glob("bucket=*"))) == 1 and arrivals.stored_book(spark, store, "b").count() == 1 and arrivals.stored_book(spark, store, "c").count() == 0


def test_ranges_and_validation(spark):
    blocks = page(spark, [(1, "a", "x", (0, 0, 5, 5)), (2, "b", "y", (5, 0, 2, 5))])
    assert B.in_range(blocks, 1, 1).count() == 1
    with pytest.raises(ValueError):
        B.in_range(blocks, 3, 2)
    assert [(r.id, r.problem) for r in B.violations(blocks).collect()] == [("b", "bbox")]
    with pytest.raises(Exception, match="invalid block b"):
        B.validated(blocks).collect()
