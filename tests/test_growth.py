"""Work that grows with the input and no faster: plans that have no step that doesn't, and cases that would take too long."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.llm import components
from folioflow.operators import layout as L
from folioflow.plans import books, catalogue
from folioflow.sources import archive as A


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_step_of_components_makes_a_link_of_each(spark):
    edges = [(k, j) for k in range(2, 40) for j in range(1, k, 3)] + [(100, 99)]
    pairs = spark.createDataFrame(edges, "node long, root long")
    step = components._starred(pairs)
    assert "Generate" not in plan(step)
    least = {n: min(r for m, r in edges if m == n) for n, _ in edges}
    want = {(n, least[n]) for n, _ in edges} | {(r, least[n]) for n, r in edges if r != least[n]}
    assert sorted(map(tuple, step.collect())) == sorted(want)
    found = {r["node"]: r["root"] for r in components.components(pairs.toDF("a", "b")).collect()}
    parent = {k: k for k in range(1, 101)}
    for _ in range(40):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert found == {k: v for k, v in parent.items() if k in {x for e in edges for x in e} and k != v}


def test_an_image_of_a_very_long_text_is_made_at_once(spark, tmp_path):
    texts = [(0, None), (5, "ab(1 2)" * 9), (11, "Zé7 \n" * 3), (23, "x y" * 1_500_000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    found = {r["doc_id"]: bytes(r["pixels"]).decode() for r in books.page_images(spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 15
    for k, text in texts:
        t = "".join(c if " " <= c <= "~" else "x" for c in text or "") + "x"
        light = lambda x, y: (y >= 20 and 27 <= x <= 26 + k % 6) or 9 <= y <= 8 + k % 5  # noqa: E731, B023
        assert found[k] == "".join("x" if light(i % 60, i // 60) else t[i % len(t)] for i in range(4800))


def test_words_are_not_shuffled_for_visual_lines(spark, sf_dir):
    found = plan(catalogue.QUERIES["visual_lines"](spark, sf_dir))
    words = found.index("posexplode(split(")
    assert "Exchange" not in found[:words].replace("BroadcastExchange", "")


def test_a_word_that_a_page_has_often_is_one_row_of_a_margin(spark):
    rows = spark.range(3 * 4000).select(F.lit("b").alias("book_id"), (F.col("id") % 3 + 1).cast("int").alias("page"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("id"), F.lit("top").alias("side"), F.lit(0.1).alias("place"), F.lit("often").alias("text"))
    began = time.monotonic()
    assert L.repeated_text(rows).count() == 12000
    assert L.repeated_text(rows.where("page < 3")).count() == 0
    assert time.monotonic() - began < 30


def test_blocks_are_flagged_by_pages(spark, sf_dir):
    found = plan(catalogue.QUERIES["simple_paragraphs"](spark, sf_dir))
    assert "hashpartitioning(book_id" in found and not any(", page#" in x and ", id#" in x for x in found.split("hashpartitioning(")[1:] for x in [x.split(")")[0]])


@pytest.mark.parametrize("name", ["judge_once", "answer_schema", "answer_check", "edit_round_trip"])
def test_what_is_read_more_than_once_is_made_once(spark, sf_dir, name):
    assert "documents.parquet" not in plan(catalogue.QUERIES[name](spark, sf_dir))


def test_a_task_holds_the_blocks_of_one_book(spark):
    parts = spark.createDataFrame([(b, n, False, "t", f"<p>{b} {n}</p>") for b in "abc" for n in range(3)], "book_id string, n int, heading boolean, label string, xhtml string")
    frame = A.package(parts).toPandas()
    assert [len(set(x["book_id"])) for x in A._read(iter([frame, pd.DataFrame({"book_id": [], "content": []})]))] == [1, 1, 1]


def test_white_space_at_the_ends_is_what_the_pattern_says(spark):
    import re

    texts = [a + b + c for a in ("", " \t", "\u2003\x1c") for b in ("", "가 나", "a\u200bb", "\u200b") for c in ("", "\x85\u3000", "\n")]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip(F.col("t")), T.strip_start(F.col("t")), T.strip_end(F.col("t"))).collect()
    for t, both, start, end in found:
        assert (both, start, end) == (re.sub(rf"\A{T.SPACE}+|{T.SPACE}+\Z", "", t), re.sub(rf"\A{T.SPACE}+", "", t), re.sub(rf"{T.SPACE}+\Z", "", t))
    assert len(T.SPACES) == len(set(T.SPACES)) == int(np.sum([bool(re.match(T.SPACE, chr(k))) for k in range(0x10000)]))


def test_spaces_are_corrected_by_stretches_of_hangul(spark):
    import random
    import re

    space = re.compile(T.SPACE)

    def cut(t):
        return re.findall(f"({T.SPACE}*{T.NOT_SPACE})", t)

    def wanted(text, proposed):
        if space.sub("", text) != space.sub("", proposed):
            return text
        hangul, out, last = lambda x: "가" <= x[-1] <= "힣", "", ""
        for a, b in zip(cut(text), cut(proposed), strict=True):
            out, last = out + (b if last and hangul(last) and hangul(a) else a), a
        return out + re.search(f"({T.SPACE}*)\\Z", text)[1]

    r, pairs = random.Random(1), [("", ""), ("  ", ""), ("가나", "가 나 다"), ("가", " 가 ")]
    for _ in range(400):
        bare = "".join(r.choice("가나힣a1.😀ㄱ") for _ in range(r.randrange(9)))
        pairs.append(tuple("".join(r.choice(["", "", " ", "　", "\x1c "]) + x for x in [*bare, ""]) for _ in range(2)))
    rows = spark.createDataFrame(pairs, "t string, p string").select("t", "p", T.correct_spacing(F.col("t"), F.col("p")).alias("x")).collect()
    assert [x.x for x in rows] == [wanted(x.t, x.p) for x in rows]
    assert spark.range(1).select(T.correct_spacing(F.lit("가 나"), F.lit(None).cast("string"))).first()[0] == "가 나"
    long = spark.range(1600, numPartitions=4).select(F.concat(F.repeat(F.lit("plain words "), 1000), F.repeat(F.lit("가나 다라a "), 1000), F.col("id").cast("string")).alias("t"))
    began = time.monotonic()
    long.select(T.correct_spacing(F.col("t"), F.replace("t", F.lit("가나"), F.lit("가 나")))).write.format("noop").mode("overwrite").save()
    assert time.monotonic() - began < 12


def test_texts_are_alike_as_difflib_finds_them():
    import difflib
    import random

    from folioflow.operators import review as R

    r = random.Random(2)
    for n in [0, 1, 5, 60, 199, 200, 205, 420, 900]:
        for letters in ("ab", "abcdefghij ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ,.가나다"):
            for _ in range(12):
                a = "".join(r.choice(letters) for _ in range(n)) if r.random() < 0.7 else ("".join(r.choice(letters) for _ in range(r.randrange(1, 40))) * n)[:n]
                k, w = r.randrange(n + 1), r.randrange(8)
                b = a[:k] + "".join(r.choice(letters + "z") for _ in range(r.randrange(8))) + a[k + w :]
                ratio = difflib.SequenceMatcher(None, a, b).ratio()
                assert R.alike(a, b, ratio) and not R.alike(a, b, ratio + 1e-9)
                assert R.alike(a, b, 0.96) == (ratio >= 0.96)
    text = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 11))) for _ in range(9000)) + "."
    changed = text.replace(text[30000:30012], "Q")
    began = time.monotonic()
    assert R.alike(text, changed, 0.96) == (difflib.SequenceMatcher(None, text, changed).ratio() >= 0.96)
    own = time.monotonic()
    R.alike(text, changed, 0.96)
    assert time.monotonic() - own < (own - began) / 2


@pytest.mark.parametrize("name", ["reconstruct_paragraphs", "context_merge", "one_long_book", "boundary_triage"])
def test_lines_are_read_once_for_a_books_order(spark, sf_dir, name):
    assert "documents.parquet" not in plan(catalogue.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_ranges_of_paragraphs_do_not_show_where_they_are_joined(spark, size):
    texts = ["a의", "b를", "c.", "d의", "e", "f의", "g의", "h의", "i", "", "j(", "k"]
    rows = [(b, o + o // 5 * 3, t, "heading" if b == "y" and o == 4 else "body", [(o // 2 + (o > 6), f"l{o}")]) for b in "xy" for o, t in enumerate(texts)]
    paragraphs = spark.createDataFrame(rows, "book_id string, ord long, text string, kind string, sources array<struct<page:int,block_id:string>>")
    found = {(r.book_id, r.ord): r.text for r in L.merge_by_context(paragraphs, size=size).collect()}
    joined = L.neighbours(paragraphs, 50).withColumn("joined", F.coalesce(F.col("left").isNotNull() & L.joins(F.col("left"), F.col("text")), F.lit(False)))
    assert found == {(r.book_id, r.ord): r.text for r in L.united(joined, 50).collect()} and len(found) < len(rows)


def test_brackets_are_taken_out_once(spark, sf_dir):
    assert plan(catalogue.QUERIES["listening_paragraphs"](spark, sf_dir)).count("aggregate(transform(regexp_extract_all(") == 3  # two for whether they balance, and what is left


def test_only_texts_are_exploded_and_heads_are_squeezed_once(spark, sf_dir):
    found = plan(catalogue.QUERIES["margin_candidates"](spark, sf_dir))
    assert "transform(" not in found and found.count("regexp_replace(") == 1


def test_a_folder_of_many_books_is_few_tasks_and_opens_none(spark, tmp_path, monkeypatch):
    from folioflow.sources import book_format as BF

    parts = spark.createDataFrame([(f"b{b}", n, n == 0, "t", f"<p>{b} {n}</p>") for b in range(40) for n in range(3)], "book_id string, n int, heading boolean, label string, xhtml string")
    books = A.package(parts).toPandas()
    for name, content in zip(books["book_id"], books["content"], strict=True):
        (tmp_path / BF.file_name(name)).write_bytes(bytes(content))
    opened, own = [], BF.BookReader._documents
    monkeypatch.setattr(BF, "TASKS", 8)
    monkeypatch.setattr(BF.BookReader, "_documents", staticmethod(lambda *x: opened.append(x) or own(*x)))
    reader = BF.BookReader({"path": str(tmp_path), "split": "1"})
    found = reader.partitions()
    assert not opened and len(found) <= 16 and sum(len(p.paths) for p in found) == 40
    rows = [r for p in found for batch in reader.read(p) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    assert sorted(rows) == sorted((f"b{b}", A.MEMBERS[3], k, t) for b in range(40) for k, t in enumerate([f"b{b}", *(f"{b} {n}" for n in range(3))]))


def test_books_are_read_and_packed_without_a_frame_of_each(spark, sf_dir):
    found = plan(catalogue.QUERIES["read_blocks"](spark, sf_dir))
    assert "InPandas" not in found and found.count("MapInArrow") == 2


def test_edits_are_made_and_books_are_read_once(spark, sf_dir):
    found = plan(catalogue.QUERIES["edit_damaged_books"](spark, sf_dir))
    assert "InPandas" not in found and found.count("MapInArrow") == 1  # the edited books are a table that is read for both


def test_edits_of_books_that_have_none_or_are_not_there(spark):
    parts = [(b, k, False, "t", f"<p>{b} {k}</p>") for b in "abc" for k in range(3)]
    own = A.package(spark.createDataFrame(parts, "book_id string, n int, heading boolean, label string, xhtml string")).union(spark.createDataFrame([("d", b"no book")], "book_id string, content binary"))
    changes = [("a", A.MEMBERS[3], 1, "new"), ("a", A.MEMBERS[3], 2, None), ("a", "x", 1, "y"), ("a", A.MEMBERS[3], 99, "z"), ("a", A.MEMBERS[3], None, "z"), ("b", A.MEMBERS[3], 3, "<&>"), ("d", A.MEMBERS[3], 0, "x"), ("none", A.MEMBERS[3], 0, "x")]
    plan_ = spark.createDataFrame(changes, "book_id string, document string, idx int, after string")
    new = A.write_edited(own, plan_)
    assert sorted(r.book_id for r in new.collect()) == list("abcd") and bytes(new.where("book_id = 'd'").first().content) == b"no book"
    found = {(r.book_id, r.idx): r.text for r in A.read_blocks(new).collect()}
    assert found == {("a", 0): "a", ("a", 1): "new", ("a", 2): "a 2"} | {(b, k): t for b in "bc" for k, t in enumerate([b, f"{b} 0", f"{b} 1", f"{b} 2" if b == "c" else "<&>"])}


def test_stale_changes_are_found_in_one_reading(spark):
    own = A.package(spark.createDataFrame([("a", 0, False, "t", "<p>t</p>")], "book_id string, n int, heading boolean, label string, xhtml string"))
    assert plan(books._stale(own)).count("MapInArrow") == plan(A.read_blocks(own)).count("MapInArrow")


def test_documents_are_dealt_once_for_margins_and_flow(spark, sf_dir):
    df = catalogue.QUERIES["simple_paragraphs"](spark, sf_dir)
    df.collect()
    ran = plan(df).split("== Initial Plan ==")[0]
    assert ran.count("Scan parquet") == 1 and "ReusedExchange" in ran


def test_a_null_book_has_its_paragraphs(spark):
    line = lambda book, page, k, text: (book, page, 1000, 1000, k, f"l{k}", text, 100, 5 if k == 0 else 400, 600, 20 if k == 0 else 420, 1.0, k, "line")
    rows = [line(b, p, k, t) for b in (None, "b") for p in (1, 2, 3) for k, t in enumerate(["Head of it", f"text {p}."])]
    blocks = spark.createDataFrame(rows, "book_id string, page int, width int, height int, pos int, id string, text string, x0 int, y0 int, x1 int, y1 int, confidence double, reading_order int, type string")
    found = {(r.book_id, r.page, r.text) for r in L.simple_paragraphs(blocks, L.margins(blocks)).collect()}
    assert found == {("b", p, f"text {p}.") for p in (1, 2, 3)} | {(None, p, t) for p in (1, 2, 3) for t in ("Head of it", f"text {p}.")}


def test_how_many_characters_a_text_has_without_white_space(spark):
    texts = [a + b * n + s for a in ("", " \t", " \x1c") for b in ("x", "가 ", "a​\x85", "\U0001f600　", " ") for n in (0, 1, 2, 30, 31, 59, 60, 61, 5000) for s in ("", "\n", " y")]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(T.BARE % "2,60"), F.length(T.squeeze(F.col("t"))).between(2, 60)).collect()
    assert all(r[1] == r[2] for r in found) and len({r[1] for r in found}) == 2


def test_planted_notes_are_made_with_their_lines(spark, sf_dir):
    from folioflow.plans.judgement import noted

    found = plan(noted(spark, sf_dir))
    assert found.count("Scan parquet") == 1 and "Union" not in found


def test_notes_without_marks_cost_no_run_of_each_line(monkeypatch):
    from folioflow.operators import notes as N

    r = np.random.default_rng(3)

    def by_each_line(x):
        """The rule line by line: medians of the last three wide lines, a run from each line that lies below another."""
        n, y0, y1, tall, height = len(x["y0"]), x["y0"], x["y1"], x["y1"] - x["y0"], float(x["height"][0])
        body = ~x["is_heading"]
        chosen = body & (y0 > 0.15 * height) & (y0 < 0.50 * height) & x["long"]
        chosen = chosen if chosen.any() else body & (y0 < 0.72 * height)
        usual = float(np.median(tall[chosen])) if chosen.any() else 0.0
        for i in range(n if usual > 0 else 0):
            if not (body[i] and y0[i] >= 0.45 * height and (x["marked"][i] or (i and y0[i] > y1[i - 1]))):
                continue
            before = [k for k in range(i) if body[k] and y0[k] > 0.1 * height and x["x1"][k] - x["x0"][k] > 0.45 * x["width"][0]]
            size = float(np.median(tall[before[-3:]])) if before else usual
            stop = next((k for k in range(i, n) if not (body[k] and y0[k] >= y0[i] - size and tall[k] <= 1.15 * size)), n)
            run = [k for k in range(i, stop) if not x["blank"][k] and not x["number"][k]]
            if not run or np.median(tall[run]) > 0.94 * size:
                continue
            if x["marked"][i]:
                return run
            if i and len(run) > 1 and tall[i] <= 0.96 * size and y0[i] - y1[i - 1] >= 1.4 * size and y1[run[-1]] >= 0.88 * height:
                aligned = max((sum(abs(x["x0"][a] - x["x0"][b]) < size for a in before) for b in before), default=0)
                if aligned >= 3 and np.median([max(0, y0[b] - y1[a]) for a, b in zip(run, run[1:], strict=False)]) < 0.6 * size:
                    return run
        return []

    kinds, calls, median = set(), [], np.median
    for _ in range(1500):
        n, at = int(r.integers(1, 40)), int(r.integers(0, 40))
        small = np.arange(n) >= at
        steps = np.where(small, 16, 25) + np.where(np.arange(n) == at, r.integers(0, 60), 0)
        y0 = np.cumsum(steps) - steps.sum() + r.integers(780, 960) + r.integers(-2, 2, n)
        x = {"y0": y0, "y1": y0 + np.where(small, r.integers(9, 14), r.integers(14, 22, n)), "x0": 100 + r.integers(0, 8, n), "x1": 100 + r.choice([300, 700, 800], n), "height": np.full(n, 1000), "width": np.full(n, 1000)}
        x |= {k: r.random(n) < p for k, p in (("is_heading", 0.04), ("blank", 0.05), ("number", 0.04), ("marked", 0.02), ("long", 0.9))}
        x = {k: v.astype(np.int32) if v.dtype != bool else v for k, v in x.items()}
        want = by_each_line(x)
        assert list(N.region_notes(x)) == want
        kinds.add((len(want) > 0, bool(x["marked"][want[0]]) if want else None))
    assert kinds == {(False, None), (True, True), (True, False)}
    n = 400
    x = {"y0": np.arange(n, dtype=np.int32) * 25, "x0": np.zeros(n, np.int32), "x1": np.full(n, 900, np.int32), "height": np.full(n, 10000, np.int32), "width": np.full(n, 1000, np.int32)}
    x |= {"y1": x["y0"] + 15} | {k: np.full(n, k == "long") for k in ("is_heading", "blank", "number", "marked", "long")}
    monkeypatch.setattr(np, "median", lambda *a: calls.append(1) or median(*a))
    assert not len(N.region_notes(x)) and len(calls) == 1


def test_words_are_cut_in_their_order_and_not_sorted(spark, sf_dir):
    found = plan(catalogue.QUERIES["visual_lines"](spark, sf_dir))
    words = found[: found.index("posexplode(split(")]
    assert "Sort" not in words and "Window" not in words and "Join" not in words and found.count("Exchange") == 1


def test_words_of_long_lines_lie_where_those_before_them_end(spark, tmp_path):
    from folioflow.plans import layouts

    texts = ["", " ", "  a  b ", " ".join("é" * (k % 7) for k in range(200)), "\n".join([" ".join(f"w{k}" for k in range(n)) for n in (63, 64, 65, 128, 129)])]
    spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for page, text in enumerate(texts, 1):
        for line, own in enumerate(text.split("\n"), 1):
            x = 100
            for k, word in enumerate(own.split(" ")):
                want |= {(page, line * 65536 + k, f"text-{line}-{k}", word, x, x + 12 * len(word))} if word else set()
                x += 12 * len(word) + 4 + k % 3 * 5
    assert {tuple(r) for r in layouts.document_words(spark, str(tmp_path)).select("page", "pos", "id", "text", "x0", "x1").collect()} == want


@pytest.mark.parametrize("batch", [7, 10000])
def test_lines_of_whole_pages_are_those_of_sorted_blocks(spark, sf_dir, batch):
    from folioflow.operators import notes as N
    from folioflow.plans import layouts

    words = layouts.document_words(spark, sf_dir).where("page < 6")
    removed = words.where("page % 2 = 0 and pos % 3 = 0 or page = 5").select("book_id", "page", "id")
    key = lambda df: sorted(map(str, df.collect()))
    want = key(N.visual_lines(L.body_lines(words, removed)))
    cut = layouts.document_words(spark, sf_dir, removed).where("page < 6").withColumn("number", L.page_number())
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert key(N.page_lines(cut)) == want and len(want) > 100
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_words_of_a_text_layer_are_not_sorted_for_what_is_removed(spark, sf_dir):
    from folioflow.operators import notes as N
    from folioflow.plans import layouts

    removed = L.margins(layouts.document_words(spark, sf_dir))
    lines = N.page_lines(layouts.document_words(spark, sf_dir, removed).withColumn("number", L.page_number()))
    words = plan(lines).split("posexplode(split(")[0]
    assert "MapInArrow" in words and not any(x in words for x in ("Sort", "Window", "Join", "Exchange", "array_contains"))
