"""Whole passes with a fake judge, and the stores around them."""

import hashlib
import json
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from folioflow.operators import judging as J
from folioflow.functions.text import needs_review
from folioflow.operators import convert as C
from folioflow.operators import review as R
from folioflow.sources import archive as A
from folioflow.sources import stores

PARAS = "book_id string, ord int, text string, kind string, sources array<struct<page:int,block_id:string>>"


def paras(spark, texts):
    return spark.createDataFrame([("b", k, t, "body", [(1, f"l{k}")]) for k, t in enumerate(texts)], PARAS)


def test_only_open_boundaries_are_asked(spark):
    asked = []

    def judge(df):
        asked.extend(df.collect())
        return df.select("book_id", "batch", "id", F.when(F.col("right").startswith("이어"), "true").otherwise("false").alias("answer"))

    found = J.joined_boundaries(paras(spark, ["오래된 마을의", "골목을 걷는다", "이어지는 글", "다른 글."]), judge).orderBy("ord").collect()
    assert [r.text for r in found] == ["오래된 마을의 골목을 걷는다 이어지는 글", "다른 글."]
    assert {r.right for r in asked} == {"이어지는 글", "다른 글."}


def test_enhance_uses_cache_budget_and_exact_answers(spark):
    texts = [f"문단 {k} (참고)입니다" for k in range(50)] + ["그대로다."]
    item = json.dumps({"remove_glosses": ["(참고)"], "kind": "unchanged", "heading_level": 0}, ensure_ascii=False)
    rows, empty = paras(spark, texts), spark.createDataFrame([], stores.CACHE)
    judge = lambda df: df.where("not (batch = 1 and id = 0)").select("book_id", "batch", "id", F.lit(item).alias("answer"))
    run = lambda cache, **k: J.enhanced(rows, judge, needs_review(F.col("text"), F.col("kind"), {"glosses"}), cache, "m", ["glosses"], **k).orderBy("ord").collect()
    found = run(empty)
    assert [r.source for r in found] == ["ai"] * 24 + ["fallback"] * 24 + ["ai"] * 2 + ["local"]
    assert found[0].text == "문단 0 입니다" and found[30].text == texts[30]
    cached = spark.createDataFrame([(r.key, r.answer) for r in found if r.source == "ai"], stores.CACHE)
    assert [r.source for r in run(cached)] == ["cache"] * 24 + ["fallback"] * 24 + ["cache"] * 2 + ["local"]
    assert {r.source for r in run(empty, limit=0.0, price=1.0, output_price=1.0)} == {"fallback", "local"}
    sums = J.audit_summary(spark.createDataFrame([("b", r.source) for r in found], "book_id string, source string")).first()
    assert (sums.ai, sums.cache, sums.local, sums.fallback) == (26, 0, 1, 24)


def test_rules_propose_changes(spark):
    blocks = spark.createDataFrame([("b", "d", 0, "keep me"), ("b", "d", 1, "drop me"), ("b", "d", 2, "change me"), ("b", "d", 3, " ")], "book_id string, document string, idx int, text string")
    said = {"keep me": {"action": "keep"}, "drop me": {"action": "delete"}, "change me": {"action": "replace", "text": "changed"}}
    answers = spark.createDataFrame([(k, json.dumps(v)) for k, v in said.items()], "shown string, answer string")
    plan = J.rule_plan(blocks, lambda df: df.join(answers, "shown").select("book_id", "batch", "id", "answer"))
    assert {(r.idx, r.after) for r in plan.collect()} == {(1, None), (2, "changed")}


def test_stores(spark, tmp_path):
    cache = str(tmp_path / "cache")
    assert stores.read_cache(spark, cache).count() == 0
    stores.add_to_cache(spark.createDataFrame([("a", "1"), ("a", "2"), ("b", None)], stores.CACHE), cache)
    stores.add_to_cache(spark.createDataFrame([("a", "3"), ("c", "4")], stores.CACHE), cache)
    (tmp_path / "cache" / "bad.json").write_text("not json\n")
    assert sorted(map(tuple, stores.read_cache(spark, cache).collect())) == [("a", "1"), ("c", "4")]
    plan = spark.createDataFrame([("d", 1, "x", None), ("d", 0, "y", "z")], stores.PLAN)
    stores.write_plan(plan, str(tmp_path / "plan"))
    assert sorted(map(tuple, stores.read_plan(spark, str(tmp_path / "plan")).collect())) == [("d", 0, "y", "z"), ("d", 1, "x", None)]
    for name in ("B.pdf", "a.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"%")
    files = stores.book_files(spark, str(tmp_path))
    assert [(r.path.rsplit("/", 1)[1], bytes(r.content)) for r in files.orderBy("ord").collect()] == [("a.pdf", b"%"), ("B.pdf", b"%")]
    assert stores.cache_identity(psm=6, model=b"x") != stores.cache_identity(psm=6, model=b"y") and stores.cache_identity(a=1, b=2) == stores.cache_identity(b=2, a=1)
    state = str(tmp_path / "project")
    assert stores.read_manifest(spark, state) is None
    stores.write_manifest(spark, state, source="a.pdf", page_count=3, status="reading")
    stores.write_manifest(spark, state, status="done")
    now = stores.read_manifest(spark, state)
    assert (now["source"], now["page_count"], now["status"], now["generation"]) == ("a.pdf", 3, "done", "initial")
    assert stores.settings_key({"a": 1, "b": 2}) == stores.settings_key({"b": 2, "a": 1})

    @dataclass
    class Settings:
        dpi: int = 300
        name: str = ""

    assert stores.checked_settings(Settings, {"dpi": "x", "name": "n", "other": 1}) == Settings(300, "n")
    assert stores.plain_schema({"type": "integer", "minimum": 0, "items": [{"maxLength": 3}]}) == {"type": "integer", "items": [{}]}


def test_cache_keys_are_those_of_python(spark):
    texts = ['a"b\\c', "tab\tline\n", "\x01\x0b\x1f\x7f", "\\u001F \x1f\x1a\x1b", "글 é"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k")
    for model, names in (("m", ["b", "a"]), ('m"q', ['rule: "say\\so"'])):
        wanted = [hashlib.sha256(json.dumps({"model": model, "schema": 1, "features": sorted(names), "text": t}, sort_keys=True, ensure_ascii=False).encode()).hexdigest() for t in texts]
        assert [r[0] for r in rows.select(R.cache_key(F.col("t"), model, names)).collect()] == wanted


BOX = "book_id string, page int, width int, height int, pos int, id string, text string, x0 int, y0 int, x1 int, y1 int, confidence double, reading_order int, type string"


def test_convert_writes_books_and_audits(spark, tmp_path):
    line = lambda p, k, t, y, x1=800: ("b", p, 1000, 1000, k, f"l{k}", t, 100, y, x1, y + 20, 1.0, k, "line")
    pages = [row for p in range(1, 5) for row in (line(p, 0, f"같은 머리{p}", 20), line(p, 1, f"{p}쪽의 글 (보기) 이다.", 300), line(p, 2, "다음 문단이다.", 500, 300), line(p, 3, str(p), 960))]
    blocks = spark.createDataFrame(pages, BOX)
    out = str(tmp_path / "plain")
    assert C.convert(spark, blocks, out).count() == 0
    book = A.read_blocks(A.read_published(spark, f"{out}/books")).orderBy("idx").collect()
    assert [r.text for r in book] == ["b", *[t for p in range(1, 5) for t in (f"{p}쪽의 글 이다.", "다음 문단이다.")]]
    assert spark.read.parquet(f"{out}/removed").count() == 4 and spark.read.parquet(f"{out}/audit").count() == 0
    asked = []

    def judge(df):
        asked.append(df.count())
        return df.select("book_id", "batch", "id", F.lit(json.dumps({"remove_glosses": ["(보기)"], "kind": "heading", "heading_level": 3})).alias("answer"))

    options = C.Options(reconstruct=True, reviews=frozenset({"glosses"}), judge=judge, model="m")
    out = str(tmp_path / "judged")
    assert C.convert(spark, blocks, out, options).count() == 0
    audit = spark.read.parquet(f"{out}/audit").collect()
    assert {(r.source, "(보기)" in r.before, "(보기)" in r.after) for r in audit} == {("ai", True, False)} and len(audit) == 4
    assert spark.read.parquet(f"{out}/summary").select("ai", "local", "model").first() == (4, 4, "m")
    assert stores.read_cache(spark, f"{out}/cache").count() == 4
    with pytest.raises(Exception, match="already exists"):
        C.convert(spark, blocks, out, options)
    for bad in ({"reviews": frozenset({"glosses"})}, {"reconstruct": True, "reviews": frozenset({"glosses"})}, {"limit": -1.0}):
        with pytest.raises(ValueError):
            C.Options(**bad)
    assert C.estimate(blocks, ["glosses"], 0.3, 1.7).first().input == 4 * 2300
