"""Whole runs: killed after any step and gone on with, forced, with services, titles, brackets and an analyser."""

import json

import pytest
from pyspark.sql import functions as F

from folioflow.operators import calls as C
from folioflow.operators import convert as V
from folioflow.operators import layout as L
from folioflow.sources import archive as A
from folioflow.sources import stores
from folioflow.sources.ledger import Ledger
from tests.test_judging import BOX, paras


@pytest.fixture(scope="module")
def pages(spark):
    line = lambda p, k, t, y, x1=800: ("b", p, 1000, 1000, k, f"l{k}", t, 100, y, x1, y + 20, 1.0, k, "line")
    rows = [row for p in range(1, 4) for row in (line(p, 0, f"같은 머리{p}", 20), line(p, 1, f"{p}쪽의 글 (보기) 이다.", 300), line(p, 2, "끝나지 않음", 500), line(p, 3, str(p), 960))]
    return spark.createDataFrame(rows, BOX)


def service(seen, limit=None):
    def complete(instructions, request, schema, most):
        asked = json.loads(request)
        seen.add(len(asked))
        if "decisions" in schema["properties"]:
            return C.Reply(json.dumps({"decisions": [{"id": x["id"], "join": False} for x in asked]}), 100, 10)
        return C.Reply(json.dumps({"items": [{"id": x["id"], "remove_glosses": ["(보기)"]} for x in asked]}), 200, 20)

    return C.Service(complete, 1.0, 0.0, 1.0, limit, at_once=2)


def options(seen, limit=None):
    return V.Options(reconstruct=True, boundaries=True, reviews=frozenset({"glosses"}), model="m", service=service(seen, limit))


class Killed(Exception):
    pass


STEPS = ["blocks", "drafts", "boundaries", "clean", "removed", "audit", "summary", "usage", "cache", "books"]


def test_a_run_goes_on_after_any_step(spark, tmp_path, pages, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    whole = str(tmp_path / "whole")
    assert V.convert(spark, pages, whole, options(seen)).count() == 0
    asked = seen.value
    books = lambda out: [r.text for r in A.read_blocks(A.read_published(spark, f"{out}/books")).orderBy("idx").collect()]
    wanted = books(whole)
    assert asked == 5 and "1쪽의 글 이다." in wanted
    enter, out, calls = Ledger.enter, str(tmp_path / "torn"), []

    def dies(self, step, **more):
        if step in STEPS and step not in calls:
            calls.append(step)
            raise Killed(step)  # the step's table is there, its entry isn't
        enter(self, step, **more)

    monkeypatch.setattr(Ledger, "enter", dies)
    for k in range(len(STEPS)):
        with pytest.raises(Killed):
            V.convert(spark, pages, out, options(seen), resume=k > 0)
    assert calls == STEPS and V.convert(spark, pages, out, options(seen), resume=True).count() == 0
    assert seen.value == 2 * asked and books(out) == wanted
    usage = spark.read.parquet(f"{out}/usage").first()
    assert (usage.input, usage.output, usage.cost, usage.features) == (300, 30, 0.00033, {"boundary": 0.00011, "glosses": 0.00022})
    assert stores.read_cache(spark, f"{out}/cache").count() == 3
    told = {(r.source, r.joined) for r in spark.read.parquet(f"{out}/boundaries").where("left is not null").collect()}
    assert told == {("ai", False), ("local", False)}
    ledger = Ledger(spark, out, options(seen).key, resume=True)
    assert [(s, k, n) for s, _, k, n in ledger.progress(STEPS)] == [(s, k + 1, len(STEPS)) for k, s in enumerate(STEPS)]
    with pytest.raises(FileExistsError, match="already exists"):
        V.convert(spark, pages, out, options(seen))
    with pytest.raises(ValueError, match="other settings"):
        V.convert(spark, pages, out, V.Options(), resume=True)
    # a forced run takes its answers from the cache, and leaves the old tables
    assert V.convert(spark, pages, out, options(seen), force=True).count() == 0
    assert seen.value == 2 * asked + 2 and books(out) == wanted
    new = Ledger(spark, out, options(seen).key, resume=True).generation
    assert books(f"{out}/{new}") == wanted and {r.source for r in spark.read.parquet(f"{out}/{new}/clean").collect()} == {"cache", "local"}


def test_one_budget_for_all_passes(spark, tmp_path, pages):
    seen = spark.sparkContext.accumulator(0)
    V.convert(spark, pages, str(tmp_path), options(seen, 0.0031))  # boundaries may cost 1,900 at most and cost 110; reviews then may cost 3,150
    assert {r.status for r in spark.read.parquet(f"{tmp_path}/calls/boundary/made").collect()} == {"answered"}
    assert {r.status for r in spark.read.parquet(f"{tmp_path}/calls/enhance/made").collect()} <= {"cost_limit", "answered"}
    assert spark.read.parquet(f"{tmp_path}/usage").first().cost <= 0.0031


def test_brackets_joining_and_titles(spark, tmp_path, pages):
    titles = spark.createDataFrame([("b", "책 <1>￾")], "book_id string, title string")
    V.convert(spark, pages, str(tmp_path), V.Options(reconstruct=True, join=False, keep_brackets=True), titles=titles)
    book = [r.text for r in A.read_blocks(A.read_published(spark, f"{tmp_path}/books")).orderBy("idx").collect()]
    assert book[0] == "책 <1>" and "1쪽의 글 (보기) 이다." in book and book.count("끝나지 않음") == 3
    for bad in ({"boundaries": True, "reconstruct": True}, {"analyse": str.split}, {"reconstruct": True, "reviews": frozenset({"x"}), "judge": lambda df: df}):
        with pytest.raises(ValueError):
            V.Options(**bad)


def test_joining_with_an_analyser(spark):
    """The left side is what was joined so far: here its last tag depends on its first word."""

    def analyse(text):
        return ["JX"] if text.startswith("하나") and text.count(" ") < 3 else ["XSV" if text.startswith("접") else "NNG"]

    texts = ["하나 둘", "셋", "넷", "접미 다섯", "여섯.", "일곱"]
    found = L.merge_with(paras(spark, texts), analyse).orderBy("ord").collect()

    def plain(rows):
        out = []
        for t in rows:
            left = out[-1] if out else ""
            if left and not left.endswith(".") and (analyse(left)[-1] in L.DEPENDENT_LAST or analyse(t)[0].startswith(("E", "XS"))):
                out[-1] = f"{left} {t}"
            else:
                out.append(t)
        return out

    assert [r.text for r in found] == plain(texts)
    assert [len(r.sources) for r in found] == [len(r.text.replace("하나 둘", "a").replace("접미 다섯", "b").split()) for r in found]
    rows = paras(spark, texts)
    assert [r.text for r in L.merge_with(rows, lambda t: ["NNG"]).orderBy("ord").collect()] == [r.text for r in L.merge_by_context(rows).orderBy("ord").collect()]
    headed = rows.withColumn("kind", F.when(F.col("ord") == 1, "heading").otherwise("body"))
    assert [r.text for r in L.merge_with(headed, lambda t: ["JX"]).orderBy("ord").collect()] == ["하나 둘", "셋", "넷 접미 다섯 여섯.", "일곱"]
