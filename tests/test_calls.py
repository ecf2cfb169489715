"""Outside calls: once each, in order, within a budget, answered in form."""

import json

import pytest
from pyspark.sql import functions as F

from folioflow.operators import answers as A
from folioflow.operators import calls as C
from folioflow.operators import judging as J
from folioflow.operators import review as R
from folioflow.sources import stores
from tests.test_judging import paras

LIMITS = lambda n, size, length: F.lit(100)


def good(request, **more):
    return json.dumps({"items": [{"id": x["id"], "remove_glosses": ["(참고)"], **more} for x in json.loads(request)]}, ensure_ascii=False)


def test_a_service_sees_each_question_once_and_its_answers_are_stored(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def complete(instructions, request, schema, most):
        seen.add(len(json.loads(request)))
        assert schema["properties"]["items"]["items"]["required"] == ["id", "remove_glosses"] and most == 100
        return C.Reply(good(request), 10, 5)

    rows = paras(spark, [f"문단 {k} (참고)입니다" for k in range(40)])
    judge = C.judge(C.Service(complete, 1.0, 0.0, 1.0), "", A.enhance_form(["glosses"]), {"text": "text", "current_kind": "kind"}, LIMITS, path=str(tmp_path / "calls"))
    run = lambda: J.enhanced(rows, judge, F.lit(True), spark.createDataFrame([], stores.CACHE), "m", ["glosses"], store=str(tmp_path / "store"))
    found = run().orderBy("ord").collect()
    assert {r.source for r in found} == {"ai"} and found[3].text == "문단 3 입니다" and seen.value == 40
    assert run().orderBy("ord").collect() == found and seen.value == 40
    assert spark.read.parquet(str(tmp_path / "calls")).agg(F.sum("cost")).first()[0] == pytest.approx(30e-6)


def test_a_dataframe_judge_is_asked_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def judge(asked):
        def run(batches):
            for b in batches:
                seen.add(len(b))
                yield b.assign(answer='{"heading_level": 2}')[["book_id", "batch", "id", "answer"]]

        return asked.mapInPandas(run, "book_id string, batch int, id int, answer string")

    found = J.enhanced(paras(spark, [f"문단 {k}" for k in range(40)]), judge, F.lit(True), spark.createDataFrame([], stores.CACHE), "m", ["headings"])
    assert found.where("kind = 'heading'").count() == 40 and seen.value == 40


@pytest.mark.parametrize("wrong", ["not json", '{"heading_level": "x"}', "[1]", "3", None])
def test_one_answer_that_cannot_be_read_fails_its_batch(spark, wrong):
    judge = lambda df: df.select("book_id", "batch", "id", F.when((F.col("batch") == 0) & (F.col("id") == 5), F.lit(wrong)).otherwise(F.lit('{"heading_level": 2}')).alias("answer"))
    found = J.enhanced(paras(spark, [f"문단 {k}" for k in range(30)]), judge, F.lit(True), spark.createDataFrame([], stores.CACHE), "m", ["headings"]).orderBy("ord").collect()
    assert [r.source for r in found] == ["fallback"] * 24 + ["ai"] * 6 and all(r.answer is None for r in found[:24])


def test_budget_in_order():
    rows = [("b", k, "x" * 232, 100, None) for k in range(6)] + [("c", 0, "x", 100, 5e-3), ("d", 0, "x", 1, 0.0)]
    run = lambda complete, limit: [(c[0], c[2], round(c[8] * 1e6)) for c in C.in_order(iter(rows), C.Service(complete, 1.0, 0.5, 10.0, limit), "", {})]

    def costs(tokens, output, cached=0):
        return lambda *_: C.Reply("{}", tokens, output, cached)

    # a call reserves 232 + 768 tokens and 100 of output: 2,000 units
    assert run(costs(100, 10), 2.25e-3)[:6] == [("b", "answered", 200), ("b", "answered", 400), ("b", "cost_limit", 400), *[("b", "stopped", 400)] * 3]
    assert run(costs(100, 10), 2.25e-3)[6:] == [("c", "cost_limit", 5000), ("d", "answered", 200)]
    assert [r[2] for r in run(costs(100, 0, 300), None)[:2]] == [50, 100]
    assert run(costs(3000, 0), 3e-3)[1] == ("b", "cost_limit", 3000)

    def gone(*_):
        raise TimeoutError

    assert [r[1] for r in run(gone, None)] == ["TimeoutError", *["stopped"] * 5, "TimeoutError", "TimeoutError"]
    turns = iter(range(99))

    def odd(*_):
        if next(turns) % 2:
            raise KeyError("x")
        return C.Reply("{}", 1)

    assert [r[1] for r in run(odd, None)][:3] == ["answered", "KeyError", "answered"]


def test_costs_of_earlier_passes_count(spark):
    asked = spark.createDataFrame([("b", 0, 0, "글"), ("c", 0, 0, "글")], "book_id string, batch int, id int, text string")
    before = spark.createDataFrame([("b", 0, "answered", "", 0, 0, 0, 0.002, 0.002)], C.CALLS)
    found = C.made(C.requests(asked, {"text": "text"}, LIMITS), C.Service(lambda *_: C.Reply("{}", 1), 1.0, 0.0, 1.0, 0.0025), "", A.BOUNDARIES, before=before)
    assert {(r.book_id, r.status) for r in found.collect()} == {("b", "cost_limit"), ("c", "answered")}


@pytest.mark.parametrize(
    ("text", "problem"),
    [
        ('{"items": [{"id": 1, "ocr_edits": [], "kind": "body"}, {"id": 0, "ocr_edits": [{"before": "a", "after": "b", "confidence": 1, "reason": ""}, {"before": "a", "after": "b", "confidence": 0.95, "reason": ""}], "kind": "unchanged"}]}', None),
        ('{"items": [{"id": 0, "ocr_edits": [], "kind": "body"}]}', "ids"),
        ('{"items": [{"id": 0, "ocr_edits": [], "kind": "body"}, {"id": 0, "ocr_edits": [], "kind": "body"}]}', "ids"),
        ('{"items": [{"id": 0, "ocr_edits": [{"before": "a", "after": "b", "confidence": 1}], "kind": "body"}, {"id": 1, "ocr_edits": [], "kind": "body"}]}', "fields"),
        ('{"items": [{"id": 0, "ocr_edits": [], "kind": "chapter"}, {"id": 1, "ocr_edits": [], "kind": "body"}]}', "fields"),
        ('{"items": [{"id": 0, "ocr_edits": null, "kind": "body"}, {"id": 1, "ocr_edits": [], "kind": "body"}]}', "fields"),
        ('{"items": [{"id": "0", "ocr_edits": [], "kind": "body"}, {"id": 1, "ocr_edits": [], "kind": "body"}]}', "fields"),
        ('{"items": [], "more": 1}', "no list"), ('{"items": {}}', "no list"), ("[]", "no list"), ("", "no json"), ('{"items": [', "no json"),
    ],
)
def test_forms(spark, text, problem):
    rows = spark.createDataFrame([("b", 0, text, [0, 1])], "book_id string, batch int, text string, ids array<int>")
    form = A.enhance_form(["ocr_words", "structure"])
    assert A.checked(rows, form).first().problem == problem
    assert A.answers(rows, form).count() == (0 if problem else 2)


def test_rules_are_clipped_and_part_of_the_key(spark):
    named = A.with_rule(["glosses"], "  " + "가" * 700)
    assert named == ["glosses", A.RULE + "가" * 600] and A.with_rule(["glosses"], " ") == ["glosses"]
    assert A.enhance_form(named) == A.enhance_form(["glosses"])
    one, two = spark.range(1).select(R.cache_key(F.lit("x"), "m", named), R.cache_key(F.lit("x"), "m", ["glosses"])).first()
    assert one != two
    with pytest.raises(ValueError):
        A.enhance_form(["gloss"])
