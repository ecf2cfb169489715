"""How often plans read their input and go to Python, and rules that decide what is sent and what is edited."""

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import budget as U
from folioflow.operators import layout as L
from folioflow.operators import notes as N
from folioflow.plans import catalogue
from folioflow.plans.judgement import noted
from folioflow.sources import archive as A
from folioflow.sources import blocks as B


def counted(df):
    """Scans and Python steps of the plan that ran; an exchange that is read again counts once."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Scan parquet"), sum(plan.count(x) for x in ("MapInArrow", "ArrowEvalPython", "FlatMap"))


@pytest.mark.parametrize(("name", "scans", "python"), [("listening_paragraphs", 2, 0), ("simple_paragraphs", 2, 0), ("margins_union", 1, 0), ("footnotes", 2, 1), ("reconstruct_text_layer", 2, 2), ("reconstruct_paragraphs", 2, 0), ("context_merge", 2, 0), ("usage_rollup", 1, 0)])
def test_inputs_are_read_once_for_each_need(spark, sf_dir, name, scans, python):
    found = counted(catalogue.QUERIES[name](spark, sf_dir))
    assert found[0] <= scans and found[1] <= python


def test_notes_and_margins_are_flagged_in_two_scans(spark, sf_dir):
    blocks = noted(spark, sf_dir)
    rows = L.flagged(N.marked(blocks), L.margins(blocks), also=F.col("note") | F.col("ref"))
    scans, python = counted(rows)
    assert scans <= 4 and python == 1  # the blocks with planted notes are a union of two


def test_flags_are_what_ids_and_sizes_say(spark, sf_dir):
    blocks = B.document_blocks(spark, sf_dir)
    rows = L.flagged(blocks, L.margins(blocks))
    key = lambda df: {tuple(r) for r in df.collect()}
    assert key(rows.where("gone").select(*L.KEYS)) == key(L.margins(blocks)) and rows.count() == blocks.count()
    assert key(rows.select("book_id", "page", "body").distinct()) == key(L.body_size(blocks))
    sizes = L.body_size(blocks).withColumn("size", F.col("size") + 0)
    lines = L.line_features(L.body_lines(blocks, L.margins(blocks)))
    assert key(L.reconstruct(lines.drop("body"), sizes).select("book_id", "ord", "text")) == key(L.reconstruct(lines).select("book_id", "ord", "text"))


@pytest.mark.parametrize(("text", "on", "sent"), [("제목", {"structure"}, True), ("제목이다.", {"structure"}, False), (" \t　", {"structure", "headings", "figures"}, False), ("", {"headings"}, False), ("(가)", {"structure", "glosses"}, True), ("본문이 길다.", set(), False)])
def test_what_is_sent(spark, text, on, sent):
    assert spark.range(1).select(T.needs_review(F.lit(text), F.lit("body"), on)).first()[0] is sent
    assert spark.range(1).select(T.needs_review(F.lit("글이다."), F.lit("heading"), {"structure"})).first()[0]
    with pytest.raises(ValueError, match="nothing"):
        T.needs_review(F.lit(text), F.lit("body"), on | {"nothing"})


def test_errors_of_the_program_are_not_taken_for_damage():
    def wrong():
        raise IndexError("x")

    with pytest.raises(IndexError):
        A._tried(wrong)
    assert A._tried(A._zip, b"no book") is None


def test_rollup_without_books_and_without_features(spark):
    schema = "input long, output long, cost double, limit_reached boolean, features map<string,double>"
    rows = [(1, 2, 0.5, False, {"a": 0.25, "b": 0.25}), (3, 4, 0.25, True, {"b": 0.25}), (5, 6, 0.0, False, {}), (7, 8, 0.0, None, None)]
    found = U.rollup(spark.createDataFrame(rows, schema)).first()
    assert (found.input, found.output, found.cost, found.limit_reached, found.features) == (16, 20, 0.75, True, {"a": 0.25, "b": 0.5})
    assert U.rollup(spark.createDataFrame([], schema)).first().input is None


def test_a_registry_prefers_the_caller(spark):
    schema = "provider string, model string, input_price double, cached_price double, output_price double, verified boolean"
    mine, own = (spark.createDataFrame(rows, schema) for rows in ([("p", "m", 1.0, 0.0, 2.0, True)], [("p", "m", 9.0, 0.0, 9.0, True), ("p", "n", 3.0, 0.0, 4.0, False)]))
    assert {(r.model, r.input_price) for r in U.registry(mine, own).collect()} == {("m", 1.0), ("n", 3.0)}


@pytest.mark.parametrize("pages", [1, 3, 512])
def test_ranges_of_pages_do_not_show(spark, sf_dir, pages, monkeypatch):
    """Books with gaps between pages, cut anywhere: margins, lines, numbers and joins are as in one range."""
    blocks = B.document_blocks(spark, sf_dir, one_book=True).where("page % 11 <> 4")
    key = lambda df: sorted(map(str, df.collect()))
    run = lambda n, size: L.united(L.neighbours(L.reconstruct(L.line_features(L.body_lines(blocks, L.margins(blocks))), pages=n), size).withColumn("joined", F.coalesce(F.length("left") % 3 == 1, F.lit(False))), size)
    wanted = key(run(10**6, 10**6))
    monkeypatch.setattr(L, "RANGE", pages)
    monkeypatch.setattr(L.range_of, "__defaults__", (pages,))
    assert key(L.margins(blocks)) == key(L.margins(blocks.repartition(3))) and key(run(pages, pages)) == wanted
