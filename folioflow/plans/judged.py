"""Queries of outside calls: a recorded service that answers wrongly at times, in order, within a budget."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from folioflow.operators import answers as A
from folioflow.operators import budget as U
from folioflow.operators import calls as C
from folioflow.operators import review as R
from folioflow.plans.judgement import paragraphs
from folioflow.plans.layouts import _SIMPLE
from folioflow.sources import stores

c = F.col
FEATURES = ["headings", "glosses"]
INSTRUCTIONS = "Check the paragraphs."
#: In millionths of a dollar, and half of one, so that no sum is just at it.
LIMIT = 40_000


def recorded(instructions: str, request: str, schema: dict, most: int) -> C.Reply:
    """What was recorded for a request, by the length of its first text: right, or wrong in one of six ways."""
    asked = json.loads(request)
    kind = len(asked[0]["text"])
    if kind % 31 == 30:
        raise ConnectionError("out of reach")
    if kind % 8 == 6:
        raise ValueError("no answer")
    items = [{"id": x["id"], "heading_level": len(x["text"]) % 4, "remove_glosses": []} for x in asked]
    if kind % 8 == 2:
        del items[0]["remove_glosses"]
    if kind % 8 == 3:
        items[0]["figure_residue"] = False
    if kind % 8 == 4:
        items[0]["heading_level"] = "1"
    if kind % 8 == 5:
        items.pop()
    return C.Reply("not json" if kind % 8 == 1 else json.dumps({"items": items}), len(request), 10 * len(asked), 0)


def service(limit: float | None = None) -> C.Service:
    return C.Service(recorded, 1.0, 0.0, 2.0, limit, at_once=8)


def _asked(spark, sf_dir):
    rows = R.batches(paragraphs(spark, sf_dir), "book_id", ["page", "first"], R.ENHANCE).where(F.length("text") <= R.LONGEST)
    return rows.select("book_id", "batch", c("slot").alias("id"), "text")


def _requests(asked):
    return C.requests(asked, {"text": "text"}, lambda n, size, length: U.output_ceilings(n, size, length)["enhance"])


def _in_order(spark, sf_dir):
    """Each batch's call under a budget: how it ended, and what its book had cost by then, in millionths."""
    found = C.made(_requests(_asked(spark, sf_dir)), service((LIMIT + 0.5) / 1e6), INSTRUCTIONS, A.enhance_form(FEATURES))
    return found.select("book_id", "batch", "status", F.round(c("spent") * 1e6).cast("long").alias("spent"))


def _schema(spark, sf_dir):
    """What is wrong with each response that came."""
    wanted = stores.kept(spark, lambda: _requests(_asked(spark, sf_dir)))
    found = C.made(wanted, service(), INSTRUCTIONS, A.enhance_form(FEATURES)).where("status = 'answered'")
    return A.checked(found.join(wanted.select("book_id", "batch", "ids"), ["book_id", "batch"]), A.enhance_form(FEATURES)).select("book_id", "batch", "problem")


def _once(spark, sf_dir):
    """Each question's answer."""
    asked = stores.kept(spark, lambda: _asked(spark, sf_dir))
    judge = C.judge(service(), INSTRUCTIONS, A.enhance_form(FEATURES), {"text": "text"}, lambda n, size, length: U.output_ceilings(n, size, length)["enhance"])
    found = R.answered(asked, judge(asked))
    return found.select("book_id", "batch", "id", "source", F.get_json_object("answer", "$.heading_level").cast("int").alias("heading_level"))


def _usage(spark, sf_dir):
    """Tokens and cost of each book's calls by feature, in millionths."""
    found = C.made(_requests(_asked(spark, sf_dir)), service((LIMIT + 0.5) / 1e6), INSTRUCTIONS, A.enhance_form(FEATURES))
    parts = C.usage(found, FEATURES, service())
    return parts.groupBy("book_id", "feature").agg(F.count("*").alias("requests"), F.sum("input_part").alias("input"), F.sum("output_part").alias("output"), F.round(F.sum("cost") * 1e6).cast("long").alias("cost"))


QUERIES = {"budget_in_order": _in_order, "answer_schema": _schema, "judge_once": _once, "usage_of_calls": _usage}

_CALLS = f"""{_SIMPLE}, nb AS (SELECT book_id, text, row_number() OVER (PARTITION BY book_id ORDER BY page, first) - 1 AS n FROM simple WHERE NOT stray),
sel AS (SELECT book_id, text, CAST(n // 24 AS INT) AS batch, CAST(n % 24 AS INT) AS slot FROM nb WHERE length(text) <= 1600),
rq AS (SELECT book_id, batch, count(*) AS n, min_by(length(text), slot) AS k, '[' || string_agg('{{"id": ' || slot || ', "text": ' || CAST(to_json(text) AS VARCHAR) || '}}', ', ' ORDER BY slot) || ']' AS request FROM sel GROUP BY ALL),
kd AS (SELECT *, CASE WHEN k % 31 = 30 THEN 'ConnectionError' WHEN k % 8 = 6 THEN 'ValueError' ELSE 'answered' END AS own, strlen(request) + {len(INSTRUCTIONS) + U.OVERHEAD} + 2 * greatest(300, least(32000, 220 * n)) AS worst FROM rq),
co AS (SELECT *, CASE WHEN own = 'answered' THEN length(request) + 20 * n ELSE 0 END AS cost FROM kd),
# AS (SELECT *, coalesce(sum(cost) OVER w, 0) AS before, coalesce(bool_or(own = 'ConnectionError') OVER w, false) AS gone FROM co WINDOW w AS (PARTITION BY book_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ov AS (SELECT *, before + worst > {LIMIT} OR before >= {LIMIT} AS over FROM #),
st AS (SELECT *, coalesce(bool_or(over) OVER (PARTITION BY book_id ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM ov),
cl AS (SELECT *, CASE WHEN late OR gone THEN 'stopped' WHEN over THEN 'cost_limit' ELSE own END AS status FROM st)""".replace("#", "bf")
_WRONG = "CASE k % 8 WHEN 1 THEN 'no json' WHEN 2 THEN 'fields' WHEN 3 THEN 'fields' WHEN 4 THEN 'fields' WHEN 5 THEN 'ids' END"
ORACLE_SQL = {
    "budget_in_order": f"{_CALLS} SELECT book_id, batch, status, CAST(sum(CASE WHEN status = 'answered' THEN cost ELSE 0 END) OVER (PARTITION BY book_id ORDER BY batch) AS BIGINT) AS spent FROM cl",
    "answer_schema": f"{_CALLS} SELECT book_id, batch, {_WRONG} AS problem FROM bf WHERE own = 'answered' AND NOT gone",
    "judge_once": f"{_CALLS} SELECT book_id, batch, slot AS id, CASE WHEN good THEN 'ai' ELSE 'fallback' END AS source, CASE WHEN good THEN CAST(length(text) % 4 AS INT) END AS heading_level FROM sel JOIN (SELECT book_id, batch, own = 'answered' AND NOT gone AND {_WRONG} IS NULL AS good FROM bf) USING (book_id, batch)",
    "usage_of_calls": f"{_CALLS}, e AS (SELECT book_id, length(request) AS i, 10 * n AS o, unnest(['headings', 'glosses']) AS feature, unnest([0, 1]) AS j FROM cl WHERE status = 'answered'), sp AS (SELECT book_id, feature, i // 2 + CASE WHEN j < i % 2 THEN 1 ELSE 0 END AS i, o // 2 + CASE WHEN j < o % 2 THEN 1 ELSE 0 END AS o FROM e) SELECT book_id, feature, count(*) AS requests, CAST(sum(i) AS BIGINT) AS input, CAST(sum(o) AS BIGINT) AS output, CAST(sum(i + 2 * o) AS BIGINT) AS cost FROM sp GROUP BY book_id, feature",
}
