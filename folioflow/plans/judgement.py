"""Queries of notes, review, budgets and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import budget as U
from folioflow.operators import layout as L
from folioflow.operators import notes as N
from folioflow.operators import review as R
from folioflow.plans.layouts import _NUMBER, _SIMPLE
from folioflow.functions import text as T
from folioflow.plans.texts import _FIGURE, _STRIP, _TIDY
from folioflow.sources import blocks as B
from folioflow.sources import stores

c = F.col


def noted(spark, sf_dir):
    """Blocks with notes in small type at the foot of every third page, and superscripts at a line's end."""
    b = B.document_blocks(spark, sf_dir)
    note = (c("page") % 3 == 0) & (c("y0") > c("height") * F.lit(0.6)) & (c("type") == "line") & (c("id") != "foot")
    # a line and its superscript are one array, so that blocks are made once for both
    names = ("id", "text", "x0", "y0", "x1", "y1")
    line = F.struct("id", F.when(note, F.concat((c("pos") % 9 + 1).cast("string"), F.lit(") "), c("text"))).otherwise(c("text")).alias("text"), "x0", "y0", "x1", F.when(note, c("y0") + 11).otherwise(c("y1")).alias("y1"))
    sup = F.struct(F.concat(F.lit("sup"), c("pos").cast("string")).alias("id"), (c("pos") + 1).cast("string").alias("text"), (c("x1") - 2).alias("x0"), (c("y0") - 2).alias("y0"), (c("x1") + 6).alias("x1"), (c("y0") + 8).alias("y1"))
    rows = b.withColumn("b", F.explode(F.when((c("page") % 3 == 0) & c("pos").isin(4, 5), F.array(line, sup)).otherwise(F.array(line))))
    return rows.select(*[c(f"b.{x}").alias(x) if x in names else x for x in b.columns])


_NOTED = f"""WITH {B.BLOCKS_SQL}, noted AS (SELECT * REPLACE (CASE WHEN hit THEN y0 + 11 ELSE y1 END AS y1, CASE WHEN hit THEN (pos % 9 + 1) || ') ' || text ELSE text END AS text)
 FROM (SELECT *, page % 3 = 0 AND y0 > height * 0.6::double AND type = 'line' AND id <> 'foot' AS hit FROM blocks)
 UNION ALL SELECT book_id, page, width, height, pos, 'sup' || pos, CAST(pos + 1 AS VARCHAR), x1 - 2, y0 - 2, x1 + 6, y0 + 8, confidence, reading_order, type, false FROM blocks WHERE page % 3 = 0 AND pos IN (4, 5)),
nt AS (SELECT book_id, page, id, CAST(regexp_extract(text, '^([0-9])\\) ', 1) AS INT) AS n FROM noted WHERE hit),
rest AS (SELECT *, {_STRIP % "text"} AS t FROM noted WHERE NOT hit)"""


#: Footnotes: the first compact run of small type in a region that a marker opens. No line of this layout is set off by a gap
#: as wide as a run without a marker needs.
_FOOT = f"""{_NOTED.split(",\nnt AS")[0].replace(", noted AS", ", noted_ AS")}, noted AS (SELECT *, {_STRIP % "text"} AS t, y1 - y0 AS tall, CASE WHEN id LIKE 'region-%' THEN split_part(id, ':', 1) ELSE 'body' END AS region FROM noted_),
us AS (SELECT book_id, page, region, coalesce(median(tall) FILTER (WHERE type <> 'heading' AND y0 > 0.15::double * height AND y0 < 0.5::double * height AND length(t) > 3), median(tall) FILTER (WHERE type <> 'heading' AND y0 < 0.72::double * height), 0) AS usual FROM noted GROUP BY ALL),
od AS (SELECT *, row_number() OVER (PARTITION BY book_id, page, region ORDER BY reading_order, pos) AS i FROM noted JOIN us USING (book_id, page, region) WHERE usual > 0),
ws AS (SELECT *, row_number() OVER (PARTITION BY book_id, page, region ORDER BY i) AS w FROM od WHERE type <> 'heading' AND y0 > 0.1::double * height AND x1 - x0 > 0.45::double * width),
sa AS (SELECT o.book_id, o.page, o.region, o.i, any_value(o.usual) AS usual, any_value(o.y0) AS y0, max(w.w) AS lastw FROM od o LEFT JOIN ws w ON w.book_id = o.book_id AND w.page = o.page AND w.region = o.region AND w.i < o.i
 WHERE o.type <> 'heading' AND o.y0 >= 0.45::double * o.height AND regexp_matches(o.t, '^(\\(?[0-9]{{1,3}}\\)|\\[[0-9]{{1,3}}\\]|[0-9]{{1,3}}\\.\\s|[*†‡§])\\s*\\S') GROUP BY o.book_id, o.page, o.region, o.i),
sz AS (SELECT s.book_id, s.page, s.region, s.i, any_value(s.y0) AS sy, coalesce(median(w.tall), any_value(s.usual)) AS size FROM sa s LEFT JOIN ws w ON w.book_id = s.book_id AND w.page = s.page AND w.region = s.region AND w.w > s.lastw - 3 AND w.w <= s.lastw GROUP BY s.book_id, s.page, s.region, s.i),
st AS (SELECT z.*, coalesce(min(o.i) FILTER (WHERE o.type = 'heading' OR o.y0 < sy - size OR o.tall > 1.15::double * size), max(o.i) + 1) AS stop FROM sz z JOIN od o ON o.book_id = z.book_id AND o.page = z.page AND o.region = z.region AND o.i >= z.i GROUP BY ALL),
ok AS (SELECT s.book_id, s.page, s.region, s.i, any_value(stop) AS stop FROM st s JOIN od o ON o.book_id = s.book_id AND o.page = s.page AND o.region = s.region AND o.i >= s.i AND o.i < s.stop AND o.t <> '' AND NOT regexp_matches(o.t, '^\\p{{Nd}}+$') GROUP BY s.book_id, s.page, s.region, s.i HAVING median(o.tall) <= 0.94::double * any_value(size)),
fi AS (SELECT book_id, page, region, min(i) AS i, arg_min(stop, i) AS stop FROM ok GROUP BY ALL),
fn AS (SELECT o.book_id, o.page, o.id, o.t FROM od o JOIN fi ON o.book_id = fi.book_id AND o.page = fi.page AND o.region = fi.region AND o.i >= fi.i AND o.i < fi.stop WHERE o.t <> '' AND NOT regexp_matches(o.t, '^\\p{{Nd}}+$')),
nt AS (SELECT *, CAST(nullif(regexp_extract(t, '^[\\[(]?([0-9]{{1,3}})[.)\\]]', 1), '') AS INT) AS n FROM fn), rest AS (SELECT * FROM noted ANTI JOIN fn USING (book_id, page, id))"""
_REFS = """SELECT DISTINCT s.book_id, s.page, s.id FROM rest s JOIN nt ON s.book_id = nt.book_id AND s.page = nt.page AND CAST(nt.n AS VARCHAR) = s.t JOIN rest b ON b.book_id = s.book_id AND b.page = s.page AND b.id <> s.id
 WHERE regexp_matches(s.t, '^[0-9]{1,3}$') AND length(b.t) >= 8 AND s.y1 > s.y0 AND s.y1 - s.y0 <= (b.y1 - b.y0) * 0.85::double AND s.x0 BETWEEN b.x1 - (b.y1 - b.y0) * 0.6::double AND b.x1 + (b.y1 - b.y0) * 0.7::double
 AND s.y0 BETWEEN b.y0 - (b.y1 - b.y0) * 0.4::double AND b.y0 + (b.y1 - b.y0) * 0.25::double AND s.y1 <= b.y1"""
_NOTELESS = (
    _SIMPLE.replace(f"WITH {B.BLOCKS_SQL}", _FOOT.replace("blocks AS (", "plain AS (", 1).replace("FROM blocks", "FROM plain") + f", rf AS ({_REFS}), blocks AS (SELECT * FROM noted_)", 1)
    .replace("margin AS (SELECT * FROM m1 UNION SELECT * FROM m2)", "margin AS (SELECT * FROM m1 UNION SELECT * FROM m2 UNION SELECT book_id, page, id FROM fn UNION SELECT * FROM rf)").replace("nt AS (SELECT *, regexp_replace(regexp_replace", "mt AS (SELECT *, regexp_replace(regexp_replace").replace("FROM nt a JOIN nt b", "FROM mt a JOIN mt b")
    .replace("s AS (SELECT *, CASE WHEN coalesce", "sx AS (SELECT *, CASE WHEN coalesce").replace("AS para FROM s),", "AS para FROM sx),")
)


def paragraphs(spark, sf_dir):
    blocks = B.document_blocks(spark, sf_dir)
    return L.simple_paragraphs(blocks, L.margins(blocks)).where("not stray").select("book_id", "page", "first", "text")


def selected(spark, sf_dir):
    """Paragraphs that go to judgement, in batches; long ones leave after they are numbered."""
    rows = R.batches(paragraphs(spark, sf_dir).where(T.needs_review(c("text"), F.lit("body"), {"headings", "glosses"})), "book_id", ["page", "first"], R.ENHANCE)
    return rows.where(F.length("text") <= R.LONGEST).withColumn("key", R.cache_key(c("text"), "m1", ["spacing", "glosses"]))


_HEAD = "(length(text) <= 60 AND NOT regexp_matches(regexp_replace(text, '[\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', ''), '[.!?。」』\"''’”)\\]]$'))"
_BATCHED = f"""{_SIMPLE}, rv AS (SELECT book_id, page, first, text FROM simple WHERE NOT stray AND ({_HEAD} OR regexp_matches(text, '[()（）]'))),
nb AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page, first) - 1 AS n FROM rv),
sel AS (SELECT book_id, page, first, text, CAST(n // 24 AS INT) AS batch, CAST(n % 24 AS INT) AS slot, sha256('{{"features": ["glosses", "spacing"], "model": "m1", "schema": 1, "text": ' || CAST(to_json(text) AS VARCHAR) || '}}') AS key FROM nb WHERE length(text) <= 1600),
cache AS (SELECT key, min('v' || page) AS value FROM sel WHERE page % 2 = 0 GROUP BY key)"""


def _cached(hit):
    def query(spark, sf_dir):
        rows = selected(spark, sf_dir)
        cache = rows.where("page % 2 = 0").select("key", F.concat(F.lit("v"), c("page").cast("string")).alias("value"))
        return R.split_cached(rows, cache)[0 if hit else 1].select("book_id", "page", "first", "key", *(["value"] if hit else []))

    return query


def _answers(spark, sf_dir):
    ask = stores.kept(spark, lambda: selected(spark, sf_dir).select("book_id", "batch", c("slot").alias("id")))
    got = ask.withColumn("answer", F.concat(F.lit("a"), c("id").cast("string")))
    got = got.where("not (batch % 5 = 2 and id = 0)")
    twice = got.where("batch % 7 = 3 and id = 1")
    return R.answered(ask, got.unionByName(twice))


def calls(spark, sf_dir):
    """Turns of conversations as outside calls: tokens from the text's length, features by turn."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    names = F.when(c("turn") % 3 == 0, F.array(F.lit("spacing"), F.lit("glosses"), F.lit("spacing"))).when(c("turn") % 3 == 1, F.array(F.lit("headings"))).otherwise(F.array(F.lit("figures"), F.lit("headings"), F.lit("ocr_words")))
    return rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), n.alias("input"), (n % 97).alias("output"), (n % 13).alias("cached"), names.alias("features"))


_CALLS = "WITH calls AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS input, length(coalesce(text, '')) % 97 AS output, length(coalesce(text, '')) % 13 AS cached, CASE turn % 3 WHEN 0 THEN ['spacing', 'glosses'] WHEN 1 THEN ['headings'] ELSE ['figures', 'headings', 'ocr_words'] END AS names FROM conversations)"
_PRICE = "(((input - greatest(0, least(cached, input))) * 0.3::double + greatest(0, least(cached, input)) * 0.03::double + output * 1.7::double) / 1e6::double)"
_PARTS = f"{_CALLS}, ex AS (SELECT conv_id, turn, input, output, cached, len(names) AS n, unnest(names) AS feature, unnest(range(len(names))) AS k FROM calls), parts AS (SELECT conv_id, turn, feature, input // n + CASE WHEN k < input % n THEN 1 ELSE 0 END AS input_part, output // n + CASE WHEN k < output % n THEN 1 ELSE 0 END AS output_part, cached // n + CASE WHEN k < cached % n THEN 1 ELSE 0 END AS cached_part FROM ex)"
_COST = "((input_part - least(cached_part, input_part)) * 0.3::double + least(cached_part, input_part) * 0.03::double + output_part * 1.7::double) / 1e6::double"


def _cost(i="input", o="output", k="cached"):
    return U.token_cost(c(i), c(o), c(k), F.lit(0.3), F.lit(0.03), F.lit(1.7))


def _parts(spark, sf_dir):
    return U.split_usage(calls(spark, sf_dir)).withColumn("cost", _cost("input_part", "output_part", "cached_part"))


def rates(spark):
    """A small dimension of prices per million tokens, as a caller would supply."""
    rows = [("user", "a", 0.25, 0.025, 2.0, True), ("user", "b", 1.0, 0.1, 8.0, True), ("assistant", "a", 0.5, 0.05, 4.0, False)]
    return spark.createDataFrame(rows, "provider string, model string, input_price double, cached_price double, output_price double, verified boolean")


def event_rates(spark, sf_dir):
    """A registry as a caller's table would hold it: what each sort of event costs each user, by events; some unverified."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(c("o_orderpriority").alias("provider"), c("o_custkey").cast("string").alias("model"))
    rows = rows.agg(F.count("*").alias("n"), F.max("o_orderkey").alias("k"))
    price = lambda x: (x % 97 + 1).cast("double") / 8
    return rows.select("provider", "model", price(c("k")).alias("input_price"), (price(c("k")) / 4).alias("cached_price"), price(c("k") + c("n")).alias("output_price"), (c("k") % 3 != 0).alias("verified"))


_EVENT_RATES = """rates AS (SELECT o_orderpriority AS provider, CAST(o_custkey AS VARCHAR) AS model, (max(o_orderkey) % 97 + 1)::double / 8 AS input_price, (max(o_orderkey) % 97 + 1)::double / 8 / 4 AS cached_price,
 ((max(o_orderkey) + count(*)) % 97 + 1)::double / 8 AS output_price, max(o_orderkey) % 3 <> 0 AS verified FROM orders GROUP BY ALL)"""
_RATES = "rates AS (SELECT * FROM (VALUES ('user', 'a', 0.25::double, 0.025::double, 2.0::double, true), ('user', 'b', 1.0, 0.1, 8.0, true), ('assistant', 'a', 0.5, 0.05, 4.0, false)) v(provider, model, input_price, cached_price, output_price, verified))"
_LIMIT = 0.000800005


def _rated(spark, sf_dir):
    rows = calls(spark, sf_dir).select("conv_id", "turn", c("role").alias("provider"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("z")), (c("turn") % 3 + 1).cast("int")).alias("model"))
    return U.rated(rows, rates(spark)).select("conv_id", "turn", "provider", "model", "input_price", "cached_price", "output_price", "verified")


def _admission(spark, sf_dir):
    worst = (U.input_ceiling(c("text")) * 0.25 + 300 * 2.0) / 1e6
    return U.admitted(calls(spark, sf_dir).withColumn("worst", worst), "conv_id", ["turn"], _LIMIT * 3).select("conv_id", "turn", "admitted")


def _release(spark, sf_dir):
    """Two calls run at once; the others' costs are known."""
    worst = (U.input_ceiling(c("text")) * 0.3 + 300 * 1.7) / 1e6
    rows = calls(spark, sf_dir).withColumns({"worst": worst, "cost": _cost()})
    return U.admitted(rows, "conv_id", ["turn"], _LIMIT * 2, "cost", 1).select("conv_id", "turn", "admitted")


def _shown(usage):
    """Costs in units of 1e-8, which both engines write alike."""
    unit = lambda x: F.round(x * F.lit(1e8)).cast("long")
    costs = F.transform(F.map_entries("features"), lambda e: F.concat(e["key"], F.lit("="), unit(e["value"]).cast("string")))
    return usage.withColumns({"cost": unit(c("cost")), "features": F.array_join(F.array_sort(costs), ",")})


def _without_notes(spark, sf_dir):
    """Simple paragraphs of pages without their heads, notes and references to notes, and the ids that were removed."""
    blocks = noted(spark, sf_dir)
    rows = stores.kept(spark, lambda: L.flagged(N.marked(blocks), L.margins(blocks), also=c("note") | c("ref")))
    paragraphs = L.paragraphs_of(rows).select("book_id", "page", "first", "text", F.array_join("ids", ",").alias("ids"))
    gone = L.removed_of(rows).select("book_id", "page", F.lit(None).cast("int").alias("first"), F.lit(None).cast("string").alias("text"), "ids")
    return paragraphs.unionByName(gone)


def _books(spark, sf_dir):
    return B.document_blocks(spark, sf_dir).groupBy("book_id").agg(F.max("page").cast("long").alias("pages"), F.count("*").alias("blocks"), F.sum(F.length("text")).alias("characters"))


_BOOKS = f"WITH {B.BLOCKS_SQL}, books AS (SELECT book_id, CAST(max(page) AS BIGINT) AS pages, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS characters FROM blocks GROUP BY book_id)"
_FEATURES = ["boundary", "spacing", "glosses", "figures"]


def _glosses(spark, sf_dir):
    rows = paragraphs(spark, sf_dir)
    spans = F.array(F.substring("text", 1, 4), F.lit("zz not there"), F.right("text", F.lit(3)))
    return rows.select("book_id", "page", "first", R.apply_glosses(c("text"), spans).alias("text"))


def _edits(spark, sf_dir):
    rows = paragraphs(spark, sf_dir)
    word = F.regexp_extract("text", r"([A-Za-z]{6,12})", 1)
    e = F.array(F.struct(word.alias("before"), F.concat(word, F.lit("s")).alias("after"), F.lit(0.95).alias("confidence")), F.struct(F.lit("the").alias("before"), F.lit("teh").alias("after"), F.lit(0.5).alias("confidence")))
    return rows.select("book_id", "page", "first", R.apply_edits("text", e).alias("text"))


def _resolve(spark, sf_dir):
    rows = paragraphs(spark, sf_dir).withColumns({
        "kind": F.lit("body"), "new_kind": F.when(c("first") % 3 == 0, "heading").when(c("first") % 3 == 1, "unchanged"), "heading_level": F.when(c("page") % 4 == 0, c("first") % 3), "figure_residue": c("page") % 2 == 0,
    })
    return R.resolved(rows).select("book_id", "page", "first", "text", "kind", "heading_level")


def _plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(c("source").alias("document"), c("doc_id").alias("idx"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"action": F.when(c("idx") % 3 == 0, "keep").when(c("idx") % 3 == 1, "replace").otherwise("delete"), "new_text": F.when(c("idx") % 2 == 0, F.substring("text", 1, 40)).otherwise(" ")})
    return rows


_PLAN = f"pl AS (SELECT source AS document, doc_id AS idx, coalesce(text, '') AS text, CASE doc_id % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'replace' ELSE 'delete' END AS action, CASE WHEN doc_id % 2 = 0 THEN left(coalesce(text, ''), 40) ELSE ' ' END AS new_text FROM documents), ch AS (SELECT document, idx, text AS before, CASE WHEN action = 'replace' THEN {_STRIP % 'new_text'} END AS after FROM pl WHERE action = 'delete' OR (action = 'replace' AND {_STRIP % 'new_text'} <> '' AND {_STRIP % 'new_text'} <> {_STRIP % 'text'}))"


def _apply(spark, sf_dir):
    rows = _plan(spark, sf_dir)
    plan = R.planned(rows)
    twice = plan.withColumn("seq", F.lit(1)).unionByName(plan.where("idx % 4 = 1").withColumns({"after": F.lit("last wins"), "seq": F.lit(2)}))
    return R.applied(rows.select("document", "idx", "text"), twice)


def _progress(spark, sf_dir):
    chunks = U.chunk_plan(_books(spark, sf_dir), 3, 4)
    return U.page_progress(chunks.withColumn("at", F.when(c("first") % 2 == 1, c("first") + 2)))


def _names(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = docs.select(c("source").alias("folder"), (c("doc_id") % 4).cast("int").alias("idx"), F.concat(F.when(c("doc_id") % 2 == 0, "Book").otherwise("book"), c("lang")).alias("stem"), "doc_id")
    files = files.groupBy("folder", "idx", "stem").count().drop("count")
    taken = files.where("idx = 1").select("folder", F.format_string("%03d_%s.epub", "idx", F.lower("stem")).alias("name")).distinct()
    return U.output_names(files, taken)


_NAMES = """WITH f AS (SELECT DISTINCT source AS folder, CAST(doc_id % 4 AS INT) AS idx, CASE WHEN doc_id % 2 = 0 THEN 'Book' ELSE 'book' END || lang AS stem FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY folder, idx, lower(stem) ORDER BY stem) + CASE WHEN idx = 1 THEN 1 ELSE 0 END AS n FROM f)
SELECT folder, idx, stem, printf('%03d_%s', idx, stem) || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.epub' AS name FROM k"""


QUERIES = {
    "footnotes": lambda s, d: N.footnotes(noted(s, d)),
    "superscript_refs": lambda s, d: N.superscripts(noted(s, d), noted(s, d).where(c("text").rlike(r"\A[0-9]\) ") & (c("y1") - c("y0") == 11)).select("book_id", "page", "id")),
    "paragraphs_without_notes": _without_notes,
    "review_batches": lambda s, d: selected(s, d).select("book_id", "page", "first", "batch", "slot"),
    "cache_hits": _cached(True),
    "cache_misses": _cached(False),
    "answer_check": _answers,
    "token_cost": lambda s, d: calls(s, d).select("conv_id", "turn", _cost().alias("cost")),
    "token_ceilings": lambda s, d: calls(s, d).groupBy("conv_id").agg(F.count("*").alias("items"), F.sum(F.octet_length("text")).alias("size"), F.sum(F.length("text")).alias("length")).select("conv_id", *[x.alias(n) for n, x in U.output_ceilings(c("items"), c("size"), c("length")).items()]),
    "usage_split": lambda s, d: _parts(s, d).select("conv_id", "turn", "feature", "input_part", "output_part", "cached_part"),
    "usage_rollup": lambda s, d: _shown(U.rollup(U.snapshot(_parts(s, d), "conv_id", _LIMIT))),
    "usage_snapshot": lambda s, d: _shown(U.snapshot(_parts(s, d), "conv_id", _LIMIT)),
    "default_models": lambda s, d: U.default_models(event_rates(s, d)),
    "budget_release": _release,
    "model_rates": _rated,
    "budget_admission": _admission,
    "book_estimate": lambda s, d: U.book_estimate(_books(s, d).withColumn("features", F.array(*map(F.lit, _FEATURES)))).select("book_id", "input", "output", "most_output", "most_input"),
    "edit_estimate": lambda s, d: U.edit_estimate(_books(s, d)).select("book_id", "input", "output", "most_output", "most_input"),
    "batch_estimate": lambda s, d: U.batch_estimate(U.edit_estimate(_books(s, d)), 0.3, 1.7),
    "apply_edits": _edits,
    "apply_glosses": _glosses,
    "resolve_kind": _resolve,
    "plan_changes": lambda s, d: R.planned(_plan(s, d)),
    "apply_plan": _apply,
    "book_stats": lambda s, d: U.book_stats(B.document_blocks(s, d)),
    "chunk_plan": lambda s, d: U.chunk_plan(_books(s, d), 3, 4),
    "page_progress": _progress,
    "output_names": _names,
}

_SNAPSHOT = f"""{_PARTS}, pf AS (SELECT conv_id, feature, sum(input_part) AS input, sum(output_part) AS output, CAST(round(sum({_COST}) * 1e8) AS BIGINT) AS cost FROM parts GROUP BY ALL),
sn AS (SELECT conv_id, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cost) AS BIGINT) AS cost, sum(cost) >= {_LIMIT}::double * 1e8 AS limit_reached, string_agg(feature || '=' || cost, ',' ORDER BY feature) AS features FROM pf GROUP BY conv_id)"""
#: A span (2nd of each pair) cut out of a value, if it is there once and a third of it at most.
_CUT = "CASE WHEN length(@v) >= 3 * length(@s) AND length(@v) - length(replace(@v, @s, '')) = length(@s) THEN " + _TIDY % "replace(@v, @s, '')" + " ELSE @v END"
_cut = lambda value, span: _CUT.replace("@v", value).replace("@s", span)
_CHUNKS = f"{_BOOKS}, cs AS (SELECT *, greatest(1, least(3, pages // 4)) AS n FROM books), cz AS (SELECT *, CAST(ceil(pages / n) AS BIGINT) AS size FROM cs), ck AS (SELECT book_id, pages, size, unnest(range(1, pages + 1, size)) AS first FROM cz), chunks AS (SELECT book_id, first, least(pages, first + size - 1) AS last FROM ck)"
ORACLE_SQL = {
    "footnotes": f"{_FOOT} SELECT book_id, page, id FROM fn",
    "paragraphs_without_notes": f"{_NOTELESS}, r AS (SELECT book_id, page, 0 AS part, pos, id FROM blocks LEFT JOIN (SELECT *, true AS gone FROM margin) USING (book_id, page, id) WHERE gone OR {_NUMBER} UNION ALL SELECT book_id, page, 1, first, ids FROM simple WHERE stray) SELECT book_id, page, first, text, ids FROM simple UNION ALL SELECT book_id, page, NULL, NULL, string_agg(id, ',' ORDER BY part, pos, id) FROM r GROUP BY book_id, page",
    "superscript_refs": f"{_NOTED} SELECT DISTINCT s.book_id, s.page, s.id FROM rest s JOIN nt ON s.book_id = nt.book_id AND s.page = nt.page AND CAST(nt.n AS VARCHAR) = s.t JOIN rest b ON b.book_id = s.book_id AND b.page = s.page AND b.id <> s.id WHERE regexp_matches(s.t, '^[0-9]{{1,3}}$') AND length(b.t) >= 8 AND s.y1 > s.y0 AND s.y1 - s.y0 <= (b.y1 - b.y0) * 0.85::double AND s.x0 BETWEEN b.x1 - (b.y1 - b.y0) * 0.6::double AND b.x1 + (b.y1 - b.y0) * 0.7::double AND s.y0 BETWEEN b.y0 - (b.y1 - b.y0) * 0.4::double AND b.y0 + (b.y1 - b.y0) * 0.25::double AND s.y1 <= b.y1",
    "review_batches": f"{_BATCHED} SELECT book_id, page, first, batch, slot FROM sel",
    "cache_hits": f"{_BATCHED} SELECT book_id, page, first, key, value FROM sel JOIN cache USING (key)",
    "cache_misses": f"{_BATCHED} SELECT book_id, page, first, key FROM sel ANTI JOIN cache USING (key)",
    "answer_check": f"{_BATCHED}, bad AS (SELECT DISTINCT book_id, batch FROM sel WHERE (batch % 5 = 2 AND slot = 0) OR (batch % 7 = 3 AND slot = 1)) SELECT book_id, batch, slot AS id, CASE WHEN bad.batch IS NULL THEN 'a' || slot END AS answer, CASE WHEN bad.batch IS NULL THEN 'ai' ELSE 'fallback' END AS source FROM sel LEFT JOIN bad USING (book_id, batch)",
    "token_cost": f"{_CALLS} SELECT conv_id, turn, {_PRICE} AS cost FROM calls",
    "token_ceilings": f"{_CALLS}, g AS (SELECT conv_id, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS b, CAST(sum(length(text)) AS BIGINT) AS l FROM calls GROUP BY conv_id) SELECT conv_id, greatest(300, least(32000, 220 * n)) AS enhance, greatest(300, least(32000, 220 * n + b)) AS enhance_spacing, greatest(160, least(1200, 48 * n + 80)) AS boundary, greatest(600, least(32000, l + 200 * n)) AS edit FROM g",
    "usage_split": f"{_PARTS} SELECT * FROM parts",
    "usage_rollup": f"{_SNAPSHOT}, fe AS (SELECT feature, sum(cost) AS cost FROM pf GROUP BY feature) SELECT CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cost) AS BIGINT) AS cost, bool_or(limit_reached) AS limit_reached, (SELECT string_agg(feature || '=' || cost, ',' ORDER BY feature) FROM fe) AS features FROM sn",
    "usage_snapshot": f"{_SNAPSHOT} SELECT conv_id, input, output, cost, limit_reached, features FROM sn",
    "default_models": f"WITH {_EVENT_RATES} SELECT provider, model, input_price, cached_price, output_price FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY NOT verified, output_price, input_price, model) AS k FROM rates) WHERE k = 1",
    "budget_release": f"{_CALLS}, w AS (SELECT conv_id, turn, ((strlen(text) + 768) * 0.3::double + 300 * 1.7::double) / 1e6::double AS worst, {_PRICE} AS cost FROM calls), r AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), 0) + sum(worst) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS spent FROM w) SELECT conv_id, turn, min((spent <= {_LIMIT * 2}::double)::INT) OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS admitted FROM r",
    "apply_glosses": f"{_SIMPLE}, g0 AS (SELECT book_id, page, first, text, left(text, 4) AS s1, right(text, 3) AS s3 FROM simple WHERE NOT stray), g1 AS (SELECT *, {_cut('text', 's1')} AS v1 FROM g0) SELECT book_id, page, first, {_cut('v1', 's3')} AS text FROM g1",
    "model_rates": f"{_CALLS}, {_RATES}, u AS (SELECT conv_id, turn, role AS provider, ['a', 'b', 'z'][turn % 3 + 1] AS model FROM calls), t AS (SELECT provider, max(input_price) AS i, max(cached_price) AS k, max(output_price) AS o FROM rates GROUP BY provider) SELECT conv_id, turn, provider, model, coalesce(input_price, i, 0) AS input_price, coalesce(cached_price, k, 0) AS cached_price, coalesce(output_price, o, 0) AS output_price, coalesce(verified, false) AS verified FROM u LEFT JOIN rates USING (provider, model) LEFT JOIN t USING (provider)",
    "budget_admission": f"{_CALLS}, w AS (SELECT conv_id, turn, sum(((strlen(text) + 768) * 0.25::double + 600.0::double) / 1e6::double) OVER (PARTITION BY conv_id ORDER BY turn) AS spent FROM calls) SELECT conv_id, turn, spent <= {_LIMIT * 3}::double + 1e-12::double AS admitted FROM w",
    "book_estimate": f"{_BOOKS} SELECT book_id, pages * 3200 AS input, pages * 2040 AS output, pages * 4210 AS most_output, CAST(ceil(pages * 3200 * 1.35::double) AS BIGINT) AS most_input FROM books",
    "edit_estimate": f"{_BOOKS} SELECT book_id, characters * 3 + blocks * 40 + 800 * greatest(1, blocks // 16) AS input, blocks * 25 AS output, characters * 3 + blocks * 40 AS most_output, CAST(ceil((characters * 3 + blocks * 40 + 800 * greatest(1, blocks // 16)) * 1.35::double) AS BIGINT) AS most_input FROM books",
    "batch_estimate": f"{_BOOKS}, es AS (SELECT characters * 3 + blocks * 40 + 800 * greatest(1, blocks // 16) AS input, blocks * 25 AS output, characters * 3 + blocks * 40 AS most FROM books) SELECT CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, max((CAST(ceil(input * 1.35::double) AS BIGINT) * 0.3::double + most * 1.7::double) / 1e6::double) AS most_cost FROM es",
    "resolve_kind": f"{_SIMPLE}, rs AS (SELECT book_id, page, first, text, first % 3 AS r, CASE WHEN page % 4 = 0 THEN first % 3 ELSE 0 END AS lv FROM simple WHERE NOT stray) SELECT book_id, page, first, CASE WHEN page % 2 = 0 AND {_FIGURE} THEN '' ELSE text END AS text, CASE WHEN lv > 0 OR r = 0 THEN 'heading' ELSE 'body' END AS kind, lv AS heading_level FROM rs",
    "plan_changes": f"WITH {_PLAN} SELECT * FROM ch",
    "apply_plan": f"WITH {_PLAN}, al AS (SELECT document, idx, CASE WHEN idx % 4 = 1 THEN 'last wins' ELSE after END AS after FROM ch) SELECT document, idx, coalesce(al.after, text) AS text FROM pl LEFT JOIN al USING (document, idx) WHERE NOT (al.idx IS NOT NULL AND al.after IS NULL)",
    "book_stats": f"WITH {B.BLOCKS_SQL} SELECT book_id, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS characters, count(DISTINCT page) AS documents FROM blocks GROUP BY book_id",
    "chunk_plan": f"{_CHUNKS} SELECT * FROM chunks",
    "page_progress": f"{_CHUNKS} SELECT book_id, CAST(sum(CASE WHEN first % 2 = 1 THEN least(last, first + 2) - first + 1 ELSE 0 END) AS BIGINT) AS done, CAST(sum(last - first + 1) AS BIGINT) AS total FROM chunks GROUP BY book_id",
    "output_names": _NAMES,
}
