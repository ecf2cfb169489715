"""From pages to published books in one call: margins and notes, paragraphs, judgement, the listening text, packaging, checks."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import answers as S
from folioflow.operators import budget as U
from folioflow.operators import calls as C
from folioflow.operators import judging as J
from folioflow.operators import layout as L
from folioflow.operators import notes as N
from folioflow.sources import archive as A
from folioflow.sources import stores
from folioflow.sources.ledger import Ledger


@dataclass(frozen=True)
class Options:
    """What a run does beside the plain steps. Judges, services, prices and the spacing proposer are the caller's; none is built in.

    A service is called batch by batch, in order, within its limit, for reviews and, if boundaries says so, for boundaries; a
    judge is asked about all questions at once.
    """

    reconstruct: bool = False
    footnotes: bool = False
    join: bool = True
    keep_brackets: bool = False
    reviews: frozenset[str] = frozenset()
    rule: str = ""
    model: str = ""
    limit: float | None = None
    price: float = 0.0
    output_price: float = 0.0
    judge: J.Judge | None = None
    boundary_judge: J.Judge | None = None
    service: C.Service | None = None
    boundaries: bool = False
    instructions: tuple[str, str] = ("", "")
    analyse: Callable[[str], list[str]] | None = None
    spacing: Callable[[Column], Column] | None = None
    check: Callable[[Column], Column] = field(default=A.problem)

    def __post_init__(self):
        if (self.boundary_judge or self.boundaries or self.reviews) and not self.reconstruct:
            raise ValueError("judgement needs reconstructed paragraphs")
        if self.reviews and not (self.judge or self.service):
            raise ValueError("reviews need a judge or a service")
        if self.boundaries and not self.service:
            raise ValueError("boundaries need a service")
        if self.analyse and not (self.reconstruct and self.join):
            raise ValueError("an analyser needs reconstructed paragraphs that are joined")
        if wrong := sorted(set(self.reviews) - set(T.REVIEWS)):
            raise ValueError(f"no such reviews: {', '.join(wrong)}")
        for limit in (self.limit, self.service and self.service.limit):
            if limit is not None and limit < 0:
                raise ValueError("a limit is not below 0")

    @property
    def features(self) -> list[str]:
        return S.with_rule(sorted(self.reviews), self.rule)

    @property
    def key(self) -> str:
        """What the results hang on, of the options that are plain values."""
        plain = {f.name: getattr(self, f.name) for f in fields(self)}
        return stores.settings_key({k: sorted(v) if isinstance(v, frozenset) else v for k, v in plain.items() if isinstance(v, (bool, str, float, frozenset, type(None)))})


def flagged(blocks: DataFrame, options: Options) -> DataFrame:
    """blocks with what isn't read as columns: margins, and notes if the options say so."""
    margins = L.margins(blocks)
    return L.flagged(N.marked(blocks), margins, also=F.col("note") | F.col("ref")).drop("note", "ref") if options.footnotes else L.flagged(blocks, margins)


def removed_ids(rows: DataFrame) -> DataFrame:
    """book_id, page, id of the margins and notes among flagged blocks."""
    return rows.where("gone").select(*L.KEYS)


def drafts(rows: DataFrame, options: Options) -> DataFrame:
    """book_id, ord, text, kind, sources of flagged blocks, before anything is joined by context."""
    if options.reconstruct:
        return L.reconstruct(L.line_features(N.visual_lines(L.lines_of(rows))))
    order = F.row_number().over(Window.partitionBy("book_id").orderBy("page", "first"))
    simple = L.paragraphs_of(rows).where("not stray").withColumn("ord", order)
    return simple.select("book_id", "ord", "text", F.lit("body").alias("kind"), F.transform("ids", lambda i: F.struct(F.col("page").alias("page"), i.alias("block_id"))).alias("sources"))


def spaced(found: DataFrame, options: Options) -> DataFrame:
    """book_id, ord, text, kind, heading_level, sources, before_spacing."""
    text = T.correct_spacing(F.col("text"), options.spacing(F.col("text"))) if options.spacing else F.col("text")
    return found.select("book_id", "ord", text.alias("text"), "kind", F.lit(0).alias("heading_level"), "sources", F.col("text").alias("before_spacing"))


def reviewed(found: DataFrame, options: Options, cache: DataFrame, judge: J.Judge | None = None, store: str | None = None) -> DataFrame:
    """found with what the judge, or a cache of its answers, changed; source tells which of them, and key and answer go to the cache."""
    if not options.reviews:
        return found.withColumns({"source": F.lit("local"), "key": F.lit(None).cast("string"), "answer": F.lit(None).cast("string"), "before": F.col("text")})
    needs = T.needs_review(F.col("text"), F.col("kind"), options.reviews)
    return J.enhanced(found.drop("heading_level"), judge or options.judge, needs, cache, options.model, options.features, options.limit, options.price, options.output_price, store)


CALLED = "pass string, " + C.CALLS


def convert(spark: SparkSession, blocks: DataFrame, out: str, options: Options = Options(), resume: bool = False, force: bool = False, titles: DataFrame | None = None) -> DataFrame:
    """From blocks to published books; returns book_id, problem of the books that weren't published. titles: book_id, title.

    Tables of the run, each written once and read by the next step: out/blocks (with flags), out/drafts, out/boundaries (how
    each was decided), out/clean (paragraphs), out/removed (ids), out/audit (each judged paragraph, before and after), out/usage
    (of calls), out/summary (sources by book), out/books (published); answers are added to out/cache. out/ledger names the steps
    that are done. A run at a folder that has one is an error, unless it goes on (resume: with the same options, from the first
    step that isn't done, no question asked twice) or is forced (a new generation, beside the old tables).
    """
    run = Ledger(spark, out, options.key, resume, force)
    calls, cache = run.folder("calls"), f"{out}/cache"
    rows = run.step("blocks", lambda: flagged(blocks, options))
    found = run.step("drafts", lambda: drafts(rows, options))
    service, form = options.service, S.enhance_form(options.features)

    def called(name: str) -> DataFrame:
        """CALLS of a pass over boundaries or paragraphs; none where it made no calls."""
        path = f"{calls}/{name}/made"
        return spark.read.schema(C.CALLS).parquet(path) if stores.exists(spark, path) else spark.createDataFrame([], C.CALLS)

    if options.boundaries or options.boundary_judge:
        ceiling = lambda n, size, length: U.output_ceilings(n, size, length)["boundary"]
        judge = C.judge(service, options.instructions[0], S.BOUNDARIES, {"left": "left", "right": "right"}, ceiling, f"{calls}/boundary/made") if options.boundaries else options.boundary_judge
        found = run.step("boundaries", lambda: J.decided(found, judge, store=f"{calls}/boundary"))
        found = J.united(found)
    elif options.analyse:
        found = L.merge_with(found, options.analyse)
    elif options.join and options.reconstruct:
        found = L.merge_by_context(found)

    def clean() -> DataFrame:
        judge = options.judge
        if service and options.reviews:
            ceiling = lambda n, size, length: U.output_ceilings(n, size, length)["enhance_spacing" if "spacing" in options.reviews else "enhance"]
            judge = C.judge(service, options.instructions[1], form, {"text": "text", "current_kind": "kind"}, ceiling, f"{calls}/enhance/made", called("boundary"))
        return reviewed(spaced(found, options), options, stores.read_cache(spark, cache), judge, f"{calls}/enhance")

    final = run.step("clean", clean)
    run.step("removed", lambda: removed_ids(rows))
    judged = final.where("source <> 'local'")
    run.step("audit", lambda: judged.select("book_id", "ord", "source", "key", "before", F.col("text").alias("after"), "answer"))
    run.step("summary", lambda: J.audit_summary(final).withColumns({"model": F.lit(options.model), "reviews": F.lit(",".join(sorted(options.reviews)))}))
    if service:
        parts = lambda: C.usage(called("boundary"), ["boundary"], service).unionByName(C.usage(called("enhance"), options.features, service))
        run.step("usage", lambda: U.snapshot(parts(), "book_id", math.inf if service.limit is None else service.limit))
    run.run("cache", lambda: stores.add_to_cache(judged.where("source = 'ai'").select("key", F.col("answer").alias("value")), cache), lambda: final)
    books = run.folder("books")

    def publish() -> None:
        if not stores.exists(spark, books):  # else it was published, and not entered
            text = final.where("text <> ''") if options.keep_brackets else L.listening(final)
            A.published(A.package(A.fragments(text), titles=titles), books, options.check)

    return run.run("books", publish, lambda: A.problems(spark, books))


def estimate(blocks: DataFrame, features: list[str], price: float, output_price: float) -> DataFrame:
    """What a run over many books would use at most: sums of tokens, the largest cost of a book."""
    books = blocks.groupBy("book_id").agg(F.max("page").cast("long").alias("pages")).withColumn("features", F.array(*map(F.lit, features)))
    return U.batch_estimate(U.book_estimate(books), price, output_price)
