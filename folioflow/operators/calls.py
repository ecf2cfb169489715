"""Outside calls made once, in order, within a budget.

A book's requests are one stream, sorted by batch: before each call its largest cost is reserved, after it the actual cost is
recorded, and at the limit, or when the service can't be reached, the book's remaining requests are left out for good. The
results are written before anything reads them, so no plan makes a call twice. If an executor is lost, the calls of its
unfinished tasks are made again; those of finished tasks are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators import answers as A
from folioflow.operators import budget as U
from folioflow.operators import review as R
from folioflow.sources import stores


@dataclass(frozen=True)
class Reply:
    """A service's text, and the tokens it says it used."""

    text: str
    input: int = 0
    output: int = 0
    cached: int = 0


#: instructions, request (JSON), schema of the response, most output tokens -> Reply; OSError is a service out of reach.
Caller = Callable[[str, str, dict, int], Reply]
CALLS = "book_id string, batch int, status string, text string, input long, output long, cached long, cost double, spent double"


@dataclass(frozen=True)
class Service:
    """Whom to call, what it costs for a million tokens, and how much a book may cost."""

    complete: Caller
    price: float = 0.0
    cached_price: float = 0.0
    output_price: float = 0.0
    limit: float | None = None
    #: Tasks that call at the same time; each has the books of a share of a hash.
    at_once: int = field(default=64)

    def cost(self, tokens: int, output: int, cached: int = 0) -> float:
        cached = max(0, min(cached, tokens))
        return ((tokens - cached) * self.price + cached * self.cached_price + output * self.output_price) / 1e6


def requests(asked: DataFrame, shown: dict[str, str], most_output: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """book_id, batch, ids, request (a JSON list of objects of id and the columns of shown, by their names there), most_output.

    most_output tells the largest output from the number of items and the bytes and characters of their text.
    """
    text = F.array_join(F.array(*[F.concat(F.lit(f'"{name}": '), R.json_text(F.col(column))) for name, column in shown.items()]), ", ")
    item = F.struct("id", F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit(", "), text, F.lit("}")).alias("json"), F.coalesce("text", F.lit("")).alias("text"))
    rows = asked.groupBy("book_id", "batch").agg(F.array_sort(F.collect_list(item)).alias("items"))  # a batch holds a few dozen
    total = lambda f: F.aggregate("items", F.lit(0), lambda a, x: a + f(x["text"]))
    most = most_output(F.size("items"), total(F.octet_length), total(F.length))
    return rows.select("book_id", F.col("batch").cast("int").alias("batch"), F.transform("items", lambda x: x["id"]).alias("ids"), F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["json"]), ", "), F.lit("]")).alias("request"), most.cast("int").alias("most_output"))


def in_order(rows: Iterator[tuple], service: Service, instructions: str, schema: dict) -> Iterator[tuple]:
    """CALLS of requests (book_id, batch, request, most_output, spent before the book's first) that are sorted by book and batch."""
    book = spent = stopped = None
    for book_id, batch, request, most, before in rows:
        if stopped is None or book_id != book:
            book, spent, stopped = book_id, before or 0.0, ""
        status, reply, cost = "stopped", Reply(""), 0.0
        if not stopped:
            tokens = len((instructions + request).encode()) + U.OVERHEAD
            if service.limit is not None and (spent >= service.limit or spent + service.cost(tokens, most) > service.limit + U.SLACK):
                status = stopped = "cost_limit"
            else:
                try:
                    reply, status = service.complete(instructions, request, schema, most), "answered"
                    cost = service.cost(reply.input, reply.output, reply.cached)
                    spent += cost
                except OSError as e:
                    status = stopped = type(e).__name__
                except (ValueError, KeyError, TypeError) as e:  # this request's failure alone
                    status = type(e).__name__
        yield book_id, batch, status, reply.text if status == "answered" else None, reply.input, reply.output, reply.cached, cost, spent


def made(asked: DataFrame, service: Service, instructions: str, form: A.Form, path: str | None = None, before: DataFrame | None = None) -> DataFrame:
    """CALLS of all requests, written to path (a table that is there is read instead: its calls were made). before: CALLS of
    earlier passes over the same books, whose costs count."""
    spark, schema = asked.sparkSession, form.schema

    def make() -> DataFrame:
        rows = asked.select("book_id", "batch", "request", "most_output")
        if before is None:
            rows = rows.withColumn("before", F.lit(0.0))
        else:
            rows = rows.join(before.groupBy("book_id").agg(F.sum("cost").alias("before")), "book_id", "left")
        # by number, so that the tasks aren't united for being small: they wait rather than work
        rows = rows.repartition(service.at_once, "book_id").sortWithinPartitions("book_id", "batch")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            each = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
            names, kinds = zip(*(x.split() for x in CALLS.split(", ")))
            arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
            for call in in_order(each, service, instructions, schema):
                yield pa.RecordBatch.from_arrays([pa.array([v], arrow[k]) for v, k in zip(call, kinds, strict=True)], list(names))

        return rows.mapInArrow(run, CALLS)

    return stores.kept(spark, make, path)


def judge(service: Service, instructions: str, form: A.Form, shown: dict[str, str], most_output, path: str | None = None, before: DataFrame | None = None):
    """A judge (questions -> answers) that calls the service batch by batch and answers what came back in form."""

    def answers(asked: DataFrame) -> DataFrame:
        # written, as it is read for the calls and for the ids that were asked
        wanted = stores.kept(asked.sparkSession, lambda: requests(asked, shown, most_output))
        found = made(wanted, service, instructions, form, path, before)
        return A.answers(found.join(wanted.select("book_id", "batch", "ids"), ["book_id", "batch"]), form)

    return answers


def usage(calls: DataFrame, features: list[str], service: Service) -> DataFrame:
    """A row for each call that was answered and each feature it was made for, with its share of tokens and its cost."""
    rows = calls.where("status = 'answered'").select("book_id", "batch", "input", "output", "cached", F.array(*map(F.lit, features)).cast("array<string>").alias("features"))
    prices = [F.lit(float(p)) for p in (service.price, service.cached_price, service.output_price)]
    return U.split_usage(rows).withColumn("cost", U.token_cost(F.col("input_part"), F.col("output_part"), F.col("cached_part"), *prices))
