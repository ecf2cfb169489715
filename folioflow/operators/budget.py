"""Tokens, prices and budgets of outside calls, and the planning of runs over many books.

A budget reserves a call's largest possible cost, and gives back what it leaves unused when its own cost is known. Calls are
made in order, so what is spent and reserved before each is a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values
PER_PAGE = {"ocr_words": 45, "spacing": 1900, "anomalies": 35, "structure": 20, "headings": 15, "glosses": 30, "figures": 10}
BOUNDARY_INPUT, BOUNDARY_OUTPUT, BOUNDARY_WORST = 900, 45, 220
CLEANUP_INPUT, CLEANUP_OUTPUT, CLEANUP_WORST = 2300, 55, 280
OVERHEAD, SLACK = 768, 1e-12


def token_cost(tokens: Column, output: Column, cached: Column, price: Column, cached_price: Column, output_price: Column) -> Column:
    """Dollars at prices for a million tokens; cached ones are input ones."""
    c = F.greatest(F.lit(0), F.least(cached, tokens))
    return ((tokens - c) * price + c * cached_price + output * output_price) / F.lit(1e6)


def input_ceiling(text: Column) -> Column:
    return F.octet_length(text) + OVERHEAD


def output_ceilings(items: Column, size: Column, length: Column) -> dict[str, Column]:
    """Largest outputs of a batch: of enhancing with and without spacing, boundaries and edits. size in bytes, length in characters."""
    clamp = lambda low, high, x: F.greatest(F.lit(low), F.least(F.lit(high), x))
    return {
        "enhance": clamp(300, 32000, 220 * items), "enhance_spacing": clamp(300, 32000, 220 * items + size),
        "boundary": clamp(160, 1200, 48 * items + 80), "edit": clamp(600, 32000, length + 200 * items),
    }


def rated(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """usage (provider, model) with prices: the model's, else the provider's highest and unverified, else 0."""
    prices = ["input_price", "cached_price", "output_price"]
    top = rates.groupBy("provider").agg(*[F.max(p).alias(f"top_{p}") for p in prices])
    rows = usage.join(rates, ["provider", "model"], "left").join(top, "provider", "left")
    return rows.withColumns({**{p: F.coalesce(p, f"top_{p}", F.lit(0.0)) for p in prices}, "verified": F.coalesce("verified", F.lit(False))}).drop(*[f"top_{p}" for p in prices])


def registry(rates: DataFrame, defaults: DataFrame) -> DataFrame:
    """A caller's rates, and defaults for what they don't name."""
    return rates.unionByName(defaults.join(rates.select("provider", "model"), ["provider", "model"], "left_anti"))


def default_models(rates: DataFrame) -> DataFrame:
    """provider, model, and prices of each provider's cheapest verified model: by output, then input price, then name."""
    best = F.min(F.struct(F.coalesce(~F.col("verified"), F.lit(True)), "output_price", "input_price", "model", "cached_price"))
    return rates.groupBy("provider").agg(best.alias("m")).select("provider", "m.model", "m.input_price", "m.cached_price", "m.output_price")


def rollup(snapshots: DataFrame) -> DataFrame:
    """Over the snapshots of many books: totals, whether any reached its limit, and each feature's cost."""
    # one row of each book stands for its totals; all are summed by feature, and those sums once more
    rows = snapshots.select("input", "output", "cost", "limit_reached", F.posexplode_outer(F.map_entries("features")).alias("k", "f"))
    whole = F.coalesce(F.col("k"), F.lit(0)) == 0
    first = lambda c: F.sum(F.when(whole, F.col(c))).alias(c)
    each = rows.groupBy(F.col("f.key").alias("feature")).agg(F.bround(F.sum("f.value"), 8).alias("part"), first("input"), first("output"), first("cost"), F.bool_or("limit_reached").alias("limit_reached"))
    named = F.filter(F.collect_list(F.struct("feature", F.col("part").alias("cost"))), lambda x: x["feature"].isNotNull())  # a handful of features
    return each.agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.bround(F.sum("cost"), 8).alias("cost"), F.bool_or("limit_reached").alias("limit_reached"), F.map_from_entries(F.sort_array(named)).alias("features"))


def batch_estimate(books: DataFrame, price: float, output_price: float) -> DataFrame:
    """Over the estimates of many books: sums of tokens, and the largest cost of a book."""
    cost = (F.col("most_input") * price + F.col("most_output") * output_price) / F.lit(1e6)
    return books.agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.max(cost).alias("most_cost"))


def split_usage(calls: DataFrame) -> DataFrame:
    """calls (features, input, output, cached) as a row for each distinct feature; the parts sum to the call's exactly."""
    rows = calls.withColumn("names", F.array_distinct("features")).withColumn("n", F.size("names")).select("*", F.posexplode("names").alias("k", "feature"))
    part = lambda c: F.floor(F.col(c) / F.col("n")) + (F.col("k") < F.col(c) % F.col("n")).cast("long")
    return rows.withColumns({f"{c}_part": part(c) for c in ("input", "output", "cached")}).drop("names", "n", "k")


def snapshot(parts: DataFrame, key: str, limit: float) -> DataFrame:
    """Totals, cost to 8 places, whether the limit is reached, and a map of each feature's cost."""
    each = parts.groupBy(key, "feature").agg(F.count("*").alias("requests"), F.sum("input_part").alias("input"), F.sum("output_part").alias("output"), F.sum("cost").alias("cost"))
    rows = each.groupBy(key).agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("cost").alias("raw"), F.sort_array(F.collect_list(F.struct("feature", F.bround("cost", 8).alias("cost")))).alias("f"))
    return rows.select(key, "input", "output", F.bround("raw", 8).alias("cost"), (F.col("raw") >= F.lit(limit)).alias("limit_reached"), F.map_from_entries("f").alias("features"))


def book_estimate(books: DataFrame) -> DataFrame:
    """books (pages, features) with estimated input and output tokens, the largest output, and the input for the largest cost."""
    pages, has = F.greatest(F.lit(0), F.col("pages")), lambda f: F.array_contains("features", f)
    boundary = F.when(has("boundary"), 1).otherwise(0)
    cleanup = F.when(F.size(F.array_except("features", F.array(F.lit("boundary")))) > 0, 1).otherwise(0)
    per_page = CLEANUP_OUTPUT + sum(F.when(has(f), n).otherwise(0) for f, n in PER_PAGE.items())
    tokens = pages * (boundary * BOUNDARY_INPUT + cleanup * CLEANUP_INPUT)
    return books.withColumns({
        "input": tokens, "output": pages * (boundary * BOUNDARY_OUTPUT + cleanup * per_page),
        "most_output": pages * (boundary * BOUNDARY_WORST + cleanup * F.greatest(per_page * 2, F.lit(CLEANUP_WORST))), "most_input": F.ceil(tokens * F.lit(1.35)),
    })


def edit_estimate(books: DataFrame) -> DataFrame:
    """books (blocks, characters) with the tokens of sending every block once; none without blocks."""
    blocks, characters = F.greatest(F.lit(0), F.col("blocks")), F.greatest(F.lit(0), F.col("characters"))
    some = lambda x: F.when(blocks > 0, x).otherwise(0)
    tokens = some(characters * 3 + blocks * 40 + 800 * F.greatest(F.lit(1), F.floor(blocks / 16)))
    return books.withColumns({"input": tokens, "output": blocks * 25, "most_output": some(characters * 3 + blocks * 40), "most_input": F.ceil(tokens * F.lit(1.35))})


def admitted(calls: DataFrame, key: str, order: list[str], limit: float | None, actual: str | None = None, in_flight: int = 0) -> DataFrame:
    """calls (worst) with spent and admitted: until the first that could pass the limit; none means no limit.

    spent: the cost of the calls before, and the call's own largest one. Of the calls before, those that are done count with
    their actual cost, if that is known (a column); the last in_flight of them are still running and count with their largest.
    """
    order_ = Window.partitionBy(key).orderBy(*order)
    upto = order_.rowsBetween(Window.unboundedPreceding, 0)
    if actual is None:
        spent = F.sum("worst").over(upto)
    else:
        done = F.sum(actual).over(order_.rowsBetween(Window.unboundedPreceding, -in_flight - 1))
        spent = F.coalesce(done, F.lit(0.0)) + F.sum("worst").over(order_.rowsBetween(-in_flight, 0))
    rows = calls.withColumn("spent", spent)
    fits = F.lit(True) if limit is None else F.col("spent") <= F.lit(limit) + F.lit(SLACK)
    return rows.withColumn("admitted", F.min(fits).over(upto))


def duration_text(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour; null stays."""
    s = F.floor(F.greatest(F.lit(0), seconds)).cast("int")
    hours, minutes = (s / 3600).cast("int"), (s % 3600 / 60).cast("int")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", hours, minutes, s % 60)).otherwise(F.format_string("%d:%02d", minutes, s % 60))


def book_stats(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("book_id").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("characters"), F.count_distinct("page").alias("documents"))


def chunk_plan(books: DataFrame, parallel: int, least: int = 15) -> DataFrame:
    """book_id, first, last of even runs of pages, of `least` pages at least; one run for short books."""
    n = F.greatest(F.lit(1), F.least(F.lit(parallel), F.floor(F.col("pages") / least))).cast("int")
    rows = books.where("pages > 0").withColumn("size", F.ceil(F.col("pages") / n).cast("int"))
    rows = rows.select("book_id", "pages", "size", F.explode(F.sequence(F.lit(1), F.col("pages"), F.col("size"))).alias("first"))
    return rows.select("book_id", "first", F.least(F.col("pages"), F.col("first") + F.col("size") - 1).alias("last"))


def page_progress(chunks: DataFrame) -> DataFrame:
    """book_id, done, total from chunks (first, last, at): at is the last page read, null before the first."""
    done = F.greatest(F.lit(0), F.least("last", F.coalesce("at", F.lit(0))) - F.col("first") + 1)
    return chunks.groupBy("book_id").agg(F.sum(done).alias("done"), F.sum(F.col("last") - F.col("first") + 1).alias("total"))


def output_names(files: DataFrame, taken: DataFrame) -> DataFrame:
    """files (folder, idx, stem) with name: NNN_stem.epub, then (2), (3) ... past names that are taken, whatever their case.

    The n-th file of a name gets the n-th free number.
    """
    rows = files.withColumn("base", F.format_string("%03d_%s", "idx", "stem")).withColumn("low", F.lower("base"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("folder", "low").orderBy("stem")))
    used = taken.select("folder", F.lower("name").alias("name")).distinct()
    used = used.select("folder", F.regexp_replace("name", r"(?: \((\d+)\))?\.epub\z", "").alias("low"), F.coalesce(F.nullif(F.regexp_extract("name", r" \((\d+)\)\.epub\z", 1), F.lit("")).cast("int"), F.lit(1)).alias("n"))
    held = used.groupBy("folder", "low").agg(F.collect_set("n").alias("held"))
    rows = rows.join(held, ["folder", "low"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<int>")))
    free = F.array_except(F.sequence(F.lit(1), F.col("k") + F.size("held")), F.col("held"))
    n = F.element_at(free, F.col("k"))
    return rows.select("folder", "idx", "stem", F.concat(F.col("base"), F.when(n > 1, F.format_string(" (%d)", n)).otherwise(""), F.lit(".epub")).alias("name"))


def checked_name(index: int, folder: str, stem: str) -> str:
    """{index:03d}_{folder}_{name}.epub; an error for names that a file system or another book can't hold."""
    name = f"{index:03d}_{folder}_{stem}".strip()
    device = stem.split(".")[0].upper() in {"CON", "PRN", "AUX", "NUL", *(f"{d}{k}" for d in ("COM", "LPT") for k in range(1, 10))}
    if not stem.strip() or device or any(c in '<>:"/\\|?*' or ord(c) < 32 for c in name) or ".." in name or name.endswith("."):
        raise ValueError(f"not a name for a file: {name!r}")
    return f"{name}.epub"
