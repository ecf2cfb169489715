"""What goes to an outside judgement, in batches, and what comes back: keys, caches, answers, edits, plans.

A judge is any function of a DataFrame of batches; none is built in. Answers count only if they name exactly the asked ids.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioflow.functions import text as T

# Fixed values
ENHANCE, BOUNDARY, EDIT = 24, 32, 16
LONGEST = 1600


def batches(rows: DataFrame, book: str, order: list[str], size: int) -> DataFrame:
    """rows with batch and slot, numbered within a book before anything else is filtered out."""
    n = F.row_number().over(Window.partitionBy(book).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(n / size).cast("int")).withColumn("slot", (n % size).cast("int"))


def cache_key(text: Column, model: str, features: list[str]) -> Column:
    """SHA-256 of a JSON object with sorted keys and features."""
    head = json.dumps({"features": sorted(features), "model": model, "schema": 1}, ensure_ascii=False)[:-1] + ', "text": '
    return F.sha2(F.concat(F.lit(head), json_text(text), F.lit("}")), 256)


def json_text(text: Column) -> Column:
    """The text as Python's json writes it: control characters by small hexadecimal digits."""
    literal = F.regexp_replace(F.to_json(F.array(text)), r"\A\[|\]\z", "")
    small = reduce(lambda c, x: F.regexp_replace(c, r"(?<!\\)((?:\\\\)*\\u00[01])" + x, "$1" + x.lower()), "ABCDEF", literal)
    return F.when(text.rlike(r"[\x00-\x1f]"), small).otherwise(literal)


def split_cached(rows: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (with the cached value) and misses, by key; of a key's values the smallest is taken."""
    one = cache.where("value is not null").groupBy("key").agg(F.min("value").alias("value"))
    return rows.join(one, "key"), rows.join(one, "key", "left_anti")


def answered(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """book_id, batch, id, answer, source: ai where a batch's answers have exactly its ids, once each; else fallback."""
    keys = ["book_id", "batch"]
    ids = lambda df: df.groupBy(*keys).agg(F.array_sort(F.collect_list("id")).alias("ids"))  # noqa: E731  a batch holds a few dozen
    good = ids(requests).join(ids(answers), [*keys, "ids"]).select(*keys)
    found = answers.join(good, keys, "left_semi").select(*keys, "id", "answer", F.lit("ai").alias("source"))
    rest = requests.join(good, keys, "left_anti").select(*keys, "id", F.lit(None).cast("string").alias("answer"), F.lit("fallback").alias("source"))
    return found.unionByName(rest)


def _shared(a: str, b: str) -> int:
    """How many characters two texts begin with alike: halves are compared, not characters."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def alike(a: str, b: str, least: float) -> bool:
    """Whether `difflib.SequenceMatcher(None, a, b).ratio()` is least or more, by the same blocks in the same order of choice.

    Blocks grow from characters that aren't frequent in b, so only stretches of these are visited, if one is longer than what was
    found; it ends when enough is matched.
    """
    places: dict[str, list[int]] = {}
    most = len(b) // 100 + 1 if len(b) >= 200 else len(b)
    rare = {c for c, n in Counter(b).items() if n <= most}
    for j, c in enumerate(b):
        if c in rare:
            places.setdefault(c, []).append(j)
    at = [i for i, c in enumerate(a) if c in rare]
    # stretches of such characters, by where each begins in at
    begins = [n for n, i in enumerate(at) if not n or i != at[n - 1] + 1]
    ends = [*begins[1:], len(at)]
    total, matched, open_ = len(a) + len(b), 0, [(0, len(a), 0, len(b))]
    while True:
        if (2.0 * matched / total if total else 1.0) >= least:
            return True
        if not open_:
            return False
        alo, ahi, blo, bhi = open_.pop()
        i0, j0, size = alo, blo, 0
        first, stop = bisect_left(at, alo), bisect_left(at, ahi)
        for n in range(max(0, bisect_right(begins, first) - 1), bisect_left(begins, stop)):
            begin, end = max(begins[n], first), min(ends[n], stop)
            if end - begin <= size:  # none longer in it
                continue
            runs: dict[int, int] = {}
            for i in at[begin:end]:
                last, runs = runs, {}
                for j in places[a[i]]:
                    if blo <= j < bhi:
                        k = runs[j] = last.get(j - 1, 0) + 1
                        if k > size:
                            i0, j0, size = i - k + 1, j - k + 1, k
        left = _shared(a[alo:i0][::-1], b[blo:j0][::-1])
        i0, j0, size = i0 - left, j0 - left, size + left
        size += _shared(a[i0 + size : ahi], b[j0 + size : bhi])
        if size:
            matched += size
            if alo < i0 and blo < j0:
                open_.append((alo, i0, blo, j0))
            if i0 + size < ahi and j0 + size < bhi:
                open_.append((i0 + size, ahi, j0 + size, bhi))


EDITS = "array<struct<before:string,after:string,confidence:double>>"


@F.pandas_udf(StringType())
def apply_edits(text: pd.Series, edits: pd.Series) -> pd.Series:
    """Each edit in turn, if it is sure, short, in the text once, and leaves the text much the same."""

    def one(value: str, items) -> str:
        for e in items if items is not None else ():
            old, new, sure = e["before"] or "", e["after"] or "", e["confidence"]
            if sure is None or sure < 0.9 or not (0 < len(old) <= 30 and 0 < len(new) <= 30) or abs(len(old) - len(new)) > 4 or value.count(old) != 1:
                continue
            changed = value.replace(old, new, 1)
            if alike(value, changed, 0.96):
                value = changed
        return value

    return pd.Series([one(t, e) for t, e in zip(text, edits, strict=True)], dtype=object)


def apply_glosses(text: Column, spans: Column) -> Column:
    """Each span in turn is cut out, if it is in the text once and a third of it at most; a fold over the spans."""

    def cut(value: Column, span: Column) -> Column:
        once = (F.length(value) - F.length(F.replace(value, span, F.lit("")))) == F.length(span)
        good = F.length(span).between(1, 40) & (F.length(span) * 3 <= F.length(value)) & once
        return F.when(good, T.tidy(F.replace(value, span, F.lit("")))).otherwise(value)

    return F.aggregate(spans, text, cut)


def accept_spacing(text: Column, spaced: Column) -> Column:
    """The spaced text if it differs in white space alone; null is no change."""
    return F.when(T.squeeze(spaced) == T.squeeze(text), spaced).otherwise(text)


def resolved(items: DataFrame) -> DataFrame:
    """text, kind, heading_level after an answer: kind unless unchanged, a level makes a heading, residue that is called so is emptied."""
    level = F.coalesce("heading_level", F.lit(0))
    kind = F.when(level > 0, "heading").when(F.coalesce("new_kind", F.lit("unchanged")) != "unchanged", F.col("new_kind")).otherwise(F.col("kind"))
    drop = F.coalesce("figure_residue", F.lit(False)) & T.is_figure_residue(F.col("text"))
    return items.withColumns({"kind": kind, "heading_level": level, "text": F.when(drop, "").otherwise(F.col("text"))})


def planned(blocks: DataFrame) -> DataFrame:
    """document, idx, before, after of blocks whose answer (action, new_text) changes them; a null after deletes."""
    new = T.strip(F.col("new_text"))
    replaced = (F.col("action") == "replace") & (F.coalesce(new, F.lit("")) != "") & (new != T.strip(F.col("text")))
    rows = blocks.where((F.col("action") == "delete") | replaced)
    return rows.select("document", "idx", F.col("text").alias("before"), F.when(F.col("action") == "replace", new).alias("after"))


def applied(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """blocks under a plan with seq: of a block's changes the last counts."""
    last = plan.groupBy("document", "idx").agg(F.max_by(F.struct("after"), "seq").alias("c"))
    rows = blocks.join(last, ["document", "idx"], "left").where(F.col("c").isNull() | F.col("c.after").isNotNull())
    return rows.select("document", "idx", F.coalesce("c.after", "text").alias("text"))
