"""Repeated heads and feet of pages as they arrive, in any order.

A block is a margin once enough pages near it have its key in place, and pages that come later only add to that. So it is put
out as soon as that is known, and what comes out in the end doesn't depend on the order. The state of a book is what may
still matter: the candidates within the look-ahead of the first page that hasn't come, those after it, and the pages seen
there. A page that comes again is passed over. Nothing waits for the end of a book.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioflow.operators import layout as L

FOUND = "book_id string, page int, id string"


def candidates(pages: DataFrame, layout: L.Layout = L.Layout()) -> DataFrame:
    """book_id, page, id, side, place, key, pages of stored pages' candidates, and a row without key of each page."""
    b, c = F.col("b"), F.col
    rows = pages.select("book_id", "page", "width", "height", F.posexplode_outer("blocks").alias("pos", "b"))
    box = [F.coalesce(b["bbox"][k], F.lit(0)).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))]
    rows = rows.select("book_id", "page", "width", "height", F.coalesce("pos", F.lit(0)).alias("pos"), b["id"].alias("id"), b["text"].alias("text"), *box, F.coalesce(b["type"], F.lit("line")).alias("type"))
    keys = F.when(c("kept"), L.keys_of(text=layout.text_pages, offset=layout.offset_pages))
    rows = L.bands(rows, layout).select("book_id", "page", "pos", "id", "side", "place", F.explode_outer(keys).alias("k"))
    return rows.select("book_id", "page", "pos", "id", "side", "place", "k.key", "k.pages").where("key is not null or pos = 0")


def arriving(pages: DataFrame, layout: L.Layout = L.Layout()) -> DataFrame:
    """book_id, page, id of margins among stored pages (a stream): each once, as soon as it is known."""
    widest = max(layout.text_pages, layout.offset_pages)

    def decide(book: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # done: all pages up to this one have come; seen: those after it that have; held: [page, id, side, key, place, pages, told]
        done, seen, held = json.loads(state.get[0]) if state.exists else (0, [], [])
        seen = set(seen)
        rows = [r for f in frames for r in zip(f["page"], f["id"], f["side"], f["key"], f["place"], f["pages"], strict=True)]
        new = {int(r[0]) for r in rows if r[0] > done} - seen
        held += [[int(p), i, s, k, float(y), int(n), False] for p, i, s, k, y, n in rows if p in new and isinstance(k, str)]
        groups: dict[tuple, list] = {}
        for h in held:
            groups.setdefault((h[2], h[3]), []).append(h)
        told = {(h[0], h[1]) for h in held if h[6]}  # by any of its keys
        found = []
        for own in groups.values():
            for h in own:
                if (h[0], h[1]) not in told and len({o[0] for o in own if abs(o[0] - h[0]) <= h[5] and abs(o[4] - h[4]) <= layout.near}) >= layout.least_pages:
                    told.add((h[0], h[1]))
                    found.append((book[0], h[0], h[1]))
        seen |= new
        while done + 1 in seen:
            done += 1
            seen.discard(done)
        # what comes now is after done: pages further back than the look-ahead have met all they can meet
        held = [[*h[:6], (h[0], h[1]) in told] for h in held if h[0] > done - widest]
        state.update((json.dumps([done, sorted(seen), held]),))
        yield pd.DataFrame(found, columns=["book_id", "page", "id"])

    return candidates(pages, layout).groupBy("book_id").applyInPandasWithState(decide, FOUND, "state string", "append", GroupStateTimeout.NoTimeout)
