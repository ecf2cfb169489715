"""Page images as grey pixels in a binary column: how dark rows and columns are, and the regions of a page with two columns.

An image is a row: its key, width, height, and pixels, row by row, a byte each. Kernels see Arrow batches of images and give
small numbers; a page's regions are then told by the same operators that take profiles from elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources import recognised as S

# Fixed values
DARK = 160
TITLE = (0.075, 0.25)
MIDDLE, BODY, EVERY = (0.42, 0.58), (0.25, 0.85), 2
#: Images whose rows go out together.
IMAGES = 256


def _mapped(images: DataFrame, key: list[str], more: list[str], found: str, one) -> DataFrame:
    """Rows that `one` tells from each image (a boolean array of dark pixels) and the columns of more."""
    kinds = dict(images.dtypes)
    names = [x.split()[0] for x in found.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, IMAGES):
                part, rows, of = batch.slice(start, IMAGES), [], []
                values = [part.column(j).to_pylist() for j in range(part.num_columns - 1)]
                for k, own in enumerate(zip(*values, strict=True)):
                    at = dict(zip([*key, "width", "height", *more], own, strict=True))
                    data = part.column(part.num_columns - 1)[k]
                    if not data.is_valid or len(data.as_buffer()) != at["width"] * at["height"]:
                        raise ValueError(f"pixels of {at}: not width times height")
                    told = one(np.frombuffer(data.as_buffer(), np.uint8).reshape(at["height"], at["width"]), at)
                    rows += told
                    of += [k] * len(told)
                if rows:
                    keys = [part.column(j).take(pa.array(of, pa.int32())) for j in range(len(key))]
                    yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.string() if isinstance(c[0], str) else pa.int32()) for c in zip(*rows, strict=True))], [*key, *names])

    return images.select(*key, "width", "height", *more, "pixels").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in key) + ", " + found)


def profiles(images: DataFrame, key: list[str], dark: int = DARK) -> DataFrame:
    """key, width, height, side, at, dark: dark pixels of each row of the title's band (side row), and of each column of the
    middle (side column; of every second row of the body)."""

    def one(grey: np.ndarray, at: dict) -> list[tuple]:
        own, (h, w) = grey < dark, grey.shape
        rows = range(int(h * TITLE[0]), int(h * TITLE[1]))
        columns = range(int(w * MIDDLE[0]), int(w * MIDDLE[1]))
        body = own[int(h * BODY[0]) : int(h * BODY[1]) : EVERY]
        told = own[rows.start : rows.stop].sum(axis=1).tolist(), body[:, columns.start : columns.stop].sum(axis=0).tolist()
        return [(w, h, "row", y, n) for y, n in zip(rows, told[0], strict=True)] + [(w, h, "column", x, n) for x, n in zip(columns, told[1], strict=True)]

    return _mapped(images, key, [], "width int, height int, side string, at int, dark int", one)


def splits(images: DataFrame, key: list[str], dark: int = DARK) -> DataFrame:
    """key, bottom (of the title's band), gutter (null where the middle has no columns)."""
    found = profiles(images, key, dark)
    rows = found.where("side = 'row'").select(*key, "width", "height", F.col("at").alias("y"), "dark")
    columns = found.where("side = 'column'").select(*key, F.col("at").alias("x"), "dark")
    pages = images.select(*key, F.floor(F.col("height") * F.lit(TITLE[0])).cast("int").alias("least"))
    told = pages.join(S.title_bottoms(rows, key), key, "left").join(S.gutters(columns, key), key, "left")
    return told.select(*key, F.coalesce("bottom", "least").alias("bottom"), "gutter")


def regions(images: DataFrame, key: list[str], dark: int = DARK) -> DataFrame:
    """key, region (0 the title, then the columns), left, top, right, bottom: the tight bounds of what is dark; regions without
    any are left out. left and top are what `recognised.in_page` moves a region's blocks by."""

    def one(grey: np.ndarray, at: dict) -> list[tuple]:
        own, (h, w) = grey < dark, grey.shape
        y, x = at["split"], at["gutter"]
        boxes = [(0, 0, w, y), *([(0, y, w, h)] if x is None else [(0, y, x, h), (x, y, w, h)])]
        found = []
        for k, (x0, y0, x1, y1) in enumerate(boxes):
            part = own[y0:y1, x0:x1]
            xs, ys = np.flatnonzero(part.any(axis=0)), np.flatnonzero(part.any(axis=1))
            if len(xs):
                found.append((k, int(x0 + xs[0]), int(y0 + ys[0]), int(x0 + xs[-1] + 1), int(y0 + ys[-1] + 1)))
        return found

    told = splits(images, key, dark).withColumnRenamed("bottom", "split")
    return _mapped(images.join(told, key), key, ["split", "gutter"], "region int, left int, top int, right int, bottom int", one)
