"""Measures of pictures. Decoding is the caller's: functions take small grey rasters as arrays, rows from the top."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The strips of a screen's bars, the edge threshold of long lines, and what counts as an edge.
TOP, BOTTOM, LONG_EDGE, EDGE, RUN, COLOURFUL = 0.045, 0.96, 60, 40, 90, 80


def content_lines(lines: Column) -> Column:
    """Lines (text, conf, box) that begin between the bars; a line without a box stays."""
    return F.filter(lines, lambda x: x["box"].isNull() | ((x["box"]["y"] >= TOP) & (x["box"]["y"] <= BOTTOM)))


def bar_lines(lines: Column) -> Column:
    """struct(top, bottom): how many lines the bars hold."""
    n = lambda f: F.size(F.filter(lines, lambda x: F.coalesce(f(x["box"]["y"]), F.lit(False))))
    return F.struct(n(lambda y: y < TOP).alias("top"), n(lambda y: y > BOTTOM).alias("bottom"))


def text_coverage(lines: Column) -> Column:
    """Share of the content area that lines' boxes cover."""
    boxed = F.filter(content_lines(lines), lambda x: x["box"].isNotNull())
    return F.bround(F.aggregate(boxed, F.lit(0.0), lambda a, x: a + x["box"]["w"] * x["box"]["h"]) / (BOTTOM - TOP), 4)


def difference_hash(grey: Column) -> Column:
    """16 hex digits of a raster of 8 rows of 9 values: whether each is more than the one to its right."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get(grey, F.floor(i / 8).cast("int") * 9 + i % 8) > F.get(grey, F.floor(i / 8).cast("int") * 9 + i % 8 + 1), "1").otherwise("0"))
    return F.when(F.size(grey) == 72, F.lower(F.lpad(F.conv(F.array_join(bits, ""), 2, 16), 16, "0")))


def _has_run(mask: np.ndarray, run: int) -> int:
    """Rows of a mask with an unbroken run."""
    total = np.cumsum(np.pad(mask, ((0, 0), (1, 0))), axis=1)
    return int(((total[:, run:] - total[:, :-run]) == run).any(axis=1).sum()) if mask.shape[1] >= run else 0


def edge_measures(edges: Column, width: int = 300, height: int = 600) -> Column:
    """struct(edges, hlines, vlines) of an edge raster: share of edge pixels, and rows and columns with a long line."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = []
            for x in b:
                if not x.is_valid or len(x.values) != width * height:
                    out.append(None)
                    continue
                e = x.values.to_numpy(zero_copy_only=False).reshape(height, width)
                out.append({"edges": round(float((e > EDGE).mean()), 4), "hlines": _has_run(e > LONG_EDGE, RUN), "vlines": _has_run((e > LONG_EDGE).T, RUN)})
            yield pa.array(out, pa.struct([("edges", pa.float64()), ("hlines", pa.int32()), ("vlines", pa.int32())]))

    return F.arrow_udf(run, "edges double, hlines int, vlines int")(edges)


def grey_levels(grey: Column) -> Column:
    return F.size(F.array_distinct(grey))


def colourful(saturation: Column) -> Column:
    """Share of saturated pixels."""
    return F.bround(F.size(F.filter(saturation, lambda s: s > COLOURFUL)) / F.size(saturation), 4)
