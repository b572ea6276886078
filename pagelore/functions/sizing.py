"""Sizes that images are brought to, as column expressions. Ratios are of single precision where the results depend on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def single(v: Column) -> Column:
    return v.cast("float")


def side_limit(kind: Column, configured: Column, longest: Column) -> Column:
    """The limit of a detector's image: as configured for `min`, else the step above the longest side."""
    return F.when(kind == "min", configured).when(longest < 960, 960).when(longest < 1500, 1500).otherwise(2000)


def detector_size(width: Column, height: Column, kind: Column, limit: Column) -> Column:
    """struct<w,h>: the longest side down to the limit (`max`), or the shortest up to it; then multiples of 32, halves to even, 32 at least."""
    longest, shortest = F.greatest(width, height), F.least(width, height)
    down = F.when(longest > limit, single(limit) / single(longest)).otherwise(1.0)
    up = F.when(shortest < limit, single(limit) / single(shortest)).otherwise(1.0)
    ratio = single(F.when(kind == "max", down).otherwise(up))
    side = lambda n: F.greatest(F.rint(F.greatest(F.floor(single(n) * ratio), F.lit(1)) / 32) * 32, F.lit(32.0)).cast("int")
    return F.struct(side(width).alias("w"), side(height).alias("h"))


def short_side_size(width: Column, height: Column, short: int) -> Column:
    """struct<w,h>: the shorter side becomes `short`, the other follows in whole numbers."""
    w, h = width.cast("long"), height.cast("long")
    other = F.floor(short * F.greatest(w, h) / F.least(w, h)).cast("int")
    return F.struct(F.when(w <= h, F.lit(short)).otherwise(other).alias("w"), F.when(w <= h, other).otherwise(F.lit(short)).alias("h"))


def batch_width(max_ratio: Column, height: int, least: int) -> Column:
    """Width of a batch of lines: what its widest needs, `least` at least."""
    return F.greatest(F.floor(height * max_ratio.cast("double")), F.lit(least)).cast("int")


def line_width(width: Column, height: Column, to_height: int, to_width: Column) -> Column:
    """Width of one line at the batch's height, no more than the batch's."""
    return F.least(F.ceil(F.lit(float(to_height)) * (width.cast("double") / height.cast("double"))), to_width).cast("int")


def classifier_width(width: Column, height: Column, to_height: int, to_width: int) -> Column:
    ratio = single(single(width) / single(height))
    return F.greatest(F.least(F.ceil(single(F.lit(to_height)) * ratio), F.lit(to_width)), F.lit(1)).cast("int")


def axis_aligned_crop(quad: Column, width: Column, height: Column, near: float = 1e-3) -> Column:
    """struct<x0,y0,x1,y1>: the half-open slice that an upright quad stands for; null if it isn't upright or nothing is left."""
    close = lambda a, b, k: F.abs(quad[a][k] - quad[b][k]) <= near
    upright = close(0, 1, "y") & close(2, 3, "y") & close(0, 3, "x") & close(1, 2, "x")
    edge = lambda f, a, b, k: F.rint(f(quad[a][k], quad[b][k])).cast("int")
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0)), most)
    x0, x1 = inside(edge(F.least, 0, 3, "x"), width - 1), inside(edge(F.greatest, 1, 2, "x"), width)
    y0, y1 = inside(edge(F.least, 0, 1, "y"), height - 1), inside(edge(F.greatest, 2, 3, "y"), height)
    return F.when(upright & (width > 0) & (height > 0) & (x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
