"""Rows of a box detector: from raw anchors to boxes of the page, and from a resized image back to the original."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions import geometry as G
from pagelore.functions.pixels import with_model
from pagelore.operators.folds import suppress_overlaps
from pagelore.operators.order import argmax


def check_thresholds(**values: float) -> None:
    """Thresholds are finite shares of one."""
    for name, value in values.items():
        if not (math.isfinite(value) and 0.0 <= value <= 1.0):
            raise ValueError(f"{name} must lie in 0 to 1")


def names_of(metadata: Column) -> Column:
    """array<string> of a model's class names, written {0: 'a', 1: 'b'}; empty unless every entry is whole and the numbers run from 0."""
    body = F.regexp_extract(F.trim(metadata), r"(?s)^\{(.*)\}$", 1)
    parts = F.filter(F.transform(F.split(body, ","), lambda e: F.trim(e)), lambda e: e != "")
    entry = r"""(?s)^\s*([0-9]+)\s*:\s*['"]*\s*(.*?)\s*['"]*\s*$"""
    pairs = F.array_sort(F.transform(parts, lambda e: F.struct(F.regexp_extract(e, entry, 1).try_cast("int").alias("at"), F.regexp_extract(e, entry, 2).alias("name"))))
    whole = F.forall(pairs, lambda p: p["at"].isNotNull() & (p["name"] != "")) & F.forall(F.transform(pairs, lambda p, i: p["at"].eqNullSafe(i)), lambda good: good)
    return F.when(F.coalesce(whole, F.lit(False)), F.transform(pairs, lambda p: p["name"])).otherwise(F.array().cast("array<string>"))


def resolved_names(metadata: Column, count: Column) -> Column:
    """The metadata's names if there are as many as classes, else class_0 and so on; without a count they must be there."""
    names = names_of(metadata)
    plain = F.when(count > 0, F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: F.concat(F.lit("class_"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    found = F.coalesce(F.size(names), F.lit(0))
    known = F.when(found > 0, names).otherwise(F.raise_error(F.lit("neither a number of classes nor their names")))
    return F.when(count.isNull(), known).when(found == count, names).otherwise(plain)


def scaled_back(box: Column, scale: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    """A box of a letterboxed image in pixels of the original: padding off, scale off, kept inside, corners in order."""
    put = lambda v, pad, size: F.least(F.greatest((v - pad) / scale, F.lit(0.0)), size.cast("double"))
    x, y = [put(box[c], left, width) for c in ("x0", "x1")], [put(box[c], top, height) for c in ("y0", "y1")]
    return F.struct(F.least(*x).alias("x0"), F.least(*y).alias("y0"), F.greatest(*x).alias("x1"), F.greatest(*y).alias("y1"))


def decode_anchors(
    anchors: DataFrame, *, page: str, anchor: str, names: Column, confidence: float, overlap: float, limit: int = 0
) -> DataFrame:
    """page, anchor, class_id, class_name, score, x0, y0, x1, y1 of the boxes that a detector's anchors hold.

    anchors: page, anchor, cx, cy, w, h, scores (one a class), scale, left, top (of the letterbox), width, height (of the
    image). An anchor counts for its best class, the first of equals, if that is over the confidence; what is not a finite
    box with an area, here or on the page, goes. Then overlaps of one class are suppressed, best first, ties by anchor.
    A NaN score is never over the confidence.
    """
    check_thresholds(confidence=confidence, overlap=overlap)
    scores = F.transform("scores", lambda s: F.when(~F.isnan(s), s))
    rows = anchors.withColumns({"score": F.array_max(scores), "class_id": argmax(scores)}).where(F.col("score") > confidence)
    sound = F.forall(F.array("cx", "cy", "w", "h"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(sound & (F.col("w") > 0) & (F.col("h") > 0))
    box = F.struct((F.col("cx") - F.col("w") / 2).alias("x0"), (F.col("cy") - F.col("h") / 2).alias("y0"), (F.col("cx") + F.col("w") / 2).alias("x1"), (F.col("cy") + F.col("h") / 2).alias("y1"))
    rows = rows.withColumn("b", scaled_back(box, F.col("scale"), F.col("left"), F.col("top"), F.col("width"), F.col("height")))
    rows = rows.where((F.col("b.x1") > F.col("b.x0")) & (F.col("b.y1") > F.col("b.y0")))
    name = F.coalesce(F.try_element_at(names, F.col("class_id") + 1), F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    rows = rows.select(page, anchor, "class_id", name.alias("class_name"), "score", "b.x0", "b.y0", "b.x1", "b.y1")
    kept = suppress_overlaps(rows, page=page, rid=anchor, threshold=overlap, limit=limit, class_id="class_id")
    return rows.join(kept, [page, anchor], "left_semi")


def detect_candidates(images: DataFrame, load: Callable | None, *, page: str, side: int, names: Column, confidence: float, overlap: float, limit: int) -> DataFrame:
    """Boxes of a page detector, as decode_anchors gives them, with detected = true; no detector, no boxes.

    images: page, width, height and what the model wants. load is called once a task and gives a model that adds `anchors`,
    array<struct<cx,cy,w,h,scores>> in pixels of the letterboxed square.
    """
    anchor = "anchors array<struct<cx:double,cy:double,w:double,h:double,scores:array<double>>>"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema.fields)
    found = with_model(images, load, f"{fields}, {anchor}") if load else images.withColumn("anchors", F.array().cast(anchor.split(" ", 1)[1]))
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    scale = F.least(side / w, side / h)
    pad = lambda n: F.floor((side - F.floor(n * scale + 0.5)) / 2 - 0.1 + 0.5).cast("double")
    rows = found.select(page, "width", "height", scale.alias("scale"), pad(w).alias("left"), pad(h).alias("top"), F.posexplode("anchors").alias("anchor", "a"))
    rows = rows.select(page, "anchor", "a.cx", "a.cy", "a.w", "a.h", "a.scores", "scale", "left", "top", "width", "height")
    return decode_anchors(rows, page=page, anchor="anchor", names=names, confidence=confidence, overlap=overlap, limit=limit).withColumn("detected", F.lit(True))


def mapped_back(points: Column, left: Column, top: Column, ratio_w: Column, ratio_h: Column, width: Column, height: Column) -> Column:
    """Points of a padded, resized image in pixels of the original, kept inside it."""
    put = lambda v, pad, ratio, size: F.least(F.greatest((v - pad) * ratio, F.lit(0.0)), size.cast("double"))
    return F.transform(points, lambda p: G.point(put(p["x"], left, ratio_w, width), put(p["y"], top, ratio_h, height)))


def mapped_size(width: Column, height: Column, ratio_w: Column, ratio_h: Column) -> Column:
    """struct<w,h> of a crop in the original's pixels: halves to even, one at least."""
    side = lambda n, r: F.greatest(F.rint(n * r), F.lit(1.0)).cast("int")
    return F.struct(side(width, ratio_w).alias("w"), side(height, ratio_h).alias("h"))


def scaled_to(points: Column, width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """Points of a map at the size of the page, on whole pixels (halves to even), kept inside; as they are if the map is empty."""
    put = lambda v, n, to: F.least(F.greatest(F.rint(v / n * to), F.lit(0.0)), to.cast("double"))
    return F.when((width <= 0) | (height <= 0), points).otherwise(F.transform(points, lambda p: G.point(put(p["x"], width, to_width), put(p["y"], height, to_height))))


def crop_bounds(points: Column, width: Column, height: Column) -> Column:
    """struct<x,y,w,h>: whole pixels around a polygon, inside the image, one pixel at least."""
    b = G.bounds(points)
    inside = lambda v, size: F.least(F.greatest(v.cast("double"), F.lit(0.0)), size.cast("double")).cast("int")
    x, y = inside(F.floor(b["x0"]), width), inside(F.floor(b["y0"]), height)
    size = lambda end, at, whole: F.least(F.greatest(inside(F.ceil(end), whole) - at, F.lit(1)), F.greatest(whole - at, F.lit(1))).cast("int")
    return F.struct(x.alias("x"), y.alias("y"), size(b["x1"], x, width).alias("w"), size(b["y1"], y, height).alias("h"))


def outside_regions(tokens: DataFrame, regions: DataFrame, *, page: str) -> DataFrame:
    """The tokens (x0..y1) whose centre lies in no region of their page: what is left to read once regions are whitened.

    A page's regions come to its tokens as one array, so a page of n tokens makes n rows, not n times its regions.
    """
    boxes = regions.groupBy(page).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("regions of the page"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = F.exists("regions of the page", lambda r: x.between(r["x0"], r["x1"]) & y.between(r["y0"], r["y1"]))
    return tokens.join(boxes, page, "left").where(~F.coalesce(inside, F.lit(False))).drop("regions of the page")
