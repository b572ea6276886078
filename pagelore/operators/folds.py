"""Greedy operators over the boxes of a page: overlap suppression, region routing, one-to-one matching, deduplication.

Each is a fold over an array of structs that Spark sorts first, so all of it stays in the JVM. Pages are the groups;
what comes to one page is bounded by what a page can hold, and every fold takes explicit ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions import geometry as G


def _sorted_rows(df: DataFrame, page: str, fields: dict[str, Column]) -> DataFrame:
    """One row a page: `rows`, sorted by the fields in turn."""
    return df.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(*[c.alias(n) for n, c in fields.items()]))).alias("rows"))


def _empty_like(rows: Column) -> Column:
    return F.slice(rows, F.lit(1), F.lit(0))


def suppress_overlaps(df: DataFrame, *, page: str, rid: str, threshold: float, limit: int = 0, class_id: str | None = None) -> DataFrame:
    """page, rid of the boxes (x0, y0, x1, y1, score) kept: by falling score, ties by rid; a box goes if its IoU with one kept is over the threshold.

    Classes don't suppress each other: each lies at an offset of its own. limit 0 keeps any number.
    """
    shift = F.col(class_id) * G.CLASS_OFFSET if class_id else F.lit(0.0)
    fields = {"order": -F.col("score"), "rid": F.col(rid)} | {c: F.col(c).cast("double") + shift for c in ("x0", "y0", "x1", "y1")}
    rows = _sorted_rows(df, page, fields)

    def step(kept: Column, b: Column) -> Column:
        hit = F.exists(kept, lambda k: G.box_iou(k, b) > threshold)
        full = F.size(kept) >= limit if limit else F.lit(False)
        return F.when(hit | full, kept).otherwise(F.concat(kept, F.array(b)))

    return rows.select(page, F.explode(F.aggregate("rows", _empty_like(F.col("rows")), step)).alias("b")).select(page, F.col("b.rid").alias(rid))


def route_regions(df: DataFrame, *, page: str, rid: str, width: Column, height: Column, min_area_ratio: float, threshold: float, max_regions: int) -> DataFrame:
    """page, rid, x0..y1, score of the regions kept: cut to the page, small detected ones dropped, then greedy by score, area, x0, y0.

    A region goes if its IoU with one kept is at least the threshold, or nine tenths of it are covered by one. `detected` says
    whether a region was found (then it needs an area) or was given.
    """
    if max_regions <= 0:
        raise ValueError("max_regions must be positive")
    ratio = min(max(min_area_ratio, 0.0), 1.0)
    cut = df.withColumn("cut", G.clamped_box(F.struct("x0", "y0", "x1", "y1"), width, height)).where("cut is not null")
    area = G.box_area(F.col("cut"))
    cut = cut.where(~F.col("detected") | (area >= width.cast("double") * height.cast("double") * ratio))
    fields = {"order": -F.col("score"), "size": -area, **{c: F.col("cut")[c] for c in ("x0", "y0", "x1", "y1")}, "rid": F.col(rid), "score": F.col("score")}
    rows = _sorted_rows(cut, page, fields)

    def step(kept: Column, b: Column) -> Column:
        hit = F.exists(kept, lambda k: (G.box_iou(b, k) >= threshold) | (G.covered_ratio(b, k) >= 0.9))
        return F.when(hit | (F.size(kept) >= max_regions), kept).otherwise(F.concat(kept, F.array(b)))

    out = rows.select(page, F.explode(F.aggregate("rows", _empty_like(F.col("rows")), step)).alias("b"))
    return out.select(page, F.col("b.rid").alias(rid), "b.x0", "b.y0", "b.x1", "b.y1", "b.score")


def candidate_pairs(expected: DataFrame, predicted: DataFrame, *, page: str, threshold: float) -> DataFrame:
    """page, e, p, iou of the pairs of boxes of one page whose IoU is at least the threshold."""
    box = lambda side: F.struct(*[F.col(f"{side}.{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = expected.alias("a").join(predicted.alias("b"), page)
    return pairs.select(page, F.col("a.e").alias("e"), F.col("b.p").alias("p"), G.box_iou(box("a"), box("b")).alias("iou")).where(F.col("iou") >= threshold)


def match_one_to_one(pairs: DataFrame, *, page: str) -> DataFrame:
    """page, e, p, iou: the pairs taken greedily by falling IoU, ties by e and p, each box once."""
    rows = _sorted_rows(pairs, page, {"order": -F.col("iou"), "e": F.col("e"), "p": F.col("p"), "iou": F.col("iou")})

    def step(kept: Column, b: Column) -> Column:
        return F.when(F.exists(kept, lambda k: (k["e"] == b["e"]) | (k["p"] == b["p"])), kept).otherwise(F.concat(kept, F.array(b)))

    out = rows.select(page, F.explode(F.aggregate("rows", _empty_like(F.col("rows")), step)).alias("m"))
    return out.select(page, "m.e", "m.p", "m.iou")


def deduplicate(df: DataFrame, *, page: str, rid: str, text: str, threshold: float = 0.5) -> DataFrame:
    """page, rid, text, score, y0, x0 of the regions left when those of one text that overlap by the threshold are one.

    They are met in order of rid; a later one takes the place of the first that it repeats if its score is higher.
    """
    fields = {"rid": F.col(rid), "score": F.col("score")} | {c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")}
    rows = df.groupBy(page, text).agg(F.array_sort(F.collect_list(F.struct(*[c.alias(n) for n, c in fields.items()]))).alias("rows"))

    def step(kept: Column, b: Column) -> Column:
        hits = F.transform(kept, lambda k: G.box_iou(k, b) >= threshold)
        at = F.array_position(hits, True)  # 1-based; 0 if none
        swapped = F.transform(kept, lambda k, i: F.when((i + 1 == at) & (b["score"] > k["score"]), b).otherwise(k))
        return F.when(at > 0, swapped).otherwise(F.concat(kept, F.array(b)))

    out = rows.select(page, text, F.explode(F.aggregate("rows", _empty_like(F.col("rows")), step)).alias("b"))
    return out.select(page, F.col("b.rid").alias(rid), text, "b.score", "b.y0", "b.x0")


def cluster_lines(df: DataFrame, *, page: str, rid: str) -> DataFrame:
    """page, rid, line, place: boxes met from the top join the line that they overlap most, by half of the lesser height at least."""
    rows = _sorted_rows(df, page, {c: F.col(c).cast("double") for c in ("y0", "x0")} | {"rid": F.col(rid), "y1": F.col("y1").cast("double"), "x1": F.col("x1").cast("double")})
    shape = "array<struct<top:double,bottom:double,left:double,seq:int,items:array<struct<x0:double,y0:double,rid:bigint>>>>"

    def overlap(line: Column, b: Column) -> Column:
        return F.greatest(F.least(line["bottom"], b["y1"]) - F.greatest(line["top"], b["y0"]), F.lit(0.0))

    def step(lines: Column, b: Column) -> Column:
        fits = lambda k: overlap(k, b) / F.greatest(F.least(F.greatest(k["bottom"] - k["top"], F.lit(0.0)), F.greatest(b["y1"] - b["y0"], F.lit(0.0))), F.lit(0.0001)) >= 0.5
        gains = F.transform(lines, lambda k: F.when(fits(k), overlap(k, b)).otherwise(-1.0))
        best = F.array_max(gains)
        at = F.when(F.coalesce(best, F.lit(-1.0)) >= 0, F.array_position(gains, best)).otherwise(F.lit(0))
        item = F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), b["rid"].cast("long").alias("rid"))
        grown = F.transform(
            lines,
            lambda k, i: F.when(
                i + 1 == at,
                F.struct(F.least(k["top"], b["y0"]).alias("top"), F.greatest(k["bottom"], b["y1"]).alias("bottom"), F.least(k["left"], b["x0"]).alias("left"), k["seq"].alias("seq"), F.concat(k["items"], F.array(item)).alias("items")),
            ).otherwise(k),
        )
        fresh = F.struct(b["y0"].alias("top"), b["y1"].alias("bottom"), b["x0"].alias("left"), F.size(lines).alias("seq"), F.array(item).alias("items"))
        return F.when(at > 0, grown).otherwise(F.concat(lines, F.array(fresh)))

    lines = F.aggregate("rows", F.array().cast(shape), step)
    ordered = F.array_sort(F.transform(lines, lambda k: F.struct(k["top"].alias("top"), k["left"].alias("left"), k["seq"].alias("seq"), F.array_sort(k["items"]).alias("items"))))
    out = rows.select(page, F.posexplode(ordered).alias("line", "l")).select(page, "line", F.posexplode("l.items").alias("place", "b"))
    return out.select(page, F.col("b.rid").alias(rid), "line", "place")
