"""Boxes and polygons as column expressions. Points are struct<x,y>, quads arrays of four of them, boxes x0,y0,x1,y1."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = "struct<x:double,y:double>"
CLASS_OFFSET = 7680.0


def point(x: Column | float, y: Column | float) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(as_column(x).cast("double").alias("x"), as_column(y).cast("double").alias("y"))


def box_quad(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def bounds(points: Column) -> Column:
    """struct<x0,y0,x1,y1> of any number of points."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def side(a: Column, b: Column) -> Column:
    return F.greatest(b - a, F.lit(0.0))


def box_area(b: Column) -> Column:
    return side(b["x0"], b["x1"]) * side(b["y0"], b["y1"])


def intersection(a: Column, b: Column) -> Column:
    return side(F.greatest(a["x0"], b["x0"]), F.least(a["x1"], b["x1"])) * side(F.greatest(a["y0"], b["y0"]), F.least(a["y1"], b["y1"]))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if there is no area."""
    common = intersection(a, b)
    return F.coalesce(F.when(box_area(a) + box_area(b) - common > 0, F.try_divide(common, box_area(a) + box_area(b) - common)), F.lit(0.0))


def covered_ratio(own: Column, other: Column) -> Column:
    return F.when(box_area(own) <= 0, 0.0).otherwise(F.try_divide(intersection(own, other), box_area(own)))


def clamped_box(b: Column, width: Column, height: Column) -> Column:
    """The part of a box inside the image; null if a side is under one pixel or a number isn't finite."""
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))
    c = F.struct(inside(b["x0"], width).alias("x0"), inside(b["y0"], height).alias("y0"), inside(b["x1"], width).alias("x1"), inside(b["y1"], height).alias("y1"))
    finite = F.forall(F.array(b["x0"], b["y0"], b["x1"], b["y1"]), lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(finite & (c["x1"] - c["x0"] >= 1) & (c["y1"] - c["y0"] >= 1), c)


def clipped_point(p: Column, width: Column, height: Column) -> Column:
    inside = lambda v, size: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.greatest(size - 1, F.lit(0)).cast("double"))).cast("double")
    return F.struct(inside(p["x"], width).alias("x"), inside(p["y"], height).alias("y"))


def polygon_in_image(points: Column, width: Column, height: Column) -> Column:
    """Are there four finite points, none outside the image?"""
    good = lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & p["x"].between(0, width) & p["y"].between(0, height)
    return (F.size(points) == 4) & F.forall(points, good)


def region_in_image(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A rectangle with an area, inside the image; in 64 bits, so that sums don't wrap."""
    x, y, w, h = (c.cast("long") for c in (x, y, w, h))
    return (w > 0) & (h > 0) & (x + w <= width) & (y + h <= height)


def _turned(points: Column) -> Column:
    return F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def signed_area(points: Column) -> Column:
    terms = F.zip_with(points, _turned(points), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(points) < 3, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) * 0.5)


def polygon_area(points: Column) -> Column:
    return F.abs(signed_area(points))


def perimeter(points: Column) -> Column:
    return F.aggregate(F.zip_with(points, _turned(points), distance), F.lit(0.0), lambda s, t: s + t)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def cross(a: Column, b: Column, p: Column) -> Column:
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def _by(points: Column, *keys: str) -> Column:
    """Points sorted by the named coordinates, then by where they stood."""
    tagged = F.transform(points, lambda p, i: F.struct(*[p[k].alias(f"k_{k}") for k in keys], i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(tagged), lambda t: t["p"])


def order_clockwise(points: Column) -> Column:
    """Two left points and two right ones, each pair by y: top left, top right, bottom right, bottom left."""
    xs = _by(points, "x")
    left, right = _by(F.slice(xs, 1, 2), "y"), _by(F.slice(xs, 3, 2), "y")
    return F.array(left[0], right[0], right[1], left[1])


def order_by_rows(points: Column) -> Column:
    """Two top points and two bottom ones, each pair by x; the same order of corners."""
    ys = _by(points, "y", "x")
    top, bottom = _by(F.slice(ys, 1, 2), "x"), _by(F.slice(ys, 3, 2), "x")
    return F.array(top[0], top[1], bottom[1], bottom[0])


def is_vertical(quad: Column) -> Column:
    """Higher than wide by half, or without width."""
    width = F.greatest(distance(quad[0], quad[1]), distance(quad[2], quad[3]))
    height = F.greatest(distance(quad[1], quad[2]), distance(quad[3], quad[0]))
    return F.when(width < 1e-6, True).otherwise(F.round(F.try_divide(height, width), 2) >= 1.5)


def rotate(p: Column, angle: Column, origin: Column) -> Column:
    x, y = p["x"] - origin["x"], p["y"] - origin["y"]
    return F.struct((x * F.cos(angle) + y * F.sin(angle) + origin["x"]).alias("x"), (y * F.cos(angle) - x * F.sin(angle) + origin["y"]).alias("y"))


def char_boxes(cols: Column, char_width: Column, col_width: Column, b: Column) -> Column:
    """array<box> of characters: centre (col + 1/2) * col_width, edges floored and kept inside the line's box, from left to right."""

    def one(col: Column) -> Column:
        centre = (col + 0.5) * col_width
        x0 = F.floor(F.greatest(centre - char_width / 2, F.lit(0.0))) + b["x0"]
        x1 = F.floor(F.least(centre + char_width / 2, b["x1"] - b["x0"])) + b["x0"]
        return F.struct(x0.cast("double").alias("x0"), b["y0"].alias("y0"), x1.cast("double").alias("x1"), b["y1"].alias("y1"))

    return F.array_sort(F.transform(cols, one))


def line_char_width(words: Column, col_width: Column, b: Column, n_chars: Column) -> Column:
    """Mean width of the words' characters (words: array of arrays of columns); of the box's if no word has two; 0 without characters."""
    widths = F.transform(F.filter(words, lambda w: F.size(w) > 1), lambda w: mean_char_width(w, col_width))
    mean = F.aggregate(widths, F.lit(0.0), lambda s, w: s + w) / F.greatest(F.size(widths), F.lit(1))
    return F.when(n_chars == 0, 0.0).when(F.size(widths) > 0, mean).otherwise(F.try_divide(b["x1"] - b["x0"], n_chars))


def word_boxes(words: Column, char_width: Column, col_width: Column, b: Column, whole: Column) -> Column:
    """array<box>: one box a word if `whole`, else one a character."""
    around = lambda cs: F.struct(F.array_min(F.transform(cs, lambda c: c["x0"])).alias("x0"), b["y0"].alias("y0"), F.array_max(F.transform(cs, lambda c: c["x1"])).alias("x1"), b["y1"].alias("y1"))
    boxes = F.transform(F.filter(words, lambda w: F.size(w) > 0), lambda w: char_boxes(w, char_width, col_width, b))
    return F.when(whole, F.transform(boxes, around)).otherwise(F.flatten(boxes))


def vertical_padding(width: Column, height: Column, ratio: float, least: int) -> Column:
    """Rows to add above and below: for an image that is low, or too wide for its height (no such limit if the ratio is negative)."""
    wide = width / height > ratio if ratio >= 0 else F.lit(False)
    target = F.floor(F.greatest(width / ratio, F.lit(float(least)))) * 2 if ratio > 0 else F.lit(least * 2)
    return F.when((height > least) & ~wide, 0).otherwise(F.floor(F.abs(target - height) / 2)).cast("int")


def mean_char_width(cols: Column, col_width: Column) -> Column:
    return F.try_divide((F.array_max(cols) - F.array_min(cols)) * col_width, F.size(cols) - 1)


def spread_overlaps(boxes: Column) -> Column:
    """Neighbours that overlap each give up half; left edges look back, right edges look ahead, in the order they came."""

    def step(done: Column, b: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        half = F.when(F.size(done) > 0, F.greatest(last["x1"] - b["x0"], F.lit(0.0)) / 2).otherwise(0.0)
        moved = F.struct(last["x0"].alias("x0"), last["y0"].alias("y0"), (last["x1"] - half).alias("x1"), last["y1"].alias("y1"))
        own = F.struct((b["x0"] + half).alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"))
        return F.when(F.size(done) == 0, F.array(own)).otherwise(F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(moved, own)))

    empty = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    return F.aggregate(boxes, empty, step)


# --- general quads: convex clipping has no column form

def _area(points: list) -> float:
    n = len(points)
    return 0.0 if n < 3 else abs(sum(points[i][0] * points[(i + 1) % n][1] - points[(i + 1) % n][0] * points[i][1] for i in range(n))) / 2


def clip_convex(subject: list, clip: list) -> list:
    """The part of a polygon inside a convex one: cut by the line of each of its sides in turn."""
    n = len(clip)
    turn = sum(clip[i][0] * clip[(i + 1) % n][1] - clip[(i + 1) % n][0] * clip[i][1] for i in range(n))
    sign = math.copysign(1.0, turn)
    for k in range(n):
        (ax, ay), (bx, by) = clip[k], clip[(k + 1) % n]
        height = [((bx - ax) * (y - ay) - (by - ay) * (x - ax)) * sign for x, y in subject]
        out = []
        for i, (p, h) in enumerate(zip(subject, height, strict=True)):
            j = (i + 1) % len(subject)
            q, g = subject[j], height[j]
            if (h >= 0) != (g >= 0):
                t = h / (h - g)
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
            if g >= 0:
                out.append(q)
        subject = out
        if not subject:
            break
    return subject


def quad_iou_of(a: list, b: list) -> float:
    common = _area(clip_convex(a, b))
    union = _area(a) + _area(b) - common
    return common / union if union > 0 else 0.0


quad_iou = F.udf(
    lambda a, b: None if a is None or b is None else quad_iou_of([(p["x"], p["y"]) for p in a], [(p["x"], p["y"]) for p in b]), T.DoubleType(), useArrow=True
)


def convex_hull_of(points: list) -> list:
    """Counter-clockwise hull from the leftmost lowest point."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

    def half(pts: list) -> list:
        out: list = []
        for p in pts:
            while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def min_area_rect_of(points: list) -> list:
    """Four corners of the smallest rectangle around the points: one of its sides lies on a side of the hull."""
    hull = convex_hull_of(points)
    if len(hull) < 3:
        a, b = hull[0], hull[-1]
        return [a, b, b, a]
    best = None
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1], strict=True):
        size = math.hypot(bx - ax, by - ay)
        ux, uy = (bx - ax) / size, (by - ay) / size
        along, across = [x * ux + y * uy for x, y in hull], [y * ux - x * uy for x, y in hull]
        area = (max(along) - min(along)) * (max(across) - min(across))
        if best is None or area < best[0] - 1e-12:
            corners = [(u * ux - v * uy, u * uy + v * ux) for u, v in ((min(along), min(across)), (max(along), min(across)), (max(along), max(across)), (min(along), max(across)))]
            best = (area, corners)
    return best[1]


_quad_type = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
convex_hull = F.udf(lambda ps: None if ps is None else [{"x": x, "y": y} for x, y in convex_hull_of([(p["x"], p["y"]) for p in ps])], _quad_type, useArrow=True)
min_area_rect = F.udf(lambda ps: None if not ps else [{"x": x, "y": y} for x, y in min_area_rect_of([(p["x"], p["y"]) for p in ps])], _quad_type, useArrow=True)


def homography_of(src: list, dst: list) -> list:
    """3x3 matrix, row by row, that takes four points to four others; the identity if there is none."""
    import numpy as np

    rows, right = [], []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    try:
        return [*np.linalg.solve(np.array(rows, float), np.array(right, float)).tolist(), 1.0]
    except np.linalg.LinAlgError:
        return [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]


def words_to_page_of(line: list, words: list, vertical: bool) -> list:
    """Quads of words in the crop of a line, on the page: what makes the line's quad upright is undone.

    A vertical line was read turned by a quarter, so its words are turned back first.
    """
    import numpy as np

    left, top = min(x for x, _ in line), min(y for _, y in line)
    own = [(x - left, y - top) for x, y in line]
    wide, high = math.dist(own[0], own[1]), math.dist(own[0], own[3])
    to_crop = np.array(homography_of(own, [(0, 0), (wide, 0), (wide, high), (0, high)])).reshape(3, 3)
    back = np.linalg.inv(to_crop) if abs(np.linalg.det(to_crop)) > 1e-12 else np.eye(3)
    out = []
    for word in words:
        points = []
        for x, y in word:
            if vertical:
                x, y = wide - y, x
            u, v, w = back @ (x, y, 1.0)
            points.append((float(u / w if w else u) + left, float(v / w if w else v) + top))
        points.sort(key=lambda p: (p[1], p[0]))
        upper, lower = sorted(points[:2]), sorted(points[2:])
        out.append([*upper, *lower[::-1]])
    return out


@F.udf(T.ArrayType(_quad_type), useArrow=True)
def words_to_page(line, words, vertical):
    if line is None or words is None:
        return None
    pairs = lambda q: [(p["x"], p["y"]) for p in q]
    return [[{"x": x, "y": y} for x, y in quad] for quad in words_to_page_of(pairs(line), [pairs(w) for w in words], bool(vertical))]
