"""Order on a page: visual lines, gaps, reading order, batches by shape, and decoding of ordered frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def line_ids(df: DataFrame, *, page: str, rid: str, step: float = 10.0) -> DataFrame:
    """page, rid, line, place: boxes by y; a new line where y grows by `step` or more; within a line by x."""
    by_y = Window.partitionBy(page).orderBy("y0", rid)
    jump = F.when(F.col("y0") - F.lag("y0").over(by_y) >= step, 1).otherwise(0)
    lines = df.withColumn("jump", jump).withColumn("line", F.sum("jump").over(by_y.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    place = F.row_number().over(Window.partitionBy(page).orderBy("line", "x0", "y0", rid))
    return lines.select(page, rid, "line", place.alias("place"))


def largest_gap(df: DataFrame, *, page: str, start: str, end: str) -> DataFrame:
    """page, gap_start, gap_end: the widest empty stretch between merged intervals; of equal ones the first. Pages without one are left out."""
    low, high = F.least(start, end), F.greatest(start, end)
    rows = df.select(page, low.alias("low"), high.alias("high")).where(~F.isnan("low") & ~F.isnan("high"))
    before = Window.partitionBy(page).orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    gaps = rows.withColumn("reach", F.max("high").over(before)).where("low > reach")
    return gaps.groupBy(page).agg(F.min(F.struct((F.col("reach") - F.col("low")).alias("width"), F.col("reach").alias("gap_start"), F.col("low").alias("gap_end"))).alias("g")).select(page, "g.gap_start", "g.gap_end")


def upper_median_height(df: DataFrame, *, page: str) -> DataFrame:
    """page, median: the upper median of the positive heights; 1 where there is none."""
    height = F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))
    found = df.groupBy(page).agg(F.array_sort(F.collect_list(F.when((height > 0) & (height < float("inf")), height))).alias("h"))
    return found.select(page, F.coalesce(F.try_element_at("h", F.floor(F.size("h") / 2).cast("int") + 1), F.lit(1.0)).alias("median"))


def aspect_batches(df: DataFrame, *, rid: str, ratio: Column, group: str, size: int = 6) -> DataFrame:
    """group, rid, batch, batch_ratio: crops of a group by shape, in batches of `size`, each as wide as its widest."""
    ordered = df.withColumn("ratio", ratio).withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy("ratio", rid)))
    out = ordered.withColumn("batch", F.floor((F.col("nth") - 1) / size).cast("int"))
    return out.select(group, rid, "batch", F.max("ratio").over(Window.partitionBy(group, "batch")).alias("batch_ratio"))


def ctc_decode(frames: DataFrame, *, line: str, at: list[str], token: str, prob: str, letter: Column) -> DataFrame:
    """line, text, score: repeats of the token before and blanks (0) are dropped; the score is the mean of the rest, rounded to five digits half to even, 0 if none is left."""
    w = Window.partitionBy(line).orderBy(*at)
    kept = (F.col(token) != 0) & ~F.col(token).eqNullSafe(F.lag(token).over(w))
    rows = frames.select(line, *at, token, prob, letter.alias("letter"), kept.alias("kept"), F.row_number().over(w).alias("nth"))
    round5 = lambda c: F.rint(c * 100000.0) / 100000.0
    letters = F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("nth", "letter"))))
    return rows.groupBy(line).agg(
        F.array_join(F.transform(letters, lambda x: x["letter"]), "").alias("text"),
        round5(F.coalesce(F.avg(F.when(F.col("kept"), round5(F.col(prob)))), F.lit(0.0))).alias("score"),
    )


def eos_prefix(tokens: Column, eos: int = 2) -> Column:
    """struct<prefix,eos_index,truncated>: tokens up to the first end mark and with it; all of them, and truncated, if there is none."""
    at = F.array_position(tokens, F.lit(eos).cast("long"))
    return F.struct(
        F.when(at > 0, F.slice(tokens, F.lit(1), at.cast("int"))).otherwise(tokens).alias("prefix"),
        F.when(at > 0, (at - 1).cast("int")).alias("eos_index"),
        (at == 0).alias("truncated"),
    )


def argmax(values: Column) -> Column:
    """0-based place of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


# --- reading order: recursive, so a function over a page's boxes


def _gap(intervals: list[tuple[float, float]]) -> tuple[float, float] | None:
    """The widest gap between merged intervals, the first of equal ones."""
    if len(intervals) < 2:
        return None
    best, reach = None, None
    for a, b in sorted((min(i), max(i)) for i in intervals):
        if reach is not None and a > reach and (best is None or a - reach > best[1] - best[0]):
            best = (reach, a)
        reach = b if reach is None else max(reach, b)
    return best


def _lines(boxes: list[tuple]) -> list[list[int]]:
    lines: list[list[tuple]] = []
    for b in sorted(boxes, key=lambda b: (b[2], b[1], b[0])):
        best = None
        for line in lines:
            top, bottom = min(x[2] for x in line), max(x[4] for x in line)
            overlap = max(min(bottom, b[4]) - max(top, b[2]), 0.0)
            if overlap / max(min(max(bottom - top, 0.0), max(b[4] - b[2], 0.0)), 0.0001) >= 0.5 and (best is None or overlap > best[0]):
                best = (overlap, line)
        best[1].append(b) if best else lines.append([b])
    lines.sort(key=lambda line: (min(x[2] for x in line), min(x[1] for x in line)))
    return [[b[0] for b in sorted(line, key=lambda b: (b[1], b[2], b[0]))] for line in lines]


def reading_groups_of(boxes: list[tuple]) -> list[list[int]]:
    """Groups of ids in reading order, of boxes (id, x0, y0, x1, y1).

    A page is cut at a section break (a gap of one and a half heights), else between columns (half a height), else at any
    gap between rows; what can't be cut is read in lines. The stack stands for recursion, so depth is no matter.
    """
    out, stack = [], [list(boxes)]
    while stack:
        own = stack.pop()
        if len(own) < 2:
            out += [[b[0]] for b in own]
            continue
        heights = sorted(h for b in own if 0 < (h := b[4] - b[2]) < float("inf"))
        median = heights[len(heights) // 2] if heights else 1.0
        rows, columns = _gap([(b[2], b[4]) for b in own]), _gap([(b[1], b[3]) for b in own])
        cuts = []
        if rows and rows[1] - rows[0] >= median * 1.5:
            cuts.append((rows, 4, 2))
        if columns and columns[1] - columns[0] >= max(median * 0.5, 2.0):
            cuts.append((columns, 3, 1))
        if rows and rows[1] - rows[0] >= 1.0:
            cuts.append((rows, 4, 2))
        for (a, z), last, first in cuts:
            middle = (a + z) * 0.5
            before, after = [b for b in own if b[last] <= middle], [b for b in own if b[first] >= middle]
            if before and after and len(before) + len(after) == len(own):
                stack += [after, before]
                break
        else:
            out += _lines(own)
    return out


reading_groups = F.udf(
    lambda rows: None if rows is None else reading_groups_of([(r["id"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows]), T.ArrayType(T.ArrayType(T.LongType())), useArrow=True
)


def reading_order(df: DataFrame, *, page: str, rid: str) -> DataFrame:
    """page, rid, grp, place: groups of regions in reading order. Regions without a box come last, each a group, by rid."""
    has = F.forall(F.array("x0", "y0", "x1", "y1"), lambda v: v.isNotNull() & ~F.isnan(v))
    row = F.struct(F.col(rid).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    pages = df.groupBy(page).agg(F.array_sort(F.collect_list(F.when(has, row))).alias("boxes"), F.array_sort(F.collect_list(F.when(~F.coalesce(has, F.lit(False)), F.col(rid).cast("long")))).alias("rest"))
    groups = F.concat(reading_groups("boxes"), F.transform("rest", lambda i: F.array(i)))
    return pages.select(page, F.posexplode(groups).alias("grp", "ids")).select(page, F.posexplode("ids").alias("place", rid), "grp").select(page, rid, "grp", "place")


def tiles(df: DataFrame, *, width: Column, height: Column, tile: int, overlap: int) -> DataFrame:
    """The rows with one row a tile: tx, ty, tw, th. Steps of tile - overlap while inside; the last ones are cut at the edge."""
    if tile <= 0 or not 0 <= overlap < tile:
        raise ValueError("overlap must be less than the tile")
    step = tile - overlap
    at = lambda size: F.explode(F.when(size > 0, F.sequence(F.lit(0), (size - 1).cast("int"), F.lit(step))))
    out = df.withColumns({"img_w": width, "img_h": height}).withColumn("ty", at(F.col("img_h"))).withColumn("tx", at(F.col("img_w")))
    return out.withColumns({"tw": F.least(F.lit(tile), F.col("img_w") - F.col("tx")).cast("int"), "th": F.least(F.lit(tile), F.col("img_h") - F.col("ty")).cast("int")}).drop("img_w", "img_h")


# --- words of a decoded line


def word_islands_of(text: str, kept: list[bool]) -> list[tuple[str, list[int], str]]:
    """(word, frame columns, cn or en): cut at white space, where the script changes, and where columns lie over five apart."""
    cols = [i for i, k in enumerate(kept) if k]
    if not cols or not text:
        return []
    chinese = lambda c: "一" <= c <= "鿿" or "　" <= c <= "〿" or "＀" <= c <= "￯"
    width = [min(3 if chinese(text[0]) else 2, cols[0])] + [b - a for a, b in zip(cols, cols[1:], strict=False)]
    out, word, at, state = [], "", [], None

    def close() -> None:
        nonlocal word, at
        if word:
            out.append((word, at, state or "en"))
        word, at = "", []

    for i, c in enumerate(text):
        if c.isspace():
            close()
            continue
        kind = "cn" if chinese(c) else "en"
        state = state or kind
        if kind != state or (width[i] if i < len(width) else 0) > 5:
            close()
            state = kind
        word += c
        if i < len(cols):
            at = [*at, cols[i]]
    close()
    return out


_WORDS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("cols", T.ArrayType(T.IntegerType())), T.StructField("kind", T.StringType())]))
word_islands = F.udf(
    lambda t, k: None if t is None or k is None else [{"word": w, "cols": c, "kind": s} for w, c, s in word_islands_of(t, list(k))], _WORDS, useArrow=True
)
