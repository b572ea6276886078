"""Pages as Markdown, JSON and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.functions import text as X

NOTHING = "No text detected."
#: Colours of outlines, in turn.
PALETTE = ("#ff0000", "#00aa00", "#0066ff", "#ff8c00", "#8000ff", "#ff1493", "#00bfbf", "#ffd700")


def visual_lines(df: DataFrame, *, page: str, rid: str, text: str) -> DataFrame:
    """page, markdown: boxes by top and left; a box that overlaps the one before, or is centred near it, joins its line.

    Parts of a line stand three spaces apart; a gap of over seven tenths of the height before leaves a blank line.
    """
    w = Window.partitionBy(page).orderBy("y0", "x0", rid)
    height, centre = F.col("y1") - F.col("y0"), (F.col("y0") + F.col("y1")) * 0.5
    rows = df.withColumns({"h": height, "c": centre, "nth": F.row_number().over(w)})
    rows = rows.withColumns({f"p_{k}": F.lag(v).over(w) for k, v in (("h", "h"), ("c", "c"), ("y0", "y0"), ("y1", "y1"))})
    near = F.abs(F.col("c") - F.col("p_c")) < F.least("h", "p_h") * 0.5
    overlap = F.least("p_y1", "y1") > F.greatest("p_y0", "y0")
    gap = F.col("y0") - F.col("p_y1") > F.col("p_h") * 0.7
    lead = F.when(F.col("nth") == 1, "").when(near | overlap, "   ").when(gap, "\n\n").otherwise("\n")
    parts = F.array_sort(F.collect_list(F.struct("nth", F.concat(lead, F.col(text)).alias("t"))))
    return rows.groupBy(page).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("markdown"))


def joined_text(texts: Column) -> Column:
    return F.when(F.size(texts) == 0, NOTHING).otherwise(F.array_join(texts, "\n"))


def plain_text(ordered: DataFrame, *, page: str, at: list[str], text: str) -> DataFrame:
    """page, plain: texts in the order of `at`, a line each."""
    rows = F.array_sort(F.collect_list(F.struct(*at, text)))
    return ordered.groupBy(page).agg(F.array_join(F.transform(rows, lambda r: r[text]), "\n").alias("plain"))


def reading_markdown(df: DataFrame, *, page: str, at: list[str]) -> DataFrame:
    """page, markdown from regions in reading order (`at`: group, place; text or latex, truncated; y0, y1).

    A group's parts stand three spaces apart, or on lines of their own if one is a formula; a gap of over seven tenths of
    the lesser height leaves a blank line.
    """
    group, place = at
    part = F.when(F.col("latex").isNotNull(), X.markdown_block(F.col("latex"), F.coalesce("truncated", F.lit(False)))).otherwise(F.col("text"))
    rows = df.withColumn("part", part).groupBy(page, group).agg(
        F.array_sort(F.collect_list(F.when(F.col("part") != "", F.struct(F.col(place).alias("place"), "part")))).alias("parts"),
        F.max(F.col("latex").isNotNull()).alias("formula"),
        F.min("y0").alias("top"),
        F.max("y1").alias("bottom"),
    )
    rows = rows.where(F.size("parts") > 0)
    w = Window.partitionBy(page).orderBy(group)
    last, high = F.lag("bottom").over(w), F.lag(F.col("bottom") - F.col("top")).over(w)
    blank = F.col("top") - last > F.least(F.col("bottom") - F.col("top"), high) * 0.7
    body = F.array_join(F.transform("parts", lambda p: p["part"]), "\n")
    line = F.array_join(F.transform("parts", lambda p: p["part"]), "   ")
    rows = rows.withColumn("block", F.concat(F.when(blank, "\n").otherwise(""), F.when(F.col("formula"), body).otherwise(line)))
    blocks = F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "block")))
    return rows.groupBy(page).agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n").alias("markdown"))


def json_item(kind: Column, text: Column, score: Column, box: Column, latex: Column | None = None) -> Column:
    """A region as JSON. A formula's text is its LaTeX, its score that of the detector, 0 if there is none; a field without a value is left out."""
    fields = [box.alias("box"), text.alias("txt"), F.coalesce(score, F.lit(0.0)).alias("score"), kind.alias("kind")]
    return F.to_json(F.struct(*fields, *([latex.alias("latex")] if latex is not None else [])))


def output_item(*, found_score: Column, polygon: Column, text: Column, text_score: Column, latex: Column, eos_index: Column, truncated: Column) -> Column:
    """A region as a struct of an output document; null for a region with neither text nor formula.

    A formula's text is its LaTeX, its score the detector's (found_score, 0 if there is none). Written as JSON, what is null is left out.
    """
    formula = latex.isNotNull()
    box = F.transform(polygon, lambda p: F.array(p["x"], p["y"]))
    fields = [
        box.alias("box"), F.when(formula, latex).otherwise(text).alias("txt"), F.when(formula, F.coalesce(found_score, F.lit(0.0))).otherwise(text_score).alias("score"),
        F.when(formula, "formula").otherwise("text").alias("kind"), latex.alias("latex"), F.when(formula, eos_index).alias("eos_index"), F.when(formula, truncated).alias("truncated"),
    ]
    return F.when(formula | text.isNotNull(), F.struct(*fields))


def page_documents(items: DataFrame, *, page: str, at: list[str], rid: str, item: str) -> DataFrame:
    """page, document: one JSON object a page, with text (lines in the order of `at`), items (by rid) and formulas (in that order, with their region)."""
    rows = items.where(F.col(item).isNotNull()).select(page, F.struct(*at).alias("at"), F.col(rid).alias("rid"), F.col(item).alias("item"))
    pages = rows.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("at", "rid", "item"))).alias("read"), F.array_sort(F.collect_list(F.struct("rid", "item"))).alias("given"))
    formulas = F.transform(F.filter("read", lambda r: r["item"]["kind"] == "formula"), lambda r: F.struct(r["rid"].alias("region"), r["item"]["latex"].alias("latex")))
    text = F.array_join(F.transform("read", lambda r: r["item"]["txt"]), "\n")
    return pages.select(page, F.to_json(F.struct(text.alias("text"), F.transform("given", lambda r: r["item"]).alias("items"), formulas.alias("formulas"))).alias("document"))


def formula_json(latex: Column, eos_index: Column, truncated: Column, model: Column, elapsed_ms: Column, batch: Column, token_ids: Column | None = None) -> Column:
    """A formula's result as JSON; every field is there, null or not, and the tokens if they are asked for."""
    fields = {"latex": latex, "eos_index": eos_index, "truncated": truncated, "model_id": model, "elapsed_ms": elapsed_ms, "batch_size": batch} | ({"token_ids": token_ids} if token_ids is not None else {})
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def json_bounded(json: Column, limit: int) -> Column:
    """struct<json,bytes,too_large>: null beyond the limit."""
    n = F.octet_length(json)
    return F.struct(F.when(n <= limit, json).alias("json"), n.alias("bytes"), (n > limit).alias("too_large"))


def color_of(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod(index, F.lit(len(PALETTE))) + 1).cast("int"))


def html_report(regions: DataFrame, *, page: str, rid: str, title: Column, width: Column, height: Column) -> DataFrame:
    """page, html: one document a page with an outline and a list entry for each region (x0..y1, text)."""
    outline = F.format_string('<rect x="%.1f" y="%.1f" width="%.1f" height="%.1f" stroke="%s"/>', F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), color_of(F.col(rid)))
    entry = F.concat(F.lit("<li>"), X.escape_html(F.col("text")), F.lit("</li>"))
    rows = regions.select(page, title.alias("title"), width.alias("w"), height.alias("h"), F.struct(F.col(rid).alias("i"), outline.alias("o"), entry.alias("e")).alias("r"))
    pages = rows.groupBy(page).agg(F.first("title").alias("title"), F.first("w").alias("w"), F.first("h").alias("h"), F.array_sort(F.collect_list("r")).alias("rs"))
    body = lambda f: F.array_join(F.transform("rs", lambda r: r[f]), "")
    head = F.concat(F.lit("<!doctype html><meta charset=utf-8><title>"), X.escape_html(F.col("title")), F.lit("</title>"))
    return pages.select(page, F.concat(head, F.format_string('<svg viewBox="0 0 %d %d">', F.col("w").cast("long"), F.col("h").cast("long")), body("o"), F.lit("</svg><ol>"), body("e"), F.lit("</ol>")).alias("html"))


def data_url(content: Column, kind: str = "image/png") -> Column:
    """Bytes as an address of one line, whatever the session says of line breaks in base 64."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.translate(F.base64(content), "\r\n", ""))
