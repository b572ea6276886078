"""The functions that have no built-in form, under names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pagelore.functions import bidi, geometry, text
from pagelore.operators import order
from pagelore.session import ship

FUNCTIONS = {
    "quad_iou": geometry.quad_iou,
    "convex_hull": geometry.convex_hull,
    "min_area_rect": geometry.min_area_rect,
    "nfc": text.nfc,
    "pair_right_commands": text.pair_right_commands,
    "visual_order": bidi.visual_order,
    "reading_groups": order.reading_groups,
    "word_islands": order.word_islands,
}


def register(spark: SparkSession) -> None:
    """After this `SELECT visual_order(text) FROM t` works."""
    ship(spark)
    for name, function in FUNCTIONS.items():
        spark.udf.register(name, function)
