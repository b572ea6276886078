"""Filters and constraints over regions and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions import geometry as G
from pagelore.functions import text as X


def keep_scores(df: DataFrame, least: float, score: str = "score") -> DataFrame:
    """Rows whose score is `least` or more."""
    return df.where(F.col(score) >= least)


def keep_texts(df: DataFrame, text: str) -> DataFrame:
    """Rows whose text has more than white space."""
    return df.where(~X.is_blank(F.col(text)))


def clip_boxes(df: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes cut to the image and floored; those three pixels or less on a side go."""
    edge = lambda c, size: F.floor(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(float(max(size - 1, 0))))).cast("double")
    out = df.withColumns({"x0": edge("x0", width), "x1": edge("x1", width), "y0": edge("y0", height), "y1": edge("y1", height)})
    return out.where((F.floor(F.col("x1") - F.col("x0")) > 3) & (F.floor(F.col("y1") - F.col("y0")) > 3))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows that break a rule, with the names of the rules that they break. A rule that can't be told isn't broken."""
    names = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return df.withColumn("violations", F.array_join(names, ",")).where(F.col("violations") != "")


def region_rules(width: Column, height: Column) -> dict[str, Column]:
    """The rules of a page's regions (kind, text, latex, score, polygon)."""
    formula = F.col("kind") == "formula"
    return {
        "formula without outcome": formula & F.col("latex").isNull(),
        "formula with text": formula & F.col("text").isNotNull(),
        "text with formula": ~formula & F.col("latex").isNotNull(),
        "score": ~F.col("score").between(0, 1) | F.isnan("score"),
        "polygon": F.col("polygon").isNotNull() & ~G.polygon_in_image(F.col("polygon"), width, height),
    }


def require(df: DataFrame, rule: Column, message: str) -> DataFrame:
    """df, whose rows raise the message if they break the rule."""
    first = df.columns[0]
    return df.withColumn(first, F.when(rule, F.col(first)).otherwise(F.raise_error(F.lit(message))))
