"""Pages as files: one document a row, many rows a file, or one file a page where that is what is wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, *, limit: int | None = None) -> None:
    """One JSON object a line. A row over the limit of bytes raises an error, before anything is committed."""
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    if limit:
        line = F.when(F.octet_length(line) <= limit, line).otherwise(F.raise_error(F.lit("a document is too large")))
    df.select(line.alias("value")).write.text(path)


def write_documents(df: DataFrame, path: str, *, page: str, document: Column, buckets: int = 64) -> None:
    """Documents as text in folders page_bucket=<n>, each with its page's number before it; folders stay few, however many pages."""
    rows = df.select(F.pmod(F.xxhash64(page), F.lit(buckets)).alias("page_bucket"), F.to_json(F.struct(F.col(page).alias("page"), document.alias("document"))).alias("value"))
    rows.repartition("page_bucket").write.partitionBy("page_bucket").text(path)


def write_tables(tables: dict[str, DataFrame], path: str, *, by: list[str] | None = None) -> None:
    """Result tables as Parquet, a folder each."""
    for name, df in tables.items():
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{path}/{name}")
