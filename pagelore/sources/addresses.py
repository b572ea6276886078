"""Files behind addresses: what may be fetched, and fetching it with a limit on bytes and pixels.

Nothing is fetched unless the caller passes the function that opens an address; a cluster has its own ways out. The
function is called in the tasks and gives a stream with read(n), or raises; failures are rows, not errors of the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import closing
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions import text as X
from pagelore.sources.images import dimensions_of


def read_limited(open_url: Callable[[str], BinaryIO], url: str, most_bytes: int, most_pixels: int) -> tuple[bytes | None, str | None]:
    """(content, failure). A byte more than the limit is read, never the rest, so that a long answer is known without being held."""
    try:
        with closing(open_url(url)) as stream:
            data = stream.read(most_bytes + 1)
    except Exception as error:  # noqa: BLE001  (whatever the caller's function raises is the address's failure)
        return None, f"network: {type(error).__name__}"
    if len(data) > most_bytes:
        return None, "too many bytes"
    size = dimensions_of(data)
    if size is None:
        return None, "not an image"
    return (data, None) if 0 < size[0] * size[1] <= most_pixels else (None, "too many pixels")


def read_addresses(df: DataFrame, url: str, *, open_url: Callable[[str], BinaryIO], most_bytes: int, most_pixels: int) -> DataFrame:
    """df with content and failure for each address."""
    names = df.columns
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + ["content binary", "failure string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [read_limited(open_url, u, most_bytes, most_pixels) if isinstance(u, str) else (None, "no address") for u in pdf[url]]
            yield pdf[names].assign(content=[g[0] for g in got], failure=[g[1] for g in got])

    return df.mapInPandas(run, shape)


def redirect_refusal(hops: Column, hosts: tuple[str, ...], most: int = 5) -> Column:
    """Why a chain of addresses may not be followed to its end: the first hop's scheme or host, an empty place, or too many hops; null if it may."""
    wrong = F.transform(F.slice(hops, 1, most + 1), lambda u, i: F.when(i >= most, "too many").when(F.coalesce(u, F.lit("")) == "", "no place").otherwise(X.download_refusal(u, hosts)))
    return F.try_element_at(F.filter(wrong, lambda w: w.isNotNull()), F.lit(1))


def progress(files: DataFrame, *, by: str, at: str, size: str) -> DataFrame:
    """The files to be fetched, in order, with index (from 1), total and bytes_before: what an observer is told as each begins."""
    from pyspark.sql import Window

    line, every = Window.partitionBy(by).orderBy(at), Window.partitionBy(by)
    need = files.where(F.col("state") != "present")
    before = F.coalesce(F.sum(size).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return need.withColumns({"index": F.row_number().over(line), "total": F.count(F.lit(1)).over(every), "bytes_before": before})
