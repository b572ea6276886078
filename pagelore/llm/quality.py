"""Quality of documents by a regularised quadratic discriminant over transformed document statistics.

A document becomes a short vector of statistics, each transformed to be roughly bell-shaped. Each class gets
a mean and a covariance, shrunk towards the pooled covariance and its diagonal; a document's score is the logistic of
the difference of the two log densities, whose Mahalanobis parts come from cached Cholesky factors. Counts, sums and
products are gathered over all labelled rows by partial aggregation: one row a task reaches the driver's side.

Defined results: a null text is the empty text; every document, the empty one too, gets a score; labels
other than 0 and 1, or null, are not learned from; a document labelled twice counts twice; a document whose id is null is
scored and never learned from (its remainder is null, held_out false); if a class has no labelled row the
other's prior decides, and with none at all every score is 0.5. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm.common import tune, written

#: The statistics, in the order of the vector.
FEATURES = ("log_words", "word_length", "upper", "digits", "symbols", "worst_symbols", "repeats", "worst_repeats", "lines_again", "variety", "stops")
SYMBOLS = b"#$%&*|!~^=<>{}[]\\_@"
_SYMBOL, _UPPER, _DIGIT, _STOP = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(SYMBOLS)] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_STOP[[33, 46, 63]] = True


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text. Shares are drawn towards usual ones by a few words' weight, so that a short text is not an odd one."""
    data = text.encode("utf-8", "surrogatepass")
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    w, different = len(words), set(lines)
    worst_symbols = worst_repeats = 0.0
    for line in different:
        own = line.split()
        if len(own) >= 3:
            worst_symbols = max(worst_symbols, sum(map(line.count, "#$%&*|!")) / (len(own) + 2))
            worst_repeats = max(worst_repeats, sum(map(eq, own, own[1:])) / (len(own) + 2))
    share = lambda mask, usual: ((float(histogram[mask].sum()) + usual) / (len(data) + 50)) ** 0.5
    return [
        float(np.log1p(w)),
        float(np.log1p((len(text) + 60) / (w + 10))),
        share(_UPPER, 1.0),
        share(_DIGIT, 0.2),
        share(_SYMBOL, 0.1),
        min(worst_symbols, 4.0) ** 0.5,
        (sum(map(eq, words, words[1:])) / (w + 10)) ** 0.5,
        worst_repeats**0.5,
        ((len(lines) - len(different)) / (len(lines) + 5)) ** 0.5,
        float(np.log1p(len(set(words))) / np.log1p(w + 1)) if w else 1.0,
        ((float(histogram[_STOP].sum()) + 1) / (w + 10)) ** 0.5,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x array<double>."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.selectExpr("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of the two classes; None for a class that was not seen."""

    means: list
    factors: list
    logs: list
    prior: float  # log odds of class 1

    @staticmethod
    def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float, ridge: float) -> Discriminant:
        """moments: class -> (rows, sums, sums of products)."""
        n = [moments[c][0] if c in moments else 0.0 for c in (0, 1)]
        if not all(n):
            return Discriminant([], [], [], 0.0 if not any(n) else 20.0 if n[1] else -20.0)
        means = [moments[c][1] / n[c] for c in (0, 1)]
        own = [moments[c][2] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
        pooled = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
        factors, logs = [], []
        for c in (0, 1):
            mixed = (1 - shrink) * own[c] + shrink * pooled
            mixed = (1 - shrink) * mixed + shrink * np.diag(np.diag(mixed)) + ridge * np.eye(len(mixed))
            lower = np.linalg.cholesky(mixed)
            factors.append(np.linalg.inv(lower))
            logs.append(float(2 * np.log(np.diag(lower)).sum()))
        return Discriminant(means, factors, logs, float(np.log(n[1] / n[0])))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        odds = np.full(len(x), self.prior)
        if self.means:
            far = [((x - m) @ f.T) for m, f in zip(self.means, self.factors, strict=True)]
            dense = [-0.5 * ((f**2).sum(1) + g) for f, g in zip(far, self.logs, strict=True)]
            odds = odds + dense[1] - dense[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def moments_of(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Counts, sums and sums of products by class, of rows (x, quality): partial sums a task, then one row a class."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            x, y = np.array(batch.column("x").to_pylist(), float).reshape(-1, d), np.array(batch.column("quality").to_pylist())
            for c in (0, 1):
                own = x[y == c] if len(x) else x
                if len(own):
                    part = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                    total[c] = total[c] + part if c in total else part
        for c, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(part), pa.int32()), pa.array(range(len(part)), pa.int32()), pa.array(part)], ["quality", "at", "v"])

    sums = rows.select("x", "quality").mapInArrow(run, "quality int, at int, v double").groupBy("quality", "at").agg(F.sum("v").alias("v")).collect()
    out = {}
    for c in {r["quality"] for r in sums}:
        flat = np.zeros(1 + d + d * d)
        for r in sums:
            if r["quality"] == c:
                flat[r["at"]] = r["v"]
        out[c] = (flat[0], flat[1 : 1 + d], flat[1 + d :].reshape(d, d))
    return out


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, *, shrink: float = 0.2, ridge: float = 1e-3) -> DataFrame:
    """doc_id, held_out, score, predicted for all documents, learned from the labelled ones that held_out does not hold for."""
    x = written(document_statistics(docs), "quality-statistics")
    marked = x.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    model = Discriminant.fit(moments_of(marked.where(~F.col("held_out")).join(known, "doc_id")), shrink, ridge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.scores(np.array(batch.column("x").to_pylist(), float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return marked.select("doc_id", "held_out", "x").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
