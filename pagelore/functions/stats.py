"""Statistics of samples and the time ledger of a page."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Of a group's rows, one in so many is what the bounds around a rank may be off by.
ACCURACY = 10_000


def shared(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of df, for readers that read them more than once and whose values are dear to compute.

    Equal rows are counted and then spread again. All grouping columns are part of that exchange, whatever a reader
    needs of them, and no reader's filter gets below it, since each value hangs on the spreading; so the exchange's plan is
    the same for every reader, and Spark makes it once.
    """
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("how often"))
    rows = counted.select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("how often").cast("int"))).alias("one"))
    return rows.select(*[F.when(F.col("one") == 1, F.col(c)).alias(c) for c in columns])


def at_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """by, n, and a column for each of ranks: the value at that rank (from 0), exactly. ranks: name -> (share of n near it, rank from n).

    A sketch first gives each group two bounds around each rank; rows below them are only counted, and only the rows
    between them are sorted: some ten-thousandths of the group. A group of fewer rows than ACCURACY lies between its ends.
    """
    margin, shares = 3 / ACCURACY, sorted({q for q, _ in ranks.values()})
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    sketch = lambda q: F.percentile_approx("v", F.array(F.lit(max(0.0, q - margin)), F.lit(min(1.0, q + margin))), F.lit(ACCURACY))
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), *[sketch(q).alias(f"near{k}") for k, q in enumerate(shares)])
    few = F.col("n") < ACCURACY
    ends = [F.struct(F.when(few, F.col("least")).otherwise(F.col(f"near{k}")[0]).alias("low"), F.when(few, F.col("most")).otherwise(F.col(f"near{k}")[1]).alias("high")).alias(f"band{k}") for k in range(len(shares))]
    bands = found.select(*[F.col(c).alias(f"its {c}") for c in by], "n", *ends)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"its {c}")) for c in by])
    met = rows.join(bands, same)
    place = lambda k: F.when(F.col("v") < F.col(f"band{k}.low"), F.struct(F.lit(k).alias("k"), F.lit(None).cast("double").alias("v"))).when(F.col("v") <= F.col(f"band{k}.high"), F.struct(F.lit(k).alias("k"), F.col("v").alias("v")))
    counted = met.select(*by, "n", F.explode(F.array_compact(F.array(*[place(k) for k in range(len(shares))]))).alias("x")).groupBy(*by, "n", "x.k", "x.v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "k").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    picked = [F.min(F.when((F.col("k") == shares.index(q)) & (F.col("upto") > rank(F.col("n"))), F.col("v"))).alias(name) for name, (q, rank) in ranks.items()]
    return counted.withColumn("upto", upto).groupBy(*by).agg(F.first("n").alias("n"), *picked)


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and a column for each of shares (name -> share): the quantile, interpolated between ranks."""
    place = lambda n, q: (n - 1) * q
    ranks = {f"{name} {end}": (q, lambda n, q=q, f=f: f(place(n, q))) for name, q in shares.items() for end, f in (("low", F.floor), ("high", F.ceil))}
    out = at_ranks(df, by, value, ranks)
    low, high = (lambda name: F.col(f"`{name} low`")), (lambda name: F.col(f"`{name} high`"))
    between = lambda name, q: low(name) + (high(name) - low(name)) * (place(F.col("n"), q) - F.floor(place(F.col("n"), q)))
    return out.select(*by, *[between(name, q).alias(name) for name, q in shares.items()])


def stats(value: Column) -> list[Column]:
    """n, min, max, mean, p50, p95 (interpolated) and sample deviation (0 for one) as aggregates; all 0 for no sample.

    The quantiles hold a group's different values in one task; for groups that grow with the data there is grouped_stats.
    """
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    own = lambda q: F.percentile(value, F.lit(q))
    return [F.count(value).alias("n"), zero(F.min(value), "min"), zero(F.max(value), "max"), zero(F.avg(value), "mean"), zero(own(0.5), "p50"), zero(own(0.95), "p95"), zero(F.stddev_samp(value), "stddev")]


def grouped_stats(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, min, max, mean, p50, p95 (interpolated) and sample deviation (0 for one); all 0 for no sample."""
    v = F.col(value)
    zero = lambda c, name: F.coalesce(c, F.lit(0.0)).alias(name)
    sums = df.groupBy(*by).agg(F.count(v).alias("n"), zero(F.min(v), "min"), zero(F.max(v), "max"), zero(F.avg(v), "mean"), zero(F.stddev_samp(v), "stddev"))
    return with_quantiles(sums, df, by, value, {"p50": 0.5, "p95": 0.95})


def with_quantiles(sums: DataFrame, df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """sums (one row for each of by) with the quantiles of df; 0 where a group has no value."""
    own = quantiles(df, by, value, shares).withColumnsRenamed({c: f"its {c}" for c in by})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"its {c}")) for c in by])
    return sums.join(own, same, "left").select(*sums.columns, *[F.coalesce(F.col(name), F.lit(0.0)).alias(name) for name in shares])


def ranked_from_histogram(df: DataFrame, by: str, value: str) -> DataFrame:
    """n, avg, p50 = s[(n-1)/2] and p90 = s[round((n-1)*0.9)] of each group, by rank and not interpolated."""
    picked = at_ranks(df, [by], value, {"p50": (0.5, lambda n: F.floor((n - 1) / 2)), "p90": (0.9, lambda n: F.floor((n - 1) * 0.9 + 0.5))})
    means = df.groupBy(F.col(by).alias("its group")).agg(F.avg(value).alias("avg"))
    return picked.join(means, F.col(by).eqNullSafe(F.col("its group"))).select(by, "n", "avg", "p50", "p90")


#: The named parts of a page's time.
PARTS = (
    "input_named_within", "input_overflow", "input_other",
    "detector_preprocess", "detector_infer", "detector_postprocess",
    "classifier_preprocess", "classifier_infer", "classifier_postprocess",
    "recognizer_preprocess", "recognizer_infer", "recognizer_postprocess",
    "formula", "page_postprocess",
)
TIMINGS = ("total", "preprocess", "decode", "resize", "crop", *PARTS[3:13], "postprocess")


def with_ledger(df: DataFrame) -> DataFrame:
    """The timings (columns of TIMINGS; a stage that did not run is null) with the parts of the ledger and their sums."""
    t = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    named, other = t("decode") + t("resize") + t("crop"), F.greatest(t("preprocess") - t("decode") - t("resize") - t("crop"), F.lit(0.0))
    budget = F.greatest(t("preprocess") - other, F.lit(0.0))
    out = df.withColumns({"input_other": other, "input_named_within": F.least(named, budget), "input_overflow": F.greatest(named - budget, F.lit(0.0)), "page_postprocess": t("postprocess")})
    part = lambda *names: sum((t(n) for n in names[1:]), t(names[0]))
    out = out.withColumns({"attributed": part(*PARTS), "inference": part("detector_infer", "classifier_infer", "recognizer_infer"), "input": t("input_named_within") + t("input_other")})
    pre, post = (part(*(f"{m}_{s}" for m in ("detector", "classifier", "recognizer"))) for s in ("preprocess", "postprocess"))
    out = out.withColumns({"rust": F.col("input") + pre + post + t("page_postprocess") + t("formula"), "unattributed": t("total") - F.col("attributed")})
    return out


def conservation(df: DataFrame) -> DataFrame:
    """residual, tolerance, conserved, excess and a word for it, of a ledger."""
    residual = F.col("attributed") - F.coalesce(F.col("total"), F.lit(0.0))
    tolerance = F.greatest(F.lit(1.6e-5), F.abs(F.coalesce(F.col("total"), F.lit(0.0))) * 1e-6)
    return df.withColumns({"residual": residual, "tolerance": tolerance}).withColumns(
        {
            "conserved": F.abs("residual") <= F.col("tolerance"),
            "excess": F.greatest(-F.col("residual"), F.lit(0.0)) + 0.0,  # no negative zero
            "verdict": F.when(F.abs("residual") <= F.col("tolerance"), "conserved").when(F.col("residual") > 0, "parts exceed total").otherwise("time without a name"),
        }
    )


def shares(df: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """Each part over the total; null if the total isn't positive."""
    return df.withColumns({f"{p}_share": F.when(F.col("total") > 0, F.try_divide(F.col(p), F.col("total"))) for p in parts})


def mean_ledger(df: DataFrame, parts: tuple[str, ...], by: list[str] | None = None) -> DataFrame:
    """The mean of each part; 0 for no page."""
    return df.groupBy(*(by or [])).agg(*[F.coalesce(F.avg(F.coalesce(F.col(p), F.lit(0.0))), F.lit(0.0)).alias(p) for p in parts])


def ledger_json(df: DataFrame) -> Column:
    """The ledger of a page (from with_ledger) as JSON: parts, sums, shares and conservation; shares are null for no time."""
    part = lambda p: F.coalesce(F.col(p).cast("double"), F.lit(0.0))
    total = part("total")
    share = lambda v: F.when(total > 0, F.try_divide(v, total))
    residual, tolerance = F.col("attributed") - total, F.greatest(F.lit(1.6e-5), F.abs(total) * 1e-6)
    sums = {"attributed_ms": F.col("attributed"), "input_ms": F.col("input"), "inference_ms": F.col("inference"), "rust_ms": F.col("rust")}
    shares = F.struct(share(F.col("inference")).alias("inference"), share(F.col("rust")).alias("rust"), share(part("formula")).alias("formula"), share(F.greatest(-residual, F.lit(0.0))).alias("unattributed"))
    kept = F.struct(residual.alias("residual_ms"), tolerance.alias("tolerance_ms"), (F.abs(residual) <= tolerance).alias("conserved"))
    return F.to_json(F.struct(total.alias("total"), *[part(p).alias(p) for p in PARTS], *[c.alias(n) for n, c in sums.items()], F.when(total > 0, shares).alias("shares"), kept.alias("conservation")))


def matches_baselines(rows: DataFrame, baselines: DataFrame, *, by: list[str], position: str, tokens: str) -> DataFrame:
    """by, matches: is each row of a batch, at its position, the baseline at that position modulo their number? No baseline is no match.

    baselines: at (from 0), tokens; their number is counted once, and rows meet them by an equi-join.
    """
    n = baselines.agg(F.count(F.lit(1)).alias("n")).scalar()
    wanted = baselines.select(F.col("at").cast("long").alias("its at"), F.col(tokens).alias("its tokens"))
    met = rows.join(wanted, F.when(n > 0, F.pmod(F.col(position), n)) == F.col("its at"), "left")
    return met.groupBy(*by).agg(F.bool_and(F.coalesce(F.col(tokens) == F.col("its tokens"), F.lit(False))).alias("matches"))
