"""Evaluation: scoring, summaries, comparison of runs, shards, samples and their manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions import text as X

US, RS = "\x1f", "\x1e"


def score_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (expected, actual, truncated) with exact, normalized, distance, cer and failure. The distance, which costs most, is computed once."""
    e, a = F.col("expected"), F.col("actual")
    scored = pairs.withColumn("distance", F.levenshtein(e, a).cast("long"))
    return scored.select(
        *pairs.columns,
        (e == a).alias("exact"),
        (X.strip_whitespace(e) == X.strip_whitespace(a)).alias("normalized"),
        "distance",
        X.rate_of(F.col("distance"), e, a).alias("cer"),
        X.failure_kind(e, a, F.col("truncated")).alias("failure"),
    )


def summarize(records: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Counts, rates and the mean error rate (and `more` aggregates) of records (failure, exact, normalized, cer, truncated); what has no truth or failed before the model isn't scored. No record gives 0, not null."""
    scored = ~(F.col("failure") == "empty_ground_truth") & ~X.is_pipeline_failure(F.col("failure"))
    rate = lambda c, n: F.coalesce(F.try_divide(F.count_if(c & scored), F.count_if(scored)), F.lit(0.0)).alias(n)
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(scored).alias("scored"),
        F.count_if(X.is_pipeline_failure(F.col("failure"))).alias("pipeline_failures"),
        F.count_if(F.col("failure") == "model_mismatch").alias("model_mismatches"),
        F.count_if(F.coalesce(F.col("truncated"), F.lit(False))).alias("truncated"),
        F.count_if(F.col("exact") & scored).alias("exact_matches"),
        F.count_if(F.col("normalized") & scored).alias("normalized_matches"),
        rate(F.col("exact"), "exact_match_rate"),
        rate(F.col("normalized"), "normalized_match_rate"),
        F.coalesce(F.avg(F.when(scored, F.col("cer"))), F.lit(0.0)).alias("mean_cer"),
        *more,
    )


def failure_counts(records: DataFrame, by: list[str]) -> DataFrame:
    return records.groupBy(*by, "failure").agg(F.count(F.lit(1)).alias("n"))


def page_summary(cases: DataFrame, by: list[str]) -> DataFrame:
    """Means over pages: error rate and exact rate 0 for no page, the others null where no page has them."""
    return cases.groupBy(*by).agg(
        F.coalesce(F.avg("cer"), F.lit(0.0)).alias("mean_cer"),
        F.coalesce(F.avg(F.col("exact").cast("int")), F.lit(0.0)).alias("exact_match_rate"),
        F.avg("precision").alias("mean_precision"),
        F.avg("recall").alias("mean_recall"),
        F.avg("iou").alias("mean_iou"),
    )


def detection_metrics(expected: DataFrame, predicted: DataFrame, matches: DataFrame, *, page: str) -> DataFrame:
    """page, recall (null without expected boxes), precision (null also without predicted ones), iou (null without a match)."""
    e, p = expected.groupBy(page).agg(F.count(F.lit(1)).alias("n_e")), predicted.groupBy(page).agg(F.count(F.lit(1)).alias("n_p"))
    m = matches.groupBy(page).agg(F.count(F.lit(1)).alias("n_m"), F.avg("iou").alias("iou"))
    out = e.join(p, page, "full").join(m, page, "left")
    found = F.coalesce("n_m", F.lit(0))
    return out.select(page, F.when(F.col("n_e") > 0, found / F.col("n_e")).alias("recall"), F.when((F.col("n_e") > 0) & (F.col("n_p") > 0), found / F.col("n_p")).alias("precision"), "iou")


def compare_runs(run: DataFrame, reference: DataFrame, *, key: str, fields: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(each record of the run with found, same and the differing fields; keys that only the reference has). Of repeated reference keys the last by `order` counts."""
    last = reference.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("ref"))
    out = run.join(last, key, "left")
    differing = F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"ref.{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    found = F.col("ref").isNotNull()
    compared = out.select(key, found.alias("found"), F.when(found, F.size(differing) == 0).alias("same"), F.when(found, F.array_join(differing, ",")).alias("differing"))
    return compared, last.select(key).join(run.select(key).distinct(), key, "left_anti")


def merge_comparisons(shards: DataFrame, total: Column) -> DataFrame:
    """Sums of partial comparisons (compared, same, different); what is missing is the total less what was compared, not below 0."""
    return shards.agg(F.sum("compared").alias("compared"), F.sum("same").alias("same"), F.sum("different").alias("different"), F.greatest(total - F.sum("compared"), F.lit(0)).alias("missing"))


def shard_problems(shards: DataFrame, manifest: DataFrame, *, key: str) -> DataFrame:
    """key, problem: keys that come more than once, that the manifest lacks, and that no shard has."""
    n = shards.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    joined = n.join(manifest.select(key, F.lit(True).alias("listed")), key, "full")
    problem = F.when(F.col("listed").isNull(), "unknown").when(F.col("n").isNull(), "gap").when(F.col("n") > 1, "duplicate")
    return joined.select(key, problem.alias("problem")).where("problem is not null")


def merge_shards(shards: DataFrame, manifest: DataFrame, *, key: str) -> DataFrame:
    """The shards' records with the manifest's `position`; raises for a key that is repeated, unknown or missing."""
    bad = shard_problems(shards, manifest, key=key).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['problem']}: {bad[0][key]}")
    return shards.join(manifest.select(key, "position"), key)


def shard_of(position: Column, count: int) -> Column:
    return F.pmod(position, F.lit(count)).cast("int")


# --- samples


def sample_key(path: Column, truth: Column) -> Column:
    return F.sha2(F.concat(path, F.lit(US), truth).cast("binary"), 256)


def hash_sample(samples: DataFrame, limit: int) -> DataFrame:
    """The first `limit` samples (path, truth) by the hash of both; 0 keeps all. A top-k, so no full sort."""
    keyed = samples.withColumn("sample_key", sample_key(F.col("path"), F.col("truth"))).orderBy("sample_key", "path")
    return keyed.limit(limit) if limit else keyed


def manifest_digests(samples: DataFrame, by: list[str], *, dataset: str, split: str, subset: str, strategy: str, limit: int, position: str) -> DataFrame:
    """Counts and digests of samples (path, truth): manifest_sha256 follows `position`, sample_set_sha256 the paths.

    A manifest is one document, so each group's entries meet: a path and a digest of fixed length each.
    """
    head = US.join([dataset, split, subset, strategy, str(limit)])
    entry = F.struct(F.col(position).alias("at"), F.col("path"), F.sha2(F.col("truth").cast("binary"), 256).alias("digest"))
    grouped = samples.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.count(F.lit(1)).alias("entry_count"), F.count_if(~X.is_blank(F.col("truth"))).alias("scored_count"))
    line = lambda e: F.concat(F.lit(RS), e["path"], F.lit(US), e["digest"])
    whole = lambda entries: F.sha2(F.concat(F.lit(head), F.array_join(F.transform(entries, line), "")).cast("binary"), 256)
    by_path = F.array_sort(F.transform("entries", lambda e: F.struct(e["path"].alias("path"), e["digest"].alias("digest"))))
    return grouped.select(*by, "entry_count", "scored_count", whole(F.col("entries")).alias("manifest_sha256"), whole(by_path).alias("sample_set_sha256"))


def manifest_tree(samples: DataFrame, by: list[str], *, position: str, width: int = 4096, levels: int = 4) -> DataFrame:
    """by, tree_sha256: a digest of digests of samples (path, truth), for sets too large to be one document.

    Entries with one position // width make a node, nodes a node of the next level, and what is left after `levels` is
    joined; a node is the digest of its children's in order. No task holds more than `width` digests, but for the last.
    """
    entry = F.sha2(F.concat("path", F.lit(US), F.sha2(F.col("truth").cast("binary"), 256)).cast("binary"), 256)
    nodes = samples.select(*by, F.col(position).cast("long").alias("i"), entry.alias("h"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), "").cast("binary"), 256)
    for _ in range(levels):
        nodes = nodes.groupBy(*by, F.floor(F.col("i") / width).alias("up")).agg(joined.alias("h")).withColumnRenamed("up", "i")
    return nodes.groupBy(*by).agg(joined.alias("tree_sha256"))
