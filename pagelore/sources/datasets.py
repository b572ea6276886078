"""Labelled datasets, evaluation cases, manifests and report files as DataFrames.

A label file's lines are addressed by number. Files are small beside the images, but a line number is a property of the
whole file, so each is read as one row and split there, by an executor; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.functions import text as X


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0), line: lines of a file, blank ones too, without their ends."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "line")).select(F.col("line_no").cast("long"), F.regexp_replace("line", "\r+$", "").alias("line"))


def is_safe_path(path: Column) -> Column:
    """A relative path without empty, . or .. parts."""
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~F.regexp_like(path, F.lit(r"(^|/)(\.{1,2})?(/|$)")) & ~F.contains(path, F.lit("\\"))


def samples(rows: DataFrame, dataset: str, split: str) -> DataFrame:
    """relative_path, ground_truth, source_index, dataset, split, has_ground_truth; a path that leaves the root raises an error."""
    checked = F.when(is_safe_path(F.col("relative_path")), F.col("relative_path")).otherwise(F.raise_error(F.concat(F.lit("bad path: "), F.col("relative_path"))))
    return rows.select(checked.alias("relative_path"), "ground_truth", F.col("source_index").cast("long"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), (~X.is_blank(F.col("ground_truth"))).alias("has_ground_truth"))


def load_indexed_labels(spark: SparkSession, filter_path: str, labels_path: str, *, dataset: str, split: str) -> DataFrame:
    """A list of `name index` lines, whose index is a line of the label file. An index beyond it raises an error."""
    lines = numbered_lines(spark, filter_path).where(~X.is_blank(F.col("line"))).select(F.trim("line").alias("line"))
    part = lambda k: F.regexp_extract("line", r"^(.*\S)\s+(\d+)$", k)
    good = F.when(part(2) != "", part(2)).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col("line"))))
    wanted = lines.select(part(1).alias("relative_path"), good.cast("long").alias("source_index"))
    labels = numbered_lines(spark, labels_path).withColumnsRenamed({"line_no": "source_index", "line": "ground_truth"}).withColumn("there", F.lit(True))
    joined = wanted.join(labels, "source_index", "left")
    truth = F.when(F.col("there"), F.col("ground_truth")).otherwise(F.raise_error(F.concat(F.lit("no such label: "), F.col("source_index").cast("string"))))
    return samples(joined.withColumn("ground_truth", truth), dataset, split)


def load_tab_separated(spark: SparkSession, path: str, *, dataset: str, split: str) -> DataFrame:
    """Lines `path TAB latex`; blank ones are skipped, but counted."""
    parts = F.split("line", "\t")
    rows = numbered_lines(spark, path).where(~X.is_blank(F.col("line"))).select(F.trim(parts[0]).alias("relative_path"), F.trim(F.try_element_at(parts, F.lit(2))).alias("ground_truth"), F.col("line_no").alias("source_index"))
    truth = F.coalesce("ground_truth", F.raise_error(F.lit("a line has no label")))
    return samples(rows.withColumn("ground_truth", truth), dataset, split)


def load_numbered_images(spark: SparkSession, folder: str, labels_path: str, *, dataset: str) -> DataFrame:
    """Images <n>.png, whose label is line n of the label file, in order of n."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select("path")
    numbers = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("relative_path"), F.regexp_extract("path", r"([0-9]+)\.png$", 1).try_cast("long").alias("source_index"))
    labels = numbered_lines(spark, labels_path).withColumnsRenamed({"line_no": "source_index", "line": "ground_truth"})
    joined = numbers.join(labels, "source_index", "left")
    truth = F.coalesce("ground_truth", F.raise_error(F.concat(F.lit("no label for "), F.col("relative_path"))))
    return samples(joined.withColumn("ground_truth", truth), dataset, "test").orderBy("source_index")


CASES = "image string, text string, boxes array<array<array<double>>>"


def load_cases(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """Evaluation cases of a JSON array; none, or more than the limit, is an error."""
    cases = spark.read.schema(CASES).option("multiLine", True).option("mode", "FAILFAST").json(path)
    n = cases.limit(limit + 1).count()
    if not 0 < n <= limit:
        raise ValueError("there must be cases, and no more than the limit")
    return cases.withColumn("boxes", F.coalesce("boxes", F.array().cast("array<array<array<double>>>")))


MANIFEST = "schema_version int, id string, family string, version string, languages array<string>, files array<struct<name:string,role:string,sha256:string,size_bytes:bigint,source_url:string>>"


def manifest_files(rows: DataFrame) -> DataFrame:
    """id and the files of parsed manifests of version 1; bare names and digests are required."""
    version = F.when(F.col("schema_version") == 1, F.col("id")).otherwise(F.raise_error(F.lit("unknown manifest version")))
    files = rows.select(version.alias("id"), F.explode("files").alias("f")).select("id", "f.*")
    good = X.is_model_file_name(F.col("name")) & X.is_sha256(F.col("sha256"))
    return files.withColumn("name", F.when(good, F.col("name")).otherwise(F.raise_error(F.concat(F.lit("bad file: "), F.coalesce("name", F.lit("none"))))))


def load_model_manifest(spark: SparkSession, path: str) -> DataFrame:
    """manifest_files of the JSON files of a folder."""
    return manifest_files(spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path))


def parse_manifests(rows: DataFrame, column: str) -> DataFrame:
    """manifest_files of manifests that lie in a column as JSON."""
    return manifest_files(rows.select(F.from_json(column, MANIFEST, {"mode": "FAILFAST"}).alias("m")).select("m.*"))


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """index (from 1; 0 is the blank), letter: lines of a character file, trimmed, empty ones left out."""
    lines = numbered_lines(spark, path).select("line_no", F.trim("line").alias("letter")).where("letter <> ''")
    kept = lines.agg(F.array_sort(F.collect_list(F.struct("line_no", "letter"))).alias("ls"))  # one dictionary
    return kept.select(F.posexplode("ls").alias("at", "l")).select((F.col("at") + 1).alias("index"), "l.letter")


#: The special tokens and the ids that they must have.
SPECIAL_TOKENS = {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3}


def tokenizer_metadata(metadata: DataFrame, column: str) -> DataFrame:
    """vocab_size, the special ids and whether they are as they must be, from a JSON column with a tokenizer's file."""
    shape = "fast_tokenizer_file struct<model:struct<vocab:map<string,bigint>>,added_tokens:array<struct<id:bigint,content:string>>>"
    parsed = metadata.withColumn("m", F.from_json(column, shape))
    vocab, added = F.col("m.fast_tokenizer_file.model.vocab"), F.col("m.fast_tokenizer_file.added_tokens")
    ident = lambda token: F.coalesce(F.try_element_at(F.filter(added, lambda a: a["content"] == token), F.lit(1))["id"], F.try_element_at(vocab, F.lit(token)))
    ids = {t: ident(t) for t in SPECIAL_TOKENS}
    valid = F.coalesce(F.size(vocab) > 0, F.lit(False))
    for token, want in SPECIAL_TOKENS.items():
        valid = valid & F.coalesce(ids[token] == want, F.lit(False))
    return parsed.select(*metadata.columns, F.coalesce(F.size(vocab), F.lit(0)).alias("vocab_size"), *[c.alias(n) for c, n in zip(ids.values(), ("bos_id", "pad_id", "eos_id", "unk_id"), strict=True)], valid.alias("valid"))


def decode_tokens(rows: DataFrame, tokens: str, vocab: Column) -> DataFrame:
    """rows with text, eos_index, truncated: the words of a map id -> piece up to the end mark, specials left out; an id beyond the vocabulary raises an error."""
    from pagelore.operators.order import eos_prefix

    special = F.array(*[F.lit(i).cast("long") for i in SPECIAL_TOKENS.values()])
    piece = lambda t: F.coalesce(F.try_element_at(vocab, t), F.raise_error(F.concat(F.lit("token out of range: "), t.cast("string"))))
    out = rows.withColumn("e", eos_prefix(F.col(tokens)))
    words = F.transform(F.filter("e.prefix", lambda t: ~F.array_contains(special, t)), piece)
    return out.select(*rows.columns, F.trim(F.replace(F.array_join(words, ""), F.lit("Ġ"), F.lit(" "))).alias("text"), "e.eos_index", "e.truncated")


def flatten_reports(reports: DataFrame) -> DataFrame:
    """One row a nested evaluation report: its dataset, split and the figures of its summary."""
    s = "summary."
    return reports.select("dataset", "split", *[F.col(s + c).alias(c) for c in ("total", "scored", "exact_match_rate", "normalized_match_rate", "mean_cer")])


def failed_records(records: DataFrame) -> DataFrame:
    return records.where("failure <> 'none'")


def markdown_table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row, `table`: the rows as a Markdown table."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.agg(F.concat(F.lit(head), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("table"))


def baseline_payload(evaluations: DataFrame, manifests: DataFrame, comparisons: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """section, place, entry: what a committed baseline is made of, one JSON object an entry, each section in its own order.

    evaluations by dataset and split; manifests by dataset, limit and entry_count; comparisons without their links, whose
    number they keep; benchmarks by source.
    """
    entry = lambda df: F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    slim = comparisons.withColumn("link_differences", F.coalesce(F.size("link_differences"), F.lit(0)))
    parts = {"evaluations": (evaluations, ["dataset", "split"]), "dataset_manifests": (manifests, ["dataset", "limit", "entry_count"]), "reference_comparison": (slim, ["dataset"]), "benchmarks": (benchmarks, ["source"])}
    out = None
    for name, (df, order) in parts.items():
        place = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order)) - 1
        rows = df.select(F.lit(name).alias("section"), place.alias("place"), entry(df).alias("entry"))
        out = rows if out is None else out.unionByName(rows)
    return out
