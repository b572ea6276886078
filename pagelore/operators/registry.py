"""Model files, sets and the registry that names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions import text as X

#: Roles in their canonical order, and the pipeline that each belongs to.
ROLES = ("detector", "classifier", "recognizer", "dictionary", "formula_recognizer", "formula_tokenizer", "formula_detector")


def pipeline_of(role: Column) -> Column:
    return F.when(F.startswith(role, F.lit("formula")), "formula").otherwise("text")


def file_state(exists: Column, expected_size: Column, size: Column, expected_digest: Column, digest: Column) -> Column:
    """missing, corrupt or present; a size or digest that isn't declared is not compared."""
    wrong = F.coalesce(expected_size != size, F.lit(False)) | F.coalesce((F.trim(expected_digest) != "") & (F.lower(expected_digest) != F.lower(digest)), F.lit(False))
    return F.when(~exists, "missing").when(wrong, "corrupt").otherwise("present")


def missing_bytes(files: DataFrame, by: list[str]) -> DataFrame:
    """Bytes that the missing files need; null if any of them has no size."""
    gone = F.col("state") == "missing"
    unknown = F.count_if(gone & F.col("size").isNull()) > 0
    return files.groupBy(*by).agg(F.when(~unknown, F.coalesce(F.sum(F.when(gone, F.col("size"))), F.lit(0))).alias("missing_bytes"))


def set_status(files: DataFrame, by: list[str]) -> DataFrame:
    """n, present, hashed, complete: a set is complete if it has files, all present and with a digest."""
    has_hash = F.coalesce(F.trim("sha256") != "", F.lit(False))
    good = (F.col("state") == "present") & has_hash
    return files.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "present").alias("present"), F.count_if(has_hash).alias("hashed"), (F.count_if(~good) == 0).alias("complete"))


def declared_roles(files: DataFrame, by: list[str]) -> DataFrame:
    found = files.groupBy(*by).agg(F.collect_set("role").alias("roles"))
    return found.select(*by, F.array_join(F.array_intersect(F.array(*map(F.lit, ROLES)), F.col("roles")), ",").alias("roles"))


def missing_roles(files: DataFrame, sets: DataFrame, required: tuple[str, ...], key: str) -> DataFrame:
    """key, role: required roles that a set doesn't declare."""
    wanted = sets.select(key, F.explode(F.array(*map(F.lit, required))).alias("role"))
    return wanted.join(files.select(key, "role").distinct(), [key, "role"], "left_anti")


def duplicate_names(files: DataFrame, by: list[str]) -> DataFrame:
    return files.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def resolve(requests: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """requests with model and outcome: found, missing or ambiguous. Candidates are counted before they are joined."""
    candidates = registry.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("model").alias("model"))
    out = requests.join(candidates, keys, "left")
    outcome = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return out.select(*requests.columns, F.when(outcome == "found", F.col("model")).alias("model"), outcome.alias("outcome"))


def blocking_files(files: DataFrame, pipeline: str) -> DataFrame:
    return files.where((pipeline_of(F.col("role")) == pipeline) & (F.col("state") != "present"))


def partial_digest(content: Column, part: int = 65536) -> Column:
    """struct<head,tail>: digests of the first and last bytes."""
    n = F.octet_length(content)
    return F.struct(F.sha2(F.substring(content, 1, part), 256).alias("head"), F.sha2(F.when(n > part, F.substring(content, -part, part)).otherwise(content), 256).alias("tail"))


def looks_like_model(content: Column) -> Column:
    """Does the file begin with field 1 as a varint of 1 to 64?"""
    first, second = F.hex(F.substring(content, 1, 1)), F.conv(F.hex(F.substring(content, 2, 1)), 16, 10).cast("int")
    return (first == "08") & second.between(1, 64)


# --- the registry as a table: task, version, lang, model_type, model, url, sha256, size_bytes, and dict_url, dict_sha256, dict_size_bytes of a recogniser

REGISTRY = "task string, version string, lang string, model_type string, model string, url string, sha256 string, size_bytes bigint, dict_url string, dict_sha256 string, dict_size_bytes bigint"


def registry_rows(tree: dict) -> list[tuple]:
    """Rows of REGISTRY from a nested registry: version -> task -> model -> its entry. An entry without an address is an error."""
    out = []
    for version, tasks in tree.items():
        for task, models in tasks.items():
            for model, entry in models.items():
                if not entry.get("model_url"):
                    raise ValueError(f"{version}/{task}/{model} has no address")
                own, book = model.partition("_")[0], entry.get("dictionary") or {}
                size = next((t for t in ("tiny", "small", "medium", "server") if t in model.lower()), "mobile")
                out.append((task, version, own, size, model, entry["model_url"], entry.get("sha256"), entry.get("size_bytes"), book.get("url"), book.get("sha256"), book.get("size_bytes")))
    return out


def load_registry(spark: SparkSession, text: str) -> DataFrame:
    """A registry written in YAML (JSON is YAML too) as a table. YAML needs its library; without it the text must be JSON."""
    try:
        import yaml

        tree = yaml.safe_load(text)
    except ImportError:
        import json

        tree = json.loads(text)
    return spark.createDataFrame(registry_rows(tree), REGISTRY)


#: What models of the sixth version there are: tasks, sizes, languages by size, and how a model is named.
V6_TASKS, V6_SIZES = ("det", "rec"), ("tiny", "small", "medium")
V6_LANGUAGES = {"tiny": ("ch", "chinese_cht", "en"), "small": ("ch", "chinese_cht", "en", "japan"), "medium": ("ch", "chinese_cht", "en", "japan")}
V6_NAME = "multi_PP-OCRv6_{task}_{size}"


def v6_supported(task: Column, lang: Column, size: Column) -> Column:
    """null if such a model may be asked for, else what is wrong: task, size or language."""
    known = F.lit(False)
    for name, langs in V6_LANGUAGES.items():
        known = known | ((size == name) & lang.isin(*langs))
    return F.when(~task.isin(*V6_TASKS), "task").when(~size.isin(*V6_SIZES), "size").when(~(known | ((task == "det") & (lang == "multi"))), "language")


def select_v6(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """requests (task, lang, size) with model and outcome: found, missing from the registry, or what v6_supported finds wrong."""
    before, between = V6_NAME.split("{task}")[0], V6_NAME.split("{task}")[1].split("{size}")[0]
    wrong = v6_supported(F.col("task"), F.col("lang"), F.col("size"))
    asked = requests.withColumns({"wrong": wrong, "key": F.when(wrong.isNull(), F.concat(F.lit(before), F.col("task"), F.lit(between), F.col("size")))})
    listed = registry.select(F.col("model").alias("listed")).distinct()
    out = asked.join(listed, asked["key"] == listed["listed"], "left")
    return out.select(*requests.columns, F.col("listed").alias("model"), F.coalesce("wrong", F.when(F.col("listed").isNull(), "missing").otherwise("found")).alias("outcome"))


def language_tag_matches(model: Column, lang: Column) -> Column:
    return F.coalesce(X.language_tag(model) == lang, F.lit(False))


def url_name(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"([^/?#]+)(?:[?#].*)?$", 1), F.lit(""))


def text_model_sets(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """request, set_id, problem, place, role, name, sha256, size_bytes: the files of each request's text models.

    requests: request, version, model_type, det_lang, cls_lang, rec_lang, with_classifier. A detector, a classifier if asked for, a
    recogniser and its dictionary if it has one, in that order. Where a model is missing or ambiguous, the request has one row
    that names the first such task, and no file.
    """
    task = lambda name, lang, role, place: F.struct(F.lit(name).alias("task"), F.col(lang).alias("lang"), F.lit(role).alias("role"), F.lit(place).alias("place"))
    tasks = F.filter(F.array(task("det", "det_lang", "detector", 0), task("cls", "cls_lang", "classifier", 1), task("rec", "rec_lang", "recognizer", 2)), lambda t: (t["role"] != "classifier") | F.col("with_classifier"))
    wanted = requests.select("request", "version", "model_type", F.concat_ws("-", "version", "model_type", "rec_lang").alias("set_id"), F.explode(tasks).alias("t")).select("request", "version", "model_type", "set_id", "t.*")
    keys = ["task", "version", "lang", "model_type"]
    candidates = registry.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("url", "sha256", "size_bytes", "dict_url", "dict_sha256", "dict_size_bytes")).alias("m"))
    met = wanted.join(candidates, keys, "left")
    wrong = F.when(F.col("n").isNull(), F.concat(F.col("task"), F.lit(": missing"))).when(F.col("n") > 1, F.concat(F.col("task"), F.lit(": ambiguous")))
    model = F.struct(F.col("place").alias("place"), F.col("role").alias("role"), url_name(F.col("m.url")).alias("name"), F.col("m.sha256").alias("sha256"), F.col("m.size_bytes").alias("size_bytes"))
    book = F.struct(F.lit(3).alias("place"), F.lit("dictionary").alias("role"), url_name(F.col("m.dict_url")).alias("name"), F.col("m.dict_sha256").alias("sha256"), F.col("m.dict_size_bytes").alias("size_bytes"))
    files = F.when((F.col("role") == "recognizer") & F.col("m.dict_url").isNotNull(), F.array(model, book)).otherwise(F.array(model))
    sets = met.groupBy("request", "set_id").agg(F.min(F.when(wrong.isNotNull(), F.struct(F.col("place"), wrong.alias("problem"))))["problem"].alias("problem"), F.flatten(F.collect_list(files)).alias("files"))
    shown = F.when(F.col("problem").isNull(), F.col("files"))
    return sets.select("request", "set_id", "problem", F.explode_outer(shown).alias("f")).select("request", "set_id", "problem", "f.*")


def set_problems(files: DataFrame, key: str) -> DataFrame:
    """key, name, problem of a set's files (name, role, sha256): names that are not bare, or come twice; digests that are none; unknown roles."""
    n = F.count(F.lit(1)).over(_same(key, "name"))
    bad = F.when(~F.coalesce(X.is_model_file_name(F.col("name")), F.lit(False)), "name").when(n > 1, "repeated").when((F.coalesce("sha256", F.lit("")) != "") & ~X.is_sha256(F.col("sha256")), "digest").when(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)), "role")
    return files.select(key, "name", bad.alias("problem")).where("problem is not null")


def _same(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def chosen_files(manifest: DataFrame, defaults: DataFrame) -> DataFrame:
    """The manifest's files if it has any, else the registry's own: never some of each. Both have the same columns."""
    there = manifest.agg(F.count(F.lit(1)).alias("n")).scalar() > 0
    return manifest.unionByName(defaults.where(~there))


def reverify(planned: DataFrame, seen: DataFrame) -> DataFrame:
    """name, role, state, sha256, cause of each planned file after reading it anew.

    planned: name, role, expected (a digest; empty if none is declared); seen: name, readable, content, known (the digest held
    before). A file that isn't there is missing; one that can't be read, that has another digest, or that has none declared and
    doesn't begin like a model, is corrupt. The cause says whether the digest is new, as before, or has changed.
    """
    met = planned.join(seen.withColumn("there", F.lit(True)), "name", "left")
    digest = F.when(F.col("readable"), F.sha2("content", 256))
    declared = F.trim(F.coalesce("expected", F.lit(""))) != ""
    good = F.when(declared, F.lower("expected") == digest).otherwise(looks_like_model(F.col("content")))
    state = F.when(F.col("there").isNull(), "missing").when(F.coalesce(good, F.lit(False)), "present").otherwise("corrupt")
    cause = F.when(digest.isNull() | F.col("known").isNull(), "first_sight").when(F.col("known") == digest, "hit").otherwise("content_changed")
    return met.select("name", "role", state.alias("state"), digest.alias("sha256"), cause.alias("cause"))


def undeclared_failure(content: Column) -> Column:
    """Why a file without a declared digest can't be a model; null if it can."""
    return F.when(F.octet_length(content) < 2, "too short").when(~looks_like_model(content), F.concat(F.lit("begins with "), F.lower(F.hex(F.substring(content, 1, 2)))))


def downloads(files: DataFrame, *, by: str, at: str, total: int, hosts: tuple[str, ...]) -> DataFrame:
    """The files (state, sha256, url, name, size_bytes) with action: keep, fetch, or why a download stops; what follows a stop is not reached.

    In order of `at`: present files are kept; the others need a digest, an address that may be used and ends in the file's
    name, and room in the bytes that are left.
    """
    from pyspark.sql import Window

    line = Window.partitionBy(by).orderBy(at)
    need = F.coalesce(F.col("state") != "present", F.lit(True))
    spent = F.coalesce(F.sum(F.when(need, F.coalesce("size_bytes", F.lit(0)))).over(line), F.lit(0))
    refusal = X.download_refusal(F.col("url"), hosts)
    stop = (
        F.when(F.trim(F.coalesce("sha256", F.lit(""))) == "", "no digest").when(~need, None).when(F.trim(F.coalesce("url", F.lit(""))) == "", "no address")
        .when(~F.coalesce(url_name(F.col("url")) == F.col("name"), F.lit(False)), "other name").when(refusal.isNotNull(), refusal).when(spent > total, "too large")
    )
    rows = files.withColumn("stop", stop)
    stopped = F.coalesce(F.max(F.col("stop").isNotNull()).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return rows.withColumn("action", F.when(stopped, "not reached").when(F.col("stop").isNotNull(), F.col("stop")).when(need, "fetch").otherwise("keep")).drop("stop")
