"""Deterministic views of the supplied tables in the shapes that page data have, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of pages: page, rid (from 1, by all columns, since lines repeat), x0..y1, score, class_id, text."""
    rid = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER))
    x0, y0 = F.pmod("l_partkey", F.lit(40)).cast("double"), F.pmod("l_suppkey", F.lit(40)).cast("double")
    rows = table(spark, sf_dir, "lineitem").select(*LINE_ORDER, "l_orderkey", rid.cast("long").alias("rid"), x0.alias("x0"), y0.alias("y0"))
    return rows.select(
        F.col("l_orderkey").alias("page"), "rid", "x0", "y0",
        (F.col("x0") + F.col("l_quantity")).alias("x1"),
        (F.col("y0") + 10 + F.col("l_quantity") / 2).alias("y1"),
        F.col("l_discount").alias("score"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("class_id"),
        F.concat("l_returnflag", "l_linestatus").alias("text"),
    )


REGIONS = f"""regions AS (
  SELECT page, rid, x0, y0, x0 + q AS x1, y0 + 10 + q / 2 AS y1, score, class_id, text FROM (
    SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS rid,
      CAST(l_partkey % 40 AS DOUBLE) AS x0, CAST(l_suppkey % 40 AS DOUBLE) AS y0, l_quantity AS q, l_discount AS score,
      CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class_id, l_returnflag || l_linestatus AS text
    FROM lineitem))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text pairs: each turn of a conversation, and that with a and e, o and ö swapped (but for each third), cut in half for each seventh."""
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair"), "role", text.alias("expected"))
    swapped = F.when(F.col("pair") % 3 == 0, F.col("expected")).otherwise(F.translate("expected", "aeoö", "eaöo"))
    cut = F.col("pair") % 7 == 0
    half = F.substr(swapped, F.lit(1), F.floor(F.char_length("expected") / 2).cast("int"))
    return rows.select("pair", "role", "expected", F.when(cut, half).otherwise(swapped).alias("actual"), cut.alias("truncated"))


PAIRS = r"""p0 AS (
  SELECT conv_id * 1000 + turn AS pair, role, coalesce(text, '') AS expected FROM conversations
), p1 AS (
  SELECT *, CASE WHEN pair % 3 = 0 THEN expected ELSE translate(expected, 'aeoö', 'eaöo') END AS swapped FROM p0
), pairs AS (
  SELECT pair, role, expected, CASE WHEN pair % 7 = 0 THEN substr(swapped, 1, length(expected) // 2) ELSE swapped END AS actual, pair % 7 = 0 AS truncated FROM p1
)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pagelore.operators.evaluate import score_pairs

    # an edit distance costs the square of its length, far more than to move a row: deal the rows out, however few files hold them
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return score_pairs(pairs(spark, sf_dir).repartition(tasks, "pair"))


#: DuckDB's edit distance counts bytes: each character of a pair is written as one byte, its number among the pair's characters.
CODED = """(SELECT array_to_string(list_transform(string_split({x}, ''), lambda c: chr(CAST(list_position(letters, c) AS INTEGER))), ''))"""
DISTANCE = "CAST(levenshtein(" + CODED.format(x="{e}") + ", " + CODED.format(x="{a}") + ") AS BIGINT)"
LETTERS = "list_distinct(string_split({e} || {a}, '')) AS letters"
RECORDS = (
    PAIRS
    + r""", lt AS (SELECT *, """ + LETTERS.format(e="expected", a="actual") + r""" FROM pairs), m AS (
  SELECT *, expected = actual AS exact, regexp_replace(expected, '\s', '', 'g') = regexp_replace(actual, '\s', '', 'g') AS normalized,
    """ + DISTANCE.format(e="expected", a="actual") + r""" AS distance FROM lt
), records AS (
  SELECT *, CASE WHEN length(expected) = 0 THEN CASE WHEN length(actual) = 0 THEN 0.0 ELSE 1.0 END ELSE CAST(distance AS DOUBLE) / length(expected) END AS cer,
    CASE WHEN regexp_replace(expected, '\s', '', 'g') = '' THEN 'empty_ground_truth' WHEN exact THEN 'none' WHEN truncated THEN 'truncated_no_eos' ELSE 'model_mismatch' END AS failure
  FROM m
)"""
)

EVENT_CODES = ("click", "error", "purchase", "signup", "view")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of lines: line, ts, event_id, token (0 is the blank), prob, letter; one line a user."""
    token = F.array_position(F.array(*map(F.lit, EVENT_CODES)), F.col("event_type")) - 1
    rows = table(spark, sf_dir, "events").withColumn("token", token.cast("int"))
    return rows.select(F.col("user_id").alias("line"), "ts", "event_id", "token", (F.floor(F.abs("value") * 100) % 100 / 100).alias("prob"), F.chr(F.col("token") + 96).alias("letter"))


FRAMES = f"""frames AS (
  SELECT user_id AS line, ts, event_id, token, floor(abs(value) * 100) % 100 / 100 AS prob, chr(token + 96) AS letter
  FROM (SELECT *, CAST(list_position({list(EVENT_CODES)}, event_type) - 1 AS INTEGER) AS token FROM events)
)"""


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timings of pages: one page a user and day; a stage's time is what its kind of event adds up to. Sums of whole numbers, so that they are exact."""
    from pagelore.functions.stats import TIMINGS

    rows = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.floor(F.abs("value") * 10).cast("long").alias("v"), F.pmod("event_id", F.lit(len(TIMINGS) - 1)).cast("int").alias("k"))
    sums = [F.sum(F.when(F.col("k") == i, F.col("v"))).cast("double").alias(t) for i, t in enumerate(TIMINGS[1:])]
    pages = rows.groupBy("user_id", "day").agg(*sums)
    return pages.withColumn("total", sum((F.coalesce(t, F.lit(0.0)) for t in TIMINGS[2:]), F.lit(1.0)))


def timings_sql() -> str:
    from pagelore.functions.stats import TIMINGS

    names = TIMINGS[1:]
    sums = ", ".join(f"CAST(sum(CASE WHEN k = {i} THEN v END) AS DOUBLE) AS {t}" for i, t in enumerate(names))
    total = " + ".join(["1.0", *(f"coalesce({t}, 0)" for t in names[1:])])
    return f"""t0 AS (
  SELECT user_id, CAST(ts AS DATE) AS day, CAST(floor(abs(value) * 10) AS BIGINT) AS v, event_id % {len(names)} AS k FROM events
), t1 AS (SELECT user_id, day, {sums} FROM t0 GROUP BY user_id, day), timings AS (SELECT *, {total} AS total FROM t1)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("truth"))


SAMPLES = "samples AS (SELECT doc_id, lang, source || '/' || lang || '/' || doc_id AS path, coalesce(text, '') AS truth FROM documents)"


def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model files: a set a brand, a role by the part's size, some without size or digest, some missing or corrupt."""
    from pagelore.operators.registry import ROLES

    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("model_set"),
        F.concat(F.lit("file_"), F.pmod(k, F.lit(97)).cast("string")).alias("name"),
        F.element_at(F.array(*map(F.lit, ROLES)), (F.pmod(F.col("p_size"), F.lit(len(ROLES))) + 1).cast("int")).alias("role"),
        F.when(k % 11 != 0, (k * 10).cast("long")).alias("size"),
        F.when(k % 5 != 0, F.sha2(k.cast("string").cast("binary"), 256)).otherwise("").alias("sha256"),
        F.when(k % 7 == 0, "missing").when(k % 13 == 0, "corrupt").otherwise("present").alias("state"),
    )


MODEL_FILES = """model_files AS (
  SELECT p_brand AS model_set, 'file_' || (p_partkey % 97) AS name,
    ['detector', 'classifier', 'recognizer', 'dictionary', 'formula_recognizer', 'formula_tokenizer', 'formula_detector'][p_size % 7 + 1] AS role,
    CASE WHEN p_partkey % 11 <> 0 THEN p_partkey * 10 END AS size,
    CASE WHEN p_partkey % 5 <> 0 THEN sha256(CAST(p_partkey AS VARCHAR)) ELSE '' END AS sha256,
    CASE WHEN p_partkey % 7 = 0 THEN 'missing' WHEN p_partkey % 13 = 0 THEN 'corrupt' ELSE 'present' END AS state
  FROM part)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of services: a service a user, finished ones by kind of event, sizes by value."""
    ms = F.unix_millis(F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp"))  # the same in any time zone
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.col("event_id").alias("seq"), ms.alias("queued"),
        F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").when(F.col("event_id") % 3 == 0, "failed").otherwise("succeeded").alias("state"),
        F.when(~F.col("event_type").isin("view", "click"), ms + F.col("event_id") % 1000).alias("finished"),
        (F.col("event_id") % 50 * 10).alias("original_bytes"), (F.col("event_id") % 7).alias("result_bytes"),
        F.when(F.col("event_id") % 4 == 0, "formula").otherwise("text").alias("kind"),
    )


JOBS = """jobs AS (
  SELECT user_id AS owner, event_id AS id, event_id AS seq, epoch_us(ts) // 1000 AS queued,
    CASE WHEN event_type = 'view' THEN 'queued' WHEN event_type = 'click' THEN 'running' WHEN event_id % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS state,
    CASE WHEN event_type NOT IN ('view', 'click') THEN epoch_us(ts) // 1000 + event_id % 1000 END AS finished,
    event_id % 50 * 10 AS original_bytes, event_id % 7 AS result_bytes, CASE WHEN event_id % 4 = 0 THEN 'formula' ELSE 'text' END AS kind
  FROM events)"""
