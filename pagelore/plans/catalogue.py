"""Every query of the library's own operators, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelore.functions import geometry as G
from pagelore.functions import pixels as P
from pagelore.functions import stats as S
from pagelore.functions import text as X
from pagelore.operators import evaluate as E
from pagelore.operators import filters as L
from pagelore.operators import folds as D
from pagelore.operators import order as O
from pagelore.operators import registry as M
from pagelore.operators import render as R
from pagelore.plans import derive as V
from pagelore.session import ship
from pagelore.streaming import jobs as J

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- evaluation


@query(f"WITH {V.RECORDS} SELECT pair, exact, normalized, distance, cer, failure FROM records")
def score_pairs(spark, d):
    return V.records(spark, d).select("pair", "exact", "normalized", "distance", "cer", "failure")


_RATES = """count(*) AS total, count(*) FILTER (WHERE s) AS scored, CAST(0 AS BIGINT) AS pipeline_failures,
  count(*) FILTER (WHERE failure = 'model_mismatch') AS model_mismatches, count(*) FILTER (WHERE truncated) AS truncated,
  count(*) FILTER (WHERE exact AND s) AS exact_matches, count(*) FILTER (WHERE normalized AND s) AS normalized_matches,
  coalesce(CAST(count(*) FILTER (WHERE exact AND s) AS DOUBLE) / nullif(count(*) FILTER (WHERE s), 0), 0) AS exact_match_rate,
  coalesce(CAST(count(*) FILTER (WHERE normalized AND s) AS DOUBLE) / nullif(count(*) FILTER (WHERE s), 0), 0) AS normalized_match_rate"""


@query(f"WITH {V.RECORDS}, r AS (SELECT *, failure <> 'empty_ground_truth' AS s FROM records) SELECT role, {_RATES}, round(coalesce(avg(cer) FILTER (WHERE s), 0), 9) AS mean_cer, round(quantile_cont(cer, 0.5), 9) AS cer_p50, round(quantile_cont(cer, 0.95), 9) AS cer_p95 FROM r GROUP BY role")
def summary_by_role(spark, d):
    records = S.shared(V.records(spark, d), ["role", "failure", "exact", "normalized", "truncated", "cer"])
    out = S.with_quantiles(E.summarize(records, ["role"]), records, ["role"], "cer", {"cer_p50": 0.5, "cer_p95": 0.95})
    return out.withColumns({c: F.round(c, 9) for c in ("mean_cer", "cer_p50", "cer_p95")})


@query(f"WITH {V.RECORDS} SELECT role, failure, count(*) AS n FROM records GROUP BY role, failure")
def failure_counts(spark, d):
    return E.failure_counts(V.records(spark, d), ["role"])


@query(rf"WITH {V.PAIRS}, n AS (SELECT pair, trim(regexp_replace(expected, '\s+', ' ', 'g')) AS e, trim(regexp_replace(actual, '\s+', ' ', 'g')) AS a FROM pairs), c AS (SELECT *, {V.LETTERS.format(e='e', a='a')} FROM n) SELECT pair, CAST(CASE WHEN length(e) = 0 THEN CASE WHEN length(a) = 0 THEN 0.0 ELSE 1.0 END ELSE CAST({V.DISTANCE.format(e='e', a='a')} AS DOUBLE) / length(e) END AS FLOAT) AS cer, e = a AS exact FROM c")
def page_error_rate(spark, d):
    e, a = F.col("expected"), F.col("actual")
    return V.pairs(spark, d).select("pair", X.page_error_rate(e, a).alias("cer"), (X.normalize_whitespace(e) == X.normalize_whitespace(a)).alias("exact"))


_RUNS = f"""{V.RECORDS}, a AS (SELECT * FROM records WHERE pair % 10 <> 3), b AS (
  SELECT pair, CASE WHEN pair % 4 = 1 THEN expected ELSE actual END AS actual, truncated FROM records WHERE pair % 10 <> 7)"""


def _runs(spark, d):
    records = V.records(spark, d)
    other = records.select("pair", F.when(F.col("pair") % 4 == 1, F.col("expected")).otherwise(F.col("actual")).alias("actual"), "truncated")
    return records.where("pair % 10 <> 3"), other.where("pair % 10 <> 7").withColumn("nth", F.lit(1))


@query(f"WITH {_RUNS} SELECT a.pair, b.pair IS NOT NULL AS found, CASE WHEN b.pair IS NOT NULL THEN a.actual = b.actual AND a.truncated = b.truncated END AS same, CASE WHEN b.pair IS NOT NULL THEN CASE WHEN a.actual <> b.actual THEN 'actual' ELSE '' END END AS differing FROM a LEFT JOIN b USING (pair)")
def compare_runs(spark, d):
    a, b = _runs(spark, d)
    return E.compare_runs(a, b, key="pair", fields=["actual", "truncated"], order="nth")[0]


@query(f"WITH {_RUNS} SELECT b.pair FROM b ANTI JOIN a USING (pair)")
def missing_anti(spark, d):
    a, b = _runs(spark, d)
    return E.compare_runs(a, b, key="pair", fields=["actual", "truncated"], order="nth")[1]


@query(f"WITH {_RUNS} SELECT count(*) AS n FROM a SEMI JOIN b USING (pair)")
def overlap_semi(spark, d):
    a, b = _runs(spark, d)
    return a.join(b, "pair", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.RECORDS}, s AS (SELECT pair % 5 AS shard, count(*) AS compared, count(*) FILTER (WHERE exact) AS same FROM records WHERE pair % 10 <> 7 GROUP BY 1) SELECT CAST(sum(compared) AS BIGINT) AS compared, CAST(sum(same) AS BIGINT) AS same, CAST(sum(compared - same) AS BIGINT) AS different, greatest((SELECT count(*) FROM records) - CAST(sum(compared) AS BIGINT), 0) AS missing FROM s")
def merge_comparisons(spark, d):
    records = V.records(spark, d)
    shards = records.where("pair % 10 <> 7").groupBy((F.col("pair") % 5).alias("shard")).agg(F.count(F.lit(1)).alias("compared"), F.count_if("exact").alias("same")).withColumn("different", F.col("compared") - F.col("same"))
    return E.merge_comparisons(shards, records.agg(F.count(F.lit(1)).alias("total")).scalar())


# --- samples and shards


@query(f"WITH {V.SAMPLES} SELECT path, sha256(path || chr(31) || truth) AS sample_key FROM samples ORDER BY sample_key, path LIMIT 100")
def hash_sample(spark, d):
    return E.hash_sample(V.samples(spark, d), 100).select("path", "sample_key")


_HEAD = r"'docs' || chr(31) || 'test' || chr(31) || 'all' || chr(31) || 'first' || chr(31) || '0'"


@query(rf"WITH {V.SAMPLES}, e AS (SELECT lang, doc_id, path, chr(30) || path || chr(31) || sha256(truth) AS line, sha256(truth) AS digest, trim(truth) <> '' AS has FROM samples) SELECT lang, count(*) AS entry_count, count(*) FILTER (WHERE has) AS scored_count, sha256({_HEAD} || string_agg(line, '' ORDER BY doc_id)) AS manifest_sha256, sha256({_HEAD} || string_agg(line, '' ORDER BY path, digest)) AS sample_set_sha256 FROM e GROUP BY lang")
def manifest_digest(spark, d):
    return E.manifest_digests(V.samples(spark, d), ["lang"], dataset="docs", split="test", subset="all", strategy="first", limit=0, position="doc_id")


@query(f"""WITH {V.SAMPLES}, l0 AS (SELECT lang, doc_id AS i, sha256(path || chr(31) || sha256(truth)) AS h FROM samples
), l1 AS (SELECT lang, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l0 GROUP BY ALL
), l2 AS (SELECT lang, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l1 GROUP BY ALL
), l3 AS (SELECT lang, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l2 GROUP BY ALL)
SELECT lang, sha256(string_agg(h, '' ORDER BY i)) AS tree_sha256 FROM l3 GROUP BY lang""")
def manifest_tree(spark, d):
    return E.manifest_tree(V.samples(spark, d), ["lang"], position="doc_id", width=16, levels=3)


@query(f"WITH {V.SAMPLES} SELECT CAST(doc_id % 8 AS INTEGER) AS shard, count(*) AS n FROM samples GROUP BY 1")
def shard_assign(spark, d):
    return V.samples(spark, d).groupBy(E.shard_of(F.col("doc_id"), 8).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.SAMPLES}, s AS (SELECT path FROM samples WHERE doc_id % 9 <> 4 UNION ALL SELECT path FROM samples WHERE doc_id % 50 = 1), c AS (SELECT path, count(*) AS n FROM s GROUP BY path), m AS (SELECT path FROM samples WHERE doc_id % 31 <> 6), j AS (SELECT coalesce(c.path, m.path) AS path, CASE WHEN m.path IS NULL THEN 'unknown' WHEN c.path IS NULL THEN 'gap' WHEN n > 1 THEN 'duplicate' END AS problem FROM c FULL JOIN m ON c.path = m.path) SELECT * FROM j WHERE problem IS NOT NULL")
def shard_problems(spark, d):
    rows = V.samples(spark, d)
    shards = rows.where("doc_id % 9 <> 4").unionByName(rows.where("doc_id % 50 = 1"))
    return E.shard_problems(shards, rows.where("doc_id % 31 <> 6"), key="path")


@query(f"WITH {V.SAMPLES} SELECT path, doc_id AS position, CAST(doc_id % 4 AS INTEGER) AS shard FROM samples")
def merge_shards(spark, d):
    rows = V.samples(spark, d)
    parts = [rows.where(F.col("doc_id") % 4 == k).select("path", F.lit(k).alias("shard")) for k in range(4)]
    shards = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return E.merge_shards(shards, rows.select("path", F.col("doc_id").alias("position")), key="path").select("path", "position", "shard")


# --- statistics


@query("SELECT event_type, count(value) AS n, coalesce(min(value), 0) AS min, coalesce(max(value), 0) AS max, round(coalesce(avg(value), 0), 9) AS mean, coalesce(quantile_cont(value, 0.5), 0) AS p50, round(coalesce(quantile_cont(value, 0.95), 0), 9) AS p95, round(coalesce(stddev_samp(value), 0), 9) AS stddev FROM events GROUP BY event_type")
def latency_stats(spark, d):
    out = S.grouped_stats(V.table(spark, d, "events"), ["event_type"], "value")
    return out.withColumns({c: F.round(c, 9) for c in ("mean", "p95", "stddev")})


@query("WITH o AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(n) AS n, round(avg(v), 9) AS avg, max(v) FILTER (WHERE i = (n - 1) // 2) AS p50, max(v) FILTER (WHERE i = CAST(floor((n - 1) * 0.9 + 0.5) AS BIGINT)) AS p90 FROM o GROUP BY event_type")
def nearest_rank_stats(spark, d):
    return S.ranked_from_histogram(V.table(spark, d, "events"), "event_type", "value").withColumn("avg", F.round("avg", 9))


_LEDGER = f"""{V.timings_sql()}, z AS (SELECT user_id, day, total, {', '.join(f'coalesce({t}, 0) AS {t}' for t in S.TIMINGS[1:])} FROM timings
), l0 AS (SELECT *, decode + resize + crop AS named, greatest(preprocess - decode - resize - crop, 0) AS input_other FROM z
), l1 AS (SELECT *, least(named, greatest(preprocess - input_other, 0)) AS input_named_within, greatest(named - greatest(preprocess - input_other, 0), 0) AS input_overflow, postprocess AS page_postprocess FROM l0
), ledger AS (SELECT *, {' + '.join(S.PARTS)} AS attributed, detector_infer + classifier_infer + recognizer_infer AS inference FROM l1)"""


@query(f"WITH {_LEDGER} SELECT user_id, day, {', '.join(S.PARTS[:3])}, attributed, inference, total - attributed AS unattributed FROM ledger")
def ledger_components(spark, d):
    return S.with_ledger(V.timings(spark, d)).select("user_id", "day", *S.PARTS[:3], "attributed", "inference", "unattributed")


@query(f"WITH {_LEDGER} SELECT user_id, day, attributed - total AS residual, abs(attributed - total) <= greatest(1.6e-5, abs(total) * 1e-6) AS conserved, greatest(total - attributed, 0) AS excess FROM ledger")
def ledger_conservation(spark, d):
    return S.conservation(S.with_ledger(V.timings(spark, d))).select("user_id", "day", "residual", "conserved", "excess")


@query(f"WITH {_LEDGER} SELECT user_id, day, CASE WHEN total > 0 THEN inference / total END AS inference_share, CASE WHEN total > 0 THEN formula / total END AS formula_share FROM ledger")
def ledger_shares(spark, d):
    out = S.with_ledger(V.timings(spark, d)).fillna(0.0, ["formula"])
    return S.shares(out, ("inference", "formula")).select("user_id", "day", "inference_share", "formula_share")


@query(f"WITH {_LEDGER} SELECT day, {', '.join(f'round(avg({p}), 9) AS {p}' for p in S.PARTS)} FROM ledger GROUP BY day")
def ledger_mean(spark, d):
    return S.mean_ledger(S.with_ledger(V.timings(spark, d)), S.PARTS, ["day"]).select("day", *[F.round(p, 9).alias(p) for p in S.PARTS])


# --- files and sets


@query(f"WITH {V.MODEL_FILES} SELECT model_set, CASE WHEN count(*) FILTER (WHERE state = 'missing' AND size IS NULL) = 0 THEN CAST(coalesce(sum(size) FILTER (WHERE state = 'missing'), 0) AS BIGINT) END AS missing_bytes FROM model_files GROUP BY model_set")
def null_poison_sum(spark, d):
    return M.missing_bytes(V.model_files(spark, d), ["model_set"])


@query(f"WITH {V.MODEL_FILES} SELECT model_set, role, count(*) AS n, count(*) FILTER (WHERE state = 'present') AS present, count(*) FILTER (WHERE sha256 <> '') AS hashed, bool_and(state = 'present' AND sha256 <> '') AS complete FROM model_files GROUP BY model_set, role")
def set_status(spark, d):
    return M.set_status(V.model_files(spark, d), ["model_set", "role"])


@query(f"WITH {V.MODEL_FILES}, f AS (SELECT * FROM model_files WHERE size % 3 = 1) SELECT s.model_set, r.role FROM (SELECT DISTINCT model_set FROM model_files) s, (SELECT unnest(['detector', 'recognizer', 'dictionary']) AS role) r WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.model_set = s.model_set AND f.role = r.role)")
def missing_roles(spark, d):
    files = V.model_files(spark, d)
    return M.missing_roles(files.where("size % 3 = 1"), files.select("model_set").distinct(), ("detector", "recognizer", "dictionary"), "model_set")


@query(f"WITH {V.MODEL_FILES}, o AS (SELECT DISTINCT model_set, role, list_position({list(M.ROLES)}, role) AS i FROM model_files WHERE state <> 'present') SELECT model_set, string_agg(role, ',' ORDER BY i) AS roles FROM o GROUP BY model_set")
def declared_roles(spark, d):
    return M.declared_roles(V.model_files(spark, d).where("state <> 'present'"), ["model_set"])


@query(f"WITH {V.MODEL_FILES} SELECT model_set, name, count(*) AS n FROM model_files GROUP BY ALL HAVING count(*) > 1")
def duplicate_names(spark, d):
    return M.duplicate_names(V.model_files(spark, d), ["model_set"])


@query("WITH r AS (SELECT DISTINCT p_brand AS version, p_type AS kind FROM part UNION ALL SELECT 'none', 'none'), c AS (SELECT p_brand AS version, p_type AS kind, count(*) AS n, min(p_name || '_' || p_partkey) AS model FROM part WHERE p_size > 30 GROUP BY ALL) SELECT r.version, r.kind, CASE WHEN n = 1 THEN model END AS model, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS outcome FROM r LEFT JOIN c USING (version, kind)")
def resolve_models(spark, d):
    part = V.table(spark, d, "part").withColumnsRenamed({"p_brand": "version", "p_type": "kind"})
    asked = part.select("version", "kind").distinct().union(spark.sql("SELECT 'none', 'none'"))
    registry = part.where("p_size > 30").select("version", "kind", F.concat_ws("_", "p_name", F.col("p_partkey").cast("string")).alias("model"))
    return M.resolve(asked, registry, ["version", "kind"])


@query(f"WITH {V.MODEL_FILES} SELECT model_set, name, role, state FROM model_files WHERE role LIKE 'formula%' AND state <> 'present'")
def blocking_files(spark, d):
    return M.blocking_files(V.model_files(spark, d), "formula").select("model_set", "name", "role", "state")


# --- filters


@query(f"WITH {V.REGIONS} SELECT page, rid, score FROM regions WHERE score >= 0.05")
def text_score_filter(spark, d):
    return L.keep_scores(V.regions(spark, d), 0.05).select("page", "rid", "score")


@query(r"SELECT conv_id, turn FROM conversations WHERE regexp_matches(regexp_replace(text, '[A-Za-z ,.]', '', 'g'), '\S')")
def blank_filter(spark, d):
    rows = V.table(spark, d, "conversations").withColumn("left", F.regexp_replace("text", "[A-Za-z ,.]", ""))
    return L.keep_texts(rows, "left").select("conv_id", "turn")


@query(f"WITH {V.REGIONS}, c AS (SELECT page, rid, floor(greatest(0, least(x0, 63))) AS x0, floor(greatest(0, least(y0, 47))) AS y0, floor(greatest(0, least(x1, 63))) AS x1, floor(greatest(0, least(y1, 47))) AS y1 FROM regions) SELECT * FROM c WHERE CAST(floor(x1 - x0) AS INTEGER) > 3 AND CAST(floor(y1 - y0) AS INTEGER) > 3")
def clip_boxes(spark, d):
    return L.clip_boxes(V.regions(spark, d), 64, 48).select("page", "rid", "x0", "y0", "x1", "y1")


@query(f"WITH {V.REGIONS} SELECT page, rid, concat_ws(',', CASE WHEN x1 > 80 OR y1 > 60 THEN 'polygon' END, CASE WHEN NOT score BETWEEN 0 AND 0.09 THEN 'score' END, CASE WHEN class_id = 2 AND text IS NOT NULL THEN 'kind' END) AS violations FROM regions WHERE x1 > 80 OR y1 > 60 OR NOT score BETWEEN 0 AND 0.09 OR (class_id = 2 AND text IS NOT NULL)")
def region_violations(spark, d):
    return L.violations(V.regions(spark, d), {"polygon": (F.col("x1") > 80) | (F.col("y1") > 60), "score": ~F.col("score").between(0, 0.09), "kind": (F.col("class_id") == 2) & F.col("text").isNotNull()}).select("page", "rid", "violations")


@query(f"WITH {V.REGIONS} SELECT page, rid, greatest(0, least(x0, 64)) AS x0, greatest(0, least(y0, 48)) AS y0, greatest(0, least(x1, 64)) AS x1, greatest(0, least(y1, 48)) AS y1 FROM regions WHERE greatest(0, least(x1, 64)) - greatest(0, least(x0, 64)) >= 1 AND greatest(0, least(y1, 48)) - greatest(0, least(y0, 48)) >= 1")
def clamp_regions(spark, d):
    rows = V.regions(spark, d).withColumn("c", G.clamped_box(F.struct("x0", "y0", "x1", "y1"), F.lit(64), F.lit(48))).where("c is not null")
    return rows.select("page", "rid", "c.x0", "c.y0", "c.x1", "c.y1")


# --- order


@query(f"WITH {V.REGIONS}, g AS (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY page ORDER BY y0, rid) >= 10 THEN 1 ELSE 0 END AS j FROM regions), l AS (SELECT *, CAST(sum(j) OVER (PARTITION BY page ORDER BY y0, rid ROWS UNBOUNDED PRECEDING) AS INTEGER) AS line FROM g) SELECT page, rid, line, CAST(row_number() OVER (PARTITION BY page ORDER BY line, x0, y0, rid) AS INTEGER) AS place FROM l")
def line_ids(spark, d):
    return O.line_ids(V.regions(spark, d), page="page", rid="rid")


@query(f"WITH {V.REGIONS}, r AS (SELECT page, x0, x1, max(x1) OVER (PARTITION BY page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM regions), g AS (SELECT page, reach AS gap_start, x0 AS gap_end, row_number() OVER (PARTITION BY page ORDER BY x0 - reach DESC, reach) AS i FROM r WHERE x0 > reach) SELECT page, gap_start, gap_end FROM g WHERE i = 1")
def largest_gap(spark, d):
    return O.largest_gap(V.regions(spark, d), page="page", start="x0", end="x1")


@query(f"WITH {V.REGIONS}, h AS (SELECT page, y1 - y0 AS h, row_number() OVER (PARTITION BY page ORDER BY y1 - y0) - 1 AS i, count(*) OVER (PARTITION BY page) AS n FROM regions) SELECT page, h AS median FROM h WHERE i = n // 2")
def upper_median_height(spark, d):
    return O.upper_median_height(V.regions(spark, d), page="page")


@query("WITH o AS (SELECT p_brand, p_partkey, p_retailprice / (p_size + 1) AS ratio, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice / (p_size + 1), p_partkey) AS nth FROM part), b AS (SELECT *, CAST((nth - 1) // 6 AS INTEGER) AS batch FROM o) SELECT p_brand, p_partkey, batch, max(ratio) OVER (PARTITION BY p_brand, batch) AS batch_ratio FROM b")
def aspect_batches(spark, d):
    return O.aspect_batches(V.table(spark, d, "part"), rid="p_partkey", ratio=F.col("p_retailprice") / (F.col("p_size") + 1), group="p_brand")


@query(f"WITH {V.FRAMES}, k AS (SELECT *, token <> 0 AND token IS DISTINCT FROM lag(token) OVER (PARTITION BY line ORDER BY ts, event_id) AS kept FROM frames) SELECT line, coalesce(string_agg(letter, '' ORDER BY ts, event_id) FILTER (WHERE kept), '') AS text, round_even(coalesce(avg(prob) FILTER (WHERE kept), 0) * 100000, 0) / 100000 AS score FROM k GROUP BY line")
def ctc_decode(spark, d):
    return O.ctc_decode(V.frames(spark, d), line="line", at=["ts", "event_id"], token="token", prob="prob", letter=F.col("letter"))


_TOKENS = f"{V.FRAMES}, t AS (SELECT line, list(CAST(token AS BIGINT) ORDER BY ts, event_id) AS tokens FROM frames GROUP BY line)"


@query(f"WITH {_TOKENS} SELECT line, array_to_string(CASE WHEN list_position(tokens, 2) > 0 THEN tokens[: list_position(tokens, 2)] ELSE tokens END, ',') AS prefix, CASE WHEN list_position(tokens, 2) > 0 THEN CAST(list_position(tokens, 2) - 1 AS INTEGER) END AS eos_index, coalesce(list_position(tokens, 2), 0) = 0 AS truncated FROM t")
def eos_prefix(spark, d):
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("token").cast("long").alias("token")))), lambda x: x["token"])
    rows = V.frames(spark, d).groupBy("line").agg(tokens.alias("tokens")).withColumn("e", O.eos_prefix(F.col("tokens")))
    return rows.select("line", F.array_join(F.transform("e.prefix", lambda t: t.cast("string")), ",").alias("prefix"), "e.eos_index", "e.truncated")


def _widest(low: str, high: str) -> str:
    """The widest gap between merged intervals of the boxes in bs, as {k: -width, i: place, m: middle}; null if there is none."""
    s = f"list_sort(list_transform(bs, lambda b: {{'a': b.{low}, 'z': b.{high}}}))"
    reach = f"list_max(list_transform({s}[1 : i - 1], lambda y: y.z))"
    gaps = f"list_transform(range(2, len(bs) + 1), lambda i: {{'k': {reach} - {s}[i].a, 'i': i, 'm': ({s}[i].a + {reach}) / 2}})"
    return f"list_sort(list_filter({gaps}, lambda g: g.k < 0))[1]"


_PIECE = f"""SELECT *, CASE WHEN -r.k >= 1.5 * med THEN 'y' WHEN -c.k >= greatest(0.5 * med, 2) THEN 'x' WHEN -r.k >= 1 THEN 'y' END AS axis FROM (
  SELECT page, path, bs, {_widest('y0', 'y1')} AS r, {_widest('x0', 'x1')} AS c, list_sort(list_transform(bs, lambda b: b.y1 - b.y0))[len(bs) // 2 + 1] AS med FROM pc)"""
_LEAF_FITS = "greatest(least(y.bottom, b.y1) - greatest(y.top, b.y0), 0)"
_ORDER = f"""{V.REGIONS}, pc AS (
  SELECT page, '' AS path, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'rid': rid}}) AS bs FROM regions GROUP BY page
  UNION ALL
  SELECT page, path || side, CASE WHEN axis = 'y' THEN list_filter(bs, lambda b: CASE WHEN side = '0' THEN b.y1 <= r.m ELSE b.y0 >= r.m END) ELSE list_filter(bs, lambda b: CASE WHEN side = '0' THEN b.x1 <= c.m ELSE b.x0 >= c.m END) END
  FROM (SELECT *, unnest(['0', '1']) AS side FROM ({_PIECE}) WHERE axis IS NOT NULL)
), leaf AS (SELECT page, path, unnest(bs) AS b FROM ({_PIECE}) WHERE axis IS NULL
), lo AS (SELECT page, path, b, row_number() OVER (PARTITION BY page, path ORDER BY b.y0, b.x0, b.rid) AS n FROM leaf
), lw AS (SELECT page, path, CAST(1 AS BIGINT) AS n, [{{'top': b.y0, 'bottom': b.y1, 'x': b.x0, 'items': [{{'x0': b.x0, 'y0': b.y0, 'rid': b.rid}}]}}] AS k FROM lo WHERE n = 1
  UNION ALL
  SELECT page, path, n, CASE WHEN place > 0 THEN list_transform(k, lambda y, i: CASE WHEN i = place THEN {{'top': least(y.top, b.y0), 'bottom': greatest(y.bottom, b.y1), 'x': least(y.x, b.x0), 'items': list_append(y.items, {{'x0': b.x0, 'y0': b.y0, 'rid': b.rid}})}} ELSE y END)
      ELSE list_append(k, {{'top': b.y0, 'bottom': b.y1, 'x': b.x0, 'items': [{{'x0': b.x0, 'y0': b.y0, 'rid': b.rid}}]}}) END FROM (
    SELECT *, CASE WHEN list_max(gain) >= 0 THEN list_position(gain, list_max(gain)) ELSE 0 END AS place FROM (
      SELECT page, path, n, b, k, list_transform(k, lambda y: CASE WHEN {_LEAF_FITS} / greatest(least(y.bottom - y.top, b.y1 - b.y0), 0.0001) >= 0.5 THEN {_LEAF_FITS} ELSE -1 END) AS gain FROM (
        SELECT lo.page, lo.path, lo.n, lo.b, lw.k FROM lw JOIN lo ON lo.page = lw.page AND lo.path = lw.path AND lo.n = lw.n + 1)))
), ll AS (SELECT page, path, arg_max(k, n) AS k FROM lw GROUP BY page, path
), li AS (SELECT page, path, unnest(k) AS y, unnest(range(1, len(k) + 1)) AS seq FROM ll
), gr AS (SELECT page, y.items AS items, row_number() OVER (PARTITION BY page ORDER BY path, y.top, y.x, seq) - 1 AS grp FROM li
), rd AS (SELECT page, b.rid AS rid, CAST(grp AS INTEGER) AS grp, CAST(row_number() OVER (PARTITION BY page, grp ORDER BY b.x0, b.y0, b.rid) - 1 AS INTEGER) AS place FROM (SELECT page, grp, unnest(items) AS b FROM gr))"""


@query(f"WITH RECURSIVE {_ORDER} SELECT page, rid, grp, place FROM rd")
def reading_order(spark, d):
    return O.reading_order(V.regions(spark, d), page="page", rid="rid")


@query("WITH p AS (SELECT p_partkey, p_size * 40 AS w, p_size * 25 + 10 AS h FROM part WHERE p_size > 0) SELECT p_partkey, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, CAST(least(640, w - tx) AS INTEGER) AS tw, CAST(least(640, h - ty) AS INTEGER) AS th FROM (SELECT p_partkey, w, h, ty, unnest(range(0, w, 576)) AS tx FROM (SELECT p_partkey, w, h, unnest(range(0, h, 576)) AS ty FROM p))")
def tile_grid(spark, d):
    part = V.table(spark, d, "part").where("p_size > 0").select("p_partkey", "p_size")
    return O.tiles(part, width=F.col("p_size") * 40, height=F.col("p_size") * 25 + 10, tile=640, overlap=64).select("p_partkey", "ty", "tx", "tw", "th")


# --- folds

_BOX_IOU = """CASE WHEN (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - i > 0 THEN i / ((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - i) ELSE 0 END"""
_PAIRS_IOU = f"""pi AS (SELECT a.page, a.rid AS a, b.rid AS b, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, b.x0 AS bx0, b.y0 AS by0, b.x1 AS bx1, b.y1 AS by1, a.text AS at, b.text AS bt,
    greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i, a.class_id AS ac, b.class_id AS bc
  FROM regions a JOIN regions b ON a.page = b.page AND a.rid <> b.rid), iou AS (SELECT *, {_BOX_IOU} AS iou FROM pi)"""


@query(f"WITH {V.REGIONS}, {_PAIRS_IOU} SELECT page, a, b, iou FROM iou WHERE a < b AND iou > 0.5")
def pairwise_iou(spark, d):
    rows = V.regions(spark, d)
    pairs = D.candidate_pairs(rows.withColumnRenamed("rid", "e"), rows.withColumnRenamed("rid", "p"), page="page", threshold=0.0)
    return pairs.where("e < p AND iou > 0.5").select("page", F.col("e").alias("a"), F.col("p").alias("b"), "iou")


def _greedy(order: str, hit: str, base: str = "regions", most: int | None = None) -> str:
    """A recursive query that walks each page's rows in order; k holds the kept rids."""
    full = f" OR len(w.k) >= {most}" if most else ""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {order}) AS n FROM {base}), w AS (
  SELECT page, CAST(1 AS BIGINT) AS n, [rid] AS k FROM o WHERE n = 1
  UNION ALL
  SELECT o.page, o.n, CASE WHEN EXISTS (SELECT 1 FROM {hit}){full} THEN w.k ELSE list_append(w.k, o.rid) END FROM w JOIN o ON o.page = w.page AND o.n = w.n + 1
), last AS (SELECT page, arg_max(k, n) AS k FROM w GROUP BY page), kept AS (SELECT page, unnest(k) AS rid FROM last)"""


@query(f"WITH RECURSIVE {V.REGIONS}, {_PAIRS_IOU}, {_greedy('score DESC, rid', 'iou h WHERE h.page = o.page AND h.a = o.rid AND list_contains(w.k, h.b) AND h.ac = h.bc AND h.iou > 0.3')} SELECT page, rid FROM kept")
def nms(spark, d):
    return D.suppress_overlaps(V.regions(spark, d), page="page", rid="rid", threshold=0.3, class_id="class_id")


_CUT = """cut AS (SELECT * FROM (SELECT page, rid, greatest(0, least(x0, 80)) AS x0, greatest(0, least(y0, 60)) AS y0, greatest(0, least(x1, 80)) AS x1, greatest(0, least(y1, 60)) AS y1, score, class_id, text, rid % 2 = 0 AS detected FROM regions)
  WHERE x1 - x0 >= 1 AND y1 - y0 >= 1 AND (NOT detected OR (x1 - x0) * (y1 - y0) >= 80.0 * 60.0 * 0.05))"""


@query(f"WITH RECURSIVE {V.REGIONS}, {_CUT}, {_PAIRS_IOU.replace('FROM regions a JOIN regions b', 'FROM cut a JOIN cut b')}, {_greedy('score DESC, (x1 - x0) * (y1 - y0) DESC, x0, y0, x1, y1, rid', 'iou h WHERE h.page = o.page AND h.a = o.rid AND list_contains(w.k, h.b) AND (h.iou >= 0.5 OR h.i / ((h.ax1 - h.ax0) * (h.ay1 - h.ay0)) >= 0.9)', 'cut', 3)} SELECT page, rid, x0, y0, x1, y1, score FROM kept JOIN cut USING (page, rid)")
def route_regions(spark, d):
    rows = V.regions(spark, d).withColumn("detected", F.col("rid") % 2 == 0)
    return D.route_regions(rows, page="page", rid="rid", width=F.lit(80), height=F.lit(60), min_area_ratio=0.05, threshold=0.5, max_regions=3)


_MATCH = f"""{V.REGIONS}, {_PAIRS_IOU}, c AS (SELECT page, a AS e, b AS p, iou FROM iou WHERE a % 2 = 1 AND b % 2 = 0 AND iou >= 0.2),
  o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY iou DESC, e, p) AS n FROM c), w AS (
  SELECT page, CAST(1 AS BIGINT) AS n, [e] AS es, [p] AS ps FROM o WHERE n = 1
  UNION ALL
  SELECT o.page, o.n, CASE WHEN list_contains(w.es, o.e) OR list_contains(w.ps, o.p) THEN w.es ELSE list_append(w.es, o.e) END,
    CASE WHEN list_contains(w.es, o.e) OR list_contains(w.ps, o.p) THEN w.ps ELSE list_append(w.ps, o.p) END FROM w JOIN o ON o.page = w.page AND o.n = w.n + 1
), last AS (SELECT page, arg_max(es, n) AS es, arg_max(ps, n) AS ps FROM w GROUP BY page), matched AS (SELECT page, unnest(es) AS e, unnest(ps) AS p FROM last)"""


def _matches(spark, d):
    rows = V.regions(spark, d)
    e, p = rows.where("rid % 2 = 1").withColumnRenamed("rid", "e"), rows.where("rid % 2 = 0").withColumnRenamed("rid", "p")
    return e, p, D.match_one_to_one(D.candidate_pairs(e, p, page="page", threshold=0.2), page="page")


@query(f"WITH RECURSIVE {_MATCH} SELECT page, e, p, iou FROM matched JOIN c USING (page, e, p)")
def match_boxes(spark, d):
    return _matches(spark, d)[2]


@query(f"WITH RECURSIVE {_MATCH}, m AS (SELECT page, count(*) AS n, avg(iou) AS iou FROM matched JOIN c USING (page, e, p) GROUP BY page), k AS (SELECT page, count(*) FILTER (WHERE rid % 2 = 1) AS ne, count(*) FILTER (WHERE rid % 2 = 0) AS np FROM regions GROUP BY page) SELECT page, CASE WHEN ne > 0 THEN coalesce(n, 0) / ne END AS recall, CASE WHEN ne > 0 AND np > 0 THEN coalesce(n, 0) / np END AS precision, round(iou, 9) AS iou FROM k LEFT JOIN m USING (page)")
def detection_metrics(spark, d):
    return E.detection_metrics(*_matches(spark, d), page="page").withColumn("iou", F.round("iou", 9))


def _common(a: str, b: str) -> str:
    return f"(greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0))"


def _area(a: str) -> str:
    return f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


@query(f"""WITH RECURSIVE {V.REGIONS}, o AS (
  SELECT page, text, {{'rid': rid, 'score': score, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} AS b, row_number() OVER (PARTITION BY page, text ORDER BY rid) AS n FROM regions
), w AS (SELECT page, text, CAST(1 AS BIGINT) AS n, [b] AS k FROM o WHERE n = 1
  UNION ALL
  SELECT page, text, n, CASE WHEN place > 0 THEN list_transform(k, lambda y, i: CASE WHEN i = place AND b.score > y.score THEN b ELSE y END) ELSE list_append(k, b) END FROM (
    SELECT o.page, o.text, o.n, o.b, w.k, coalesce(list_position(list_transform(w.k, lambda y: {_common('y', 'o.b')} / ({_area('y')} + {_area('o.b')} - {_common('y', 'o.b')}) >= 0.5), true), 0) AS place
    FROM w JOIN o ON o.page = w.page AND o.text = w.text AND o.n = w.n + 1)
), last AS (SELECT page, text, unnest(arg_max(k, n)) AS b FROM w GROUP BY page, text)
SELECT page, b.rid AS rid, text, b.score AS score, b.y0 AS y0, b.x0 AS x0 FROM last""")
def dedupe_regions(spark, d):
    return D.deduplicate(V.regions(spark, d), page="page", rid="rid", text="text")


_FITS = "greatest(least(y.bottom, b.y1) - greatest(y.top, b.y0), 0)"


@query(f"""WITH RECURSIVE {V.REGIONS}, o AS (
  SELECT page, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'rid': rid}} AS b, row_number() OVER (PARTITION BY page ORDER BY y0, x0, rid) AS n FROM regions
), w AS (SELECT page, CAST(1 AS BIGINT) AS n, [{{'top': b.y0, 'bottom': b.y1, 'x': b.x0, 'items': [{{'x0': b.x0, 'y0': b.y0, 'rid': b.rid}}]}}] AS k FROM o WHERE n = 1
  UNION ALL
  SELECT page, n, CASE WHEN place > 0 THEN list_transform(k, lambda y, i: CASE WHEN i = place THEN {{'top': least(y.top, b.y0), 'bottom': greatest(y.bottom, b.y1), 'x': least(y.x, b.x0), 'items': list_append(y.items, {{'x0': b.x0, 'y0': b.y0, 'rid': b.rid}})}} ELSE y END)
      ELSE list_append(k, {{'top': b.y0, 'bottom': b.y1, 'x': b.x0, 'items': [{{'x0': b.x0, 'y0': b.y0, 'rid': b.rid}}]}}) END FROM (
    SELECT *, CASE WHEN list_max(gain) >= 0 THEN list_position(gain, list_max(gain)) ELSE 0 END AS place FROM (
      SELECT page, n, b, k, list_transform(k, lambda y: CASE WHEN {_FITS} / greatest(least(y.bottom - y.top, b.y1 - b.y0), 0.0001) >= 0.5 THEN {_FITS} ELSE -1 END) AS gain FROM (
        SELECT o.page, o.n, o.b, w.k FROM w JOIN o ON o.page = w.page AND o.n = w.n + 1)))
), last AS (SELECT page, arg_max(k, n) AS k FROM w GROUP BY page
), l AS (SELECT page, unnest(k) AS y, unnest(range(1, len(k) + 1)) AS seq FROM last
), r AS (SELECT page, y.items AS items, row_number() OVER (PARTITION BY page ORDER BY y.top, y.x, seq) - 1 AS line FROM l
), i AS (SELECT page, line, unnest(items) AS b FROM r)
SELECT page, b.rid AS rid, CAST(line AS INTEGER) AS line, CAST(row_number() OVER (PARTITION BY page, line ORDER BY b.x0, b.y0, b.rid) - 1 AS INTEGER) AS place FROM i""")
def line_clusters(spark, d):
    return D.cluster_lines(V.regions(spark, d), page="page", rid="rid")


# --- rendering


@query(f"WITH {V.REGIONS}, l AS (SELECT *, y1 - y0 AS h, (y0 + y1) * 0.5 AS c, lag(y1 - y0) OVER o AS ph, lag((y0 + y1) * 0.5) OVER o AS pc, lag(y0) OVER o AS py0, lag(y1) OVER o AS py1, row_number() OVER o AS n FROM regions WINDOW o AS (PARTITION BY page ORDER BY y0, x0, rid)), s AS (SELECT page, n, CASE WHEN n = 1 THEN '' WHEN abs(c - pc) < least(h, ph) * 0.5 OR least(py1, y1) > greatest(py0, y0) THEN '   ' WHEN y0 - py1 > ph * 0.7 THEN chr(10) || chr(10) ELSE chr(10) END || text AS t FROM l) SELECT page, string_agg(t, '' ORDER BY n) AS markdown FROM s GROUP BY page")
def markdown_lines(spark, d):
    return R.visual_lines(V.regions(spark, d), page="page", rid="rid", text="text")


@query("SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY turn, role, text)) AS plain FROM conversations GROUP BY conv_id")
def plain_text(spark, d):
    out = R.plain_text(V.table(spark, d, "conversations"), page="conv_id", at=["turn", "role"], text="text")
    return out.select("conv_id", F.md5(F.col("plain").cast("binary")).alias("plain"))


_PART = "CASE WHEN class_id = 2 THEN '$$' || chr(10) || 'x^' || text || chr(10) || '$$' || CASE WHEN score > 0.08 THEN chr(10) || chr(10) || '<!-- formula truncated: no EOS token -->' ELSE '' END ELSE text END"


@query(f"""WITH RECURSIVE {_ORDER}, pt AS (SELECT page, grp, place, y0, y1, class_id, {_PART} AS part FROM rd JOIN regions USING (page, rid)
), gp AS (SELECT page, grp, bool_or(class_id = 2) AS formula, string_agg(part, chr(10) ORDER BY place) AS body, string_agg(part, '   ' ORDER BY place) AS line, min(y0) AS top, max(y1) AS bottom FROM pt GROUP BY page, grp
), bl AS (SELECT page, grp, CASE WHEN top - lag(bottom) OVER w > least(bottom - top, lag(bottom - top) OVER w) * 0.7 THEN chr(10) ELSE '' END || CASE WHEN formula THEN body ELSE line END AS block FROM gp WINDOW w AS (PARTITION BY page ORDER BY grp))
SELECT page, string_agg(block, chr(10) ORDER BY grp) AS markdown FROM bl GROUP BY page""")
def reading_markdown(spark, d):
    rows = V.regions(spark, d)
    ordered = O.reading_order(rows, page="page", rid="rid").join(rows, ["page", "rid"])
    formula = F.col("class_id") == 2
    shown = ordered.withColumns({"latex": F.when(formula, F.concat(F.lit("x^"), F.col("text"))), "truncated": formula & (F.col("score") > 0.08)})
    return R.reading_markdown(shown, page="page", at=["grp", "place"])


@query(f"""WITH {V.REGIONS} SELECT page, rid, '{{"box":[' || CAST(CAST(x0 AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(y0 AS BIGINT) AS VARCHAR) || '],"txt":"' || text || '","kind":"' || CASE WHEN class_id = 2 THEN 'formula' ELSE 'text' END || '"}}' AS item FROM regions""")
def json_items(spark, d):
    kind = F.when(F.col("class_id") == 2, "formula").otherwise("text")
    item = F.to_json(F.struct(F.array(F.col("x0").cast("long"), F.col("y0").cast("long")).alias("box"), F.col("text").alias("txt"), kind.alias("kind")))
    return V.regions(spark, d).select("page", "rid", item.alias("item"))


_ESC = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query(f"SELECT page_id, md5({_ESC}) AS escaped, md5(replace(replace(replace({_ESC}, chr(10), '&#10;'), chr(13), '&#13;'), chr(9), '&#9;')) AS attribute FROM pages")
def escape_html(spark, d):
    html = F.col("html")
    return V.table(spark, d, "pages").select("page_id", F.md5(X.escape_html(html).cast("binary")).alias("escaped"), F.md5(X.escape_attribute(html).cast("binary")).alias("attribute"))


@query("SELECT page_id, strlen(html) <= 3000 AS fits, CASE WHEN strlen(html) <= 3000 THEN md5(html) END AS digest, strlen(html) AS bytes FROM pages")
def bounded_text(spark, d):
    rows = V.table(spark, d, "pages").select("page_id", "html").withColumn("b", R.json_bounded(F.col("html"), 3000))
    return rows.select("page_id", (~F.col("b.too_large")).alias("fits"), F.md5(F.col("b.json").cast("binary")).alias("digest"), F.col("b.bytes").cast("long").alias("bytes"))


_COLORS = list(R.PALETTE)


@query(f"""WITH {V.REGIONS}, p AS (SELECT page, rid, text, printf('<rect x="%.1f" y="%.1f" width="%.1f" height="%.1f" stroke="%s"/>', x0, y0, x1 - x0, y1 - y0, {_COLORS}[rid % {len(_COLORS)} + 1]) AS o FROM regions)
SELECT page, sha256('<!doctype html><meta charset=utf-8><title>page ' || page || '</title><svg viewBox="0 0 90 75">' || string_agg(o, '' ORDER BY rid) || '</svg><ol>' || string_agg('<li>' || text || '</li>', '' ORDER BY rid) || '</ol>') AS html FROM p GROUP BY page""")
def html_report(spark, d):
    out = R.html_report(V.regions(spark, d), page="page", rid="rid", title=F.concat(F.lit("page "), F.col("page").cast("string")), width=F.lit(90), height=F.lit(75))
    return out.select("page", F.sha2(F.col("html").cast("binary"), 256).alias("html"))


# --- strings

_WS = r"[\s\x0b\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(f"SELECT doc_id, md5(trim(regexp_replace(text, '{_WS}+', ' ', 'g'))) AS spaced, md5(regexp_replace(text, '{_WS}', '', 'g')) AS stripped FROM documents")
def normalize_ws(spark, d):
    t = F.col("text")
    return V.table(spark, d, "documents").select("doc_id", F.md5(X.normalize_whitespace(t).cast("binary")).alias("spaced"), F.md5(X.strip_whitespace(t).cast("binary")).alias("stripped"))


@query(r"""SELECT doc_id, md5(regexp_replace(nfc_normalize(replace(translate(replace(s, chr(64257), 'fi'), chr(8220) || chr(8221) || chr(8217) || chr(65313), '""''A'), chr(13), chr(10))), '[\x07]', '', 'g')) AS fixed FROM (
  SELECT doc_id, chr(8220) || text || chr(8221) || chr(8217) || chr(64257) || chr(65313) || 'e' || chr(769) || chr(13) || chr(7) || 'x' AS s FROM documents)""")
def fix_text(spark, d):
    odd = "”’ﬁＡe\u0301\r\x07x"
    text = F.concat(F.lit("“"), F.col("text"), F.lit(odd))
    return V.table(spark, d, "documents").select("doc_id", F.md5(X.fix_text(text).cast("binary")).alias("fixed"))


_LATEX = r"'\begin{array}{ll} ' || w || CASE WHEN doc_id % 3 = 0 THEN ' \end{array}' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' \end{cases}' ELSE '' END"


@query(rf"""WITH l AS (SELECT doc_id, {_LATEX} AS s FROM (SELECT doc_id, text AS w FROM documents))
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '\begin{{cases}} ' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN s ELSE s || ' \end{{array}}' END AS latex FROM l""")
def latex_environments(spark, d):
    word = F.col("text")
    ends = F.concat(F.when(F.col("doc_id") % 3 == 0, r" \end{array}").otherwise(""), F.when(F.col("doc_id") % 5 == 0, r" \end{cases}").otherwise(""))
    return V.table(spark, d, "documents").select("doc_id", X.balance_environments(F.concat(F.lit(r"\begin{array}{ll} "), word, ends)).alias("latex"))


@query(r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{\alpha} \left( {' || w || ' \right) } \uparrow \begin{matrix} x \end{matrix}' WHEN 1 THEN '{\left( {' || w || '  } y } z\right)' ELSE '\begin{cases} \begin{array}{ll} ( { ' || w || ' ) \alpha \uplus \end{array} \end{cases}' END AS latex
  FROM (SELECT doc_id, replace(text, chr(34), '') AS w FROM documents)""")
def latex_repair(spark, d):
    """A pair at the top, a pair that moves to the end of its group, and one \\right too few among environments."""
    word, k = F.col("text"), F.col("doc_id") % 3
    latex = F.when(k == 0, F.concat(F.lit(r"\lefteqn{\upalpha} \left( {"), word, F.lit(r" \right) } \uparrow \begin{matrix} x")))
    latex = latex.when(k == 1, F.concat(F.lit(r"{\left( {"), word, F.lit(r" \right) } y } z")))
    latex = latex.otherwise(F.concat(F.lit(r"\begin{array}{ll} \left( { "), word, F.lit(r" ) \upalpha \uplus \end{array} \end{cases}")))
    return V.table(spark, d, "documents").select("doc_id", X.repair_latex(latex).alias("latex"))


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '^[a-z]+://[^/?#]+/(?:[^?#]*/)?([^/?#]*)', 1), '') AS file FROM pages")
def url_parts(spark, d):
    url = F.col("url")
    return V.table(spark, d, "pages").select("page_id", F.parse_url(url, F.lit("HOST")).alias("host"), F.parse_url(url, F.lit("PATH")).alias("path"), X.query_parameter(url, "page").alias("page"), X.file_name_of(url).alias("file"))


@query(r"WITH n AS (SELECT p_partkey, replace(p_name, ' ', '_') || CASE p_partkey % 3 WHEN 0 THEN '_PP-v4_rec_server.onnx' WHEN 1 THEN '_ppocr_rec_mobile.onnx' ELSE '_plain.onnx' END AS m FROM part) SELECT p_partkey, nullif(regexp_extract(m, '^(.+?)(?:_PP|_ppocr)', 1), '') AS tag, CASE WHEN contains(lower(m), '_server_') OR contains(lower(m), '_server.') THEN 'server' ELSE 'mobile' END AS variant FROM n")
def model_names(spark, d):
    k = F.col("p_partkey") % 3
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(k == 0, "_PP-v4_rec_server.onnx").when(k == 1, "_ppocr_rec_mobile.onnx").otherwise("_plain.onnx"))
    return V.table(spark, d, "part").select("p_partkey", X.language_tag(name).alias("tag"), X.model_variant(name).alias("variant"))


@query(r"WITH s AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'x' ELSE '' END || (event_id % 7) || '/' || (event_id % 5) AS r FROM events) SELECT event_id, CASE WHEN regexp_full_match(r, '[0-9]+/[0-9]+') AND event_id % 7 < event_id % 5 THEN CAST(event_id % 7 AS INTEGER) END AS shard FROM s")
def parse_shards(spark, d):
    raw = F.concat(F.when(F.col("event_id") % 9 == 0, "x").otherwise(""), (F.col("event_id") % 7).cast("string"), F.lit("/"), (F.col("event_id") % 5).cast("string"))
    return V.table(spark, d, "events").select("event_id", X.parse_shard(raw)["index"].alias("shard"))


# --- geometry and pixels


@query(f"WITH {V.REGIONS} SELECT page, rid, (x1 - x0) * (y1 - y0) AS area, 2 * (x1 - x0) + 2 * (y1 - y0) AS perimeter, round((y1 - y0) / (x1 - x0), 2) >= 1.5 AS vertical FROM regions")
def polygon_measures(spark, d):
    quad = G.box_quad(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    return V.regions(spark, d).select("page", "rid", G.polygon_area(quad).alias("area"), G.perimeter(quad).alias("perimeter"), G.is_vertical(quad).alias("vertical"))


@query(f"WITH {V.REGIONS} SELECT page, rid, x0 AS left_x, y0 AS top_y, x1 AS right_x, y1 AS bottom_y FROM regions")
def corner_order(spark, d):
    shuffled = F.array(*[G.point(F.col(x), F.col(y)) for x, y in (("x1", "y1"), ("x0", "y0"), ("x0", "y1"), ("x1", "y0"))])
    rows = V.regions(spark, d).withColumn("q", G.order_clockwise(shuffled))
    return rows.select("page", "rid", F.col("q")[0]["x"].alias("left_x"), F.col("q")[0]["y"].alias("top_y"), F.col("q")[2]["x"].alias("right_x"), F.col("q")[2]["y"].alias("bottom_y"))


@query("WITH c AS (SELECT event_id, event_id % 256 AS r, event_id * 7 % 256 AS g, event_id * 13 % 256 AS b, event_id * 3 % 256 AS a FROM events) SELECT event_id, CAST((299 * r + 587 * g + 114 * b + 500) // 1000 AS INTEGER) AS luma, CAST((r * a + 255 * (255 - a)) // 255 AS INTEGER) AS blended FROM c")
def pixel_arithmetic(spark, d):
    i = F.col("event_id")
    r, g, b, a = i % 256, i * 7 % 256, i * 13 % 256, i * 3 % 256
    return V.table(spark, d, "events").select("event_id", P.luma(r, g, b).cast("int").alias("luma"), P.blend_on_white(r, a).cast("int").alias("blended"))


_WORD_FRAMES = f"""{V.FRAMES}, n AS (SELECT line, row_number() OVER (PARTITION BY line ORDER BY ts, event_id) - 1 AS col, token FROM frames)"""


@query(f"WITH {_WORD_FRAMES} SELECT line, col, CAST(floor(greatest((col + 0.5) * 5 - 2, 0)) + 10 AS DOUBLE) AS x0, CAST(floor(least((col + 0.5) * 5 + 2, 2000)) + 10 AS DOUBLE) AS x1 FROM n WHERE token <> 0")
def char_boxes(spark, d):
    w = Window.partitionBy("line").orderBy("ts", "event_id")
    cols = V.frames(spark, d).withColumn("col", F.row_number().over(w) - 1).where("token <> 0")
    lines = cols.groupBy("line").agg(F.array_sort(F.collect_list("col")).alias("cols"))
    box = F.struct(F.lit(10.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(2010.0).alias("x1"), F.lit(9.0).alias("y1"))
    placed = F.arrays_zip("cols", G.char_boxes(F.col("cols"), F.lit(4.0), F.lit(5.0), box).alias("boxes"))
    return lines.select("line", F.explode(placed).alias("c")).select("line", F.col("c.cols").cast("long").alias("col"), F.col("c")["boxes"]["x0"].alias("x0"), F.col("c")["boxes"]["x1"].alias("x1"))


@query("WITH c AS (SELECT event_id, ['invalid_image', 'tokenizer', 'decode', 'config', 'unknown'][event_id % 5 + 1] AS e FROM events) SELECT event_id, CASE e WHEN 'invalid_image' THEN 'image_decode' WHEN 'tokenizer' THEN 'tokenizer_decode' WHEN 'decode' THEN 'inference' WHEN 'config' THEN 'input_rejected' END AS failure FROM c")
def error_classes(spark, d):
    names = F.array(*map(F.lit, ("invalid_image", "tokenizer", "decode", "config", "unknown")))
    return V.table(spark, d, "events").select("event_id", X.error_failure(F.element_at(names, (F.col("event_id") % 5 + 1).cast("int"))).alias("failure"))


@query("SELECT p_partkey, CAST(CASE WHEN h > 30 AND NOT (w / h > 8) THEN 0 ELSE floor(abs(floor(greatest(w / 8, 30)) * 2 - h) / 2) END AS INTEGER) AS padding FROM (SELECT p_partkey, p_size * 20.0 AS w, p_partkey % 70 + 1.0 AS h FROM part)")
def vertical_padding(spark, d):
    w, h = F.col("p_size") * 20.0, F.col("p_partkey") % 70 + 1.0
    return V.table(spark, d, "part").select("p_partkey", G.vertical_padding(w, h, 8.0, 30).alias("padding"))


@query(f"WITH {V.REGIONS} SELECT page, count(*) AS regions, count(*) FILTER (WHERE class_id = 2) AS formulas, count(*) FILTER (WHERE class_id <> 2) AS texts FROM regions GROUP BY page")
def region_counts(spark, d):
    formula = F.col("class_id") == 2
    return V.regions(spark, d).groupBy("page").agg(F.count(F.lit(1)).alias("regions"), F.count_if(formula).alias("formulas"), F.count_if(~formula).alias("texts"))


@query(f"WITH {V.REGIONS} SELECT page, count(*) > 0 AND bool_and(score >= 0) AS good, avg(CASE WHEN class_id = 0 THEN score END) AS mean_score FROM regions GROUP BY page HAVING count(*) = 1")
def single_regions(spark, d):
    grouped = V.regions(spark, d).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("score") >= 0).alias("good"), F.avg(F.when(F.col("class_id") == 0, F.col("score"))).alias("mean_score"))
    return grouped.where("n = 1").select("page", "good", "mean_score")


# --- jobs

_FOLD = """WITH RECURSIVE e AS (SELECT user_id % 50 AS job, ts, event_id, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'succeed' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'cancel' ELSE 'noop' END AS event FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS n FROM e), w AS (
  SELECT job, CAST(0 AS BIGINT) AS n, 'queued' AS state, 0 AS steps, 0 AS rejected FROM (SELECT DISTINCT job FROM e)
  UNION ALL
  SELECT o.job, o.n, CASE WHEN event = 'start' AND state = 'queued' THEN 'running' WHEN event = 'succeed' AND state = 'running' THEN 'succeeded' WHEN event = 'fail' AND state = 'running' THEN 'failed' WHEN event = 'cancel' AND state = 'queued' THEN 'cancelled' ELSE state END,
    steps + CASE WHEN (event IN ('start', 'cancel') AND state = 'queued') OR (event IN ('succeed', 'fail') AND state = 'running') THEN 1 ELSE 0 END,
    rejected + CASE WHEN (event IN ('start', 'cancel') AND state = 'queued') OR (event IN ('succeed', 'fail') AND state = 'running') THEN 0 ELSE 1 END
  FROM w JOIN o ON o.job = w.job AND o.n = w.n + 1)
SELECT job, arg_max(state, n) AS state, arg_max(steps, n) AS steps, arg_max(rejected, n) AS rejected FROM w GROUP BY job"""


def job_log(spark, d):
    kind = F.col("event_type")
    event = F.when(kind == "view", "start").when(kind == "click", "succeed").when(kind == "error", "fail").when(kind == "signup", "cancel").otherwise("noop")
    return V.table(spark, d, "events").select((F.col("user_id") % 50).alias("job"), "ts", "event_id", event.alias("event"))


@query(_FOLD)
def job_state(spark, d):
    return J.job_states(job_log(spark, d), job="job", at=["ts", "event_id"], event="event")


@query(f"WITH {V.JOBS}, n AS (SELECT max(queued) AS now FROM jobs) SELECT id, coalesce(finished + 600000 <= now, false) AS expired, greatest(coalesce(finished, now) - queued, 0) AS elapsed FROM jobs, n")
def job_ttl(spark, d):
    jobs = V.jobs(spark, d)
    now = jobs.agg(F.max("queued").alias("now")).scalar()
    none = F.lit(None).cast("long")
    return jobs.select("id", J.expired(F.col("finished"), 600_000, now).alias("expired"), J.elapsed(F.col("finished"), none, F.col("queued"), now).alias("elapsed"))


@query(f"""WITH RECURSIVE {V.JOBS}, r0 AS (SELECT *, state IN ('succeeded', 'failed', 'cancelled') AS done, coalesce(finished, queued) AS age FROM jobs
), r AS (SELECT *, done AND row_number() OVER (PARTITION BY owner, done ORDER BY age DESC, seq DESC) > 20 AS over_count FROM r0
), t AS (SELECT owner, sum(original_bytes + result_bytes) FILTER (WHERE NOT over_count) AS held FROM r GROUP BY owner
), d AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY age, seq) AS n FROM r WHERE done AND NOT over_count
), s AS (SELECT d.owner, id, n, original_bytes, result_bytes, held, coalesce(sum(original_bytes) OVER (PARTITION BY d.owner ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t USING (owner)
), p1 AS (SELECT *, original_bytes > 0 AND held - before > 2000 AS released FROM s
), u AS (SELECT owner, any_value(held) - sum(original_bytes) FILTER (WHERE released) AS after FROM p1 GROUP BY owner
), p2 AS (SELECT p1.*, coalesce(after, held) - coalesce(sum(result_bytes + CASE WHEN released THEN 0 ELSE original_bytes END) OVER (PARTITION BY p1.owner ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 2000 AS gone FROM p1 JOIN u USING (owner))
SELECT r.owner, r.id, CASE WHEN over_count THEN 'evict_count' WHEN gone THEN 'evict_bytes' WHEN released THEN 'release' ELSE 'keep' END AS action FROM r LEFT JOIN p2 ON r.owner = p2.owner AND r.id = p2.id""")
def retention_evict(spark, d):
    return J.retention(V.jobs(spark, d), owner="owner", max_jobs=20, max_bytes=2000).select("owner", "id", "action")


@query(f"WITH {V.JOBS} SELECT owner, kind, id, CAST(row_number() OVER (PARTITION BY owner, kind ORDER BY queued, seq) - 1 AS INTEGER) AS position FROM jobs WHERE state = 'queued'")
def queue_position(spark, d):
    return J.queue_positions(V.jobs(spark, d), queue=["owner", "kind"], at=["queued", "seq"]).select("owner", "kind", "id", "position")


@query(f"""WITH RECURSIVE {V.JOBS}, q AS (SELECT owner, id, kind, row_number() OVER (PARTITION BY owner, kind ORDER BY queued, seq) AS nth FROM jobs
), c AS (SELECT owner, count(*) FILTER (WHERE kind = 'text') AS nt, count(*) FILTER (WHERE kind = 'formula') AS nf FROM q GROUP BY owner
), w AS (SELECT owner, CAST(-1 AS BIGINT) AS served, '' AS kind, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS f, 0 AS st, 0 AS sf FROM c
  UNION ALL
  SELECT owner, served + 1, CASE WHEN x THEN 'text' ELSE 'formula' END, CASE WHEN x THEN t + 1 ELSE f + 1 END, t + x::INT, f + (NOT x)::INT,
    CASE WHEN st + x::INT >= 3 AND sf + (NOT x)::INT >= 1 THEN 0 ELSE st + x::INT END, CASE WHEN st + x::INT >= 3 AND sf + (NOT x)::INT >= 1 THEN 0 ELSE sf + (NOT x)::INT END
  FROM (SELECT w.*, w.t < c.nt AND (w.f >= c.nf OR w.st < 3) AS x FROM w JOIN c USING (owner) WHERE w.t + w.f < c.nt + c.nf)
) SELECT owner, id, CAST(served AS INTEGER) AS served FROM w JOIN q USING (owner, kind, nth)""")
def scheduler_replay(spark, d):
    return J.replay(V.jobs(spark, d), owner="owner", at=["queued", "seq"], job="id", kind="kind", text_quota=3, formula_quota=1)


_GATES = """CASE WHEN event_id % 10 = 0 THEN 'route' WHEN event_id % 9 = 0 THEN 'unauthorized' WHEN event_id % 8 = 0 THEN 'host' WHEN event_id % 7 = 0 THEN 'origin' WHEN event_id % 6 = 0 THEN 'busy'
  WHEN event_id % 500 > 400 THEN 'too_large' WHEN event_id % 450 > 400 THEN 'too_large' WHEN event_id % 450 < event_id % 500 THEN 'bad_request' ELSE 'admitted' END"""


@query(f"SELECT event_id, {_GATES} AS outcome FROM events")
def admission_gate(spark, d):
    i = F.col("event_id")
    gate = J.admission(i % 10 != 0, i % 9 != 0, i % 8 != 0, i % 7 != 0, i % 6 != 0, i % 450, i % 500, 400)
    return V.table(spark, d, "events").select("event_id", gate.alias("outcome"))


@query("WITH s AS (SELECT user_id, ts, event_id, floor(value) AS size, event_type AS part FROM events) SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'first_sight' WHEN lag(size) OVER w <> size THEN 'stat_changed' WHEN lag(part) OVER w <> part THEN 'content_changed' ELSE 'hit' END AS cause FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def digest_cause(spark, d):
    seen = V.table(spark, d, "events").select("user_id", "ts", "event_id", F.floor("value").alias("size"), F.col("event_type").alias("part"))
    return J.digest_causes(seen, path="user_id", at=["ts", "event_id"], size="size", partial="part").select("event_id", "cause")


@query("SELECT event_id, CAST(sum(event_id % 100) OVER w AS BIGINT) AS used, sum(event_id % 100) OVER w <= 2000 AS accepted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def byte_budget(spark, d):
    rows = V.table(spark, d, "events").withColumn("size", F.col("event_id") % 100)
    return J.within_budget(rows, owner="user_id", at=["ts", "event_id"], size="size", total=2000).select("event_id", "used", "accepted")


from pagelore.plans import more  # noqa: E402, F401  (it adds its queries to QUERIES and SQL)
