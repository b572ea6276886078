"""The queries op1 to op10, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm import bpe, langid, mpegts, packing, pii, quality, simhash, substrings, topk, warc
from pagelore.llm.common import id_hash_mod, table


def op1_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, F.col("vec_id") % 100 == 0, k=10, scale=1024).withColumn("rank", F.col("rank").cast("int"))


def op5_anchored_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=50, with_text=False, digests=True)


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_pages(warc.read_records(spark, archive))


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents")))


def op3_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=1)


def op9_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpegts.features(mpegts.store(table(spark, sf_dir, "documents")))


def op2_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), id_hash_mod(F.col("doc_id"), 3) == 1)


def op7_unigram_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_hash_mod(F.col("doc_id"), 4) == 2
    found = langid.identify(docs, ~held_out, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_kdtree_top_k, op2_quality_discriminant, op3_simhash_bk_trees, op4_sum_of_squares_packing, op5_anchored_repeats, op6_warc_archive, op7_unigram_language, op8_pii_spans, op9_transducer_bpe, op10_transport_stream)}

SQL: dict[str, str] = {}

SQL["op1_kdtree_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, {5 * k + 1}, 5) AS INTEGER) >> {s}) & 31) AS INTEGER) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0)
)
SQL["op6_warc_archive"] = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM f
"""

SQL["op5_anchored_repeats"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), n AS (
  SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n_words FROM d
), s AS (
  SELECT doc_id, unnest(range(1, n_words - 48)) AS p, w FROM n WHERE n_words >= 50
), h AS (
  SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS k FROM s
), f AS (
  SELECT k, min(doc_id) AS first_id FROM h GROUP BY k
), c AS (
  SELECT DISTINCT h.doc_id, unnest(range(h.p, h.p + 50)) AS p FROM h JOIN f ON h.k = f.k WHERE f.first_id < h.doc_id
), g AS (
  SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id
)
SELECT n.doc_id, n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM n LEFT JOIN g ON n.doc_id = g.doc_id
"""


def _pii_sql() -> str:
    """Matches and the text between them give the places, as in the operator; the plain patterns serve here."""
    patterns = {k: pii.BASE_PATTERNS.get(k, pii.PATTERNS[k]) for k in pii.KINDS}
    digits = "regexp_replace(z.m, '[^0-9]', '', 'g')"
    turned = "(substr(replace(z.m, ' ', ''), 5) || substr(replace(z.m, ' ', ''), 1, 4))"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr({digits}, length({digits}) - i + 1, 1) AS INTEGER) ELSE CAST(substr({digits}, length({digits}) - i + 1, 1) AS INTEGER) * 2 - CASE WHEN substr({digits}, length({digits}) - i + 1, 1) > '4' THEN 9 ELSE 0 END END)) % 10 = 0"
    mod97 = f"list_reduce(list_concat([0], list_transform(range(1, length({turned}) + 1), lambda i: CAST(strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({turned}, i, 1)) - 1 AS INTEGER))), lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1"
    passes = {
        "ip": "len(list_filter(string_split(z.m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"length(replace(z.m, ' ', '')) BETWEEN 15 AND 34 AND {mod97}",
    }
    around = f"(substr(x, greatest(z.s - {pii.WINDOW}, 0) + 1, z.s - greatest(z.s - {pii.WINDOW}, 0)) || ' ' || substr(x, z.e + 1, {pii.WINDOW}))"
    parts, columns = [], []
    for kind in pii.KINDS:
        found = f"regexp_extract_all(x, '{patterns[kind]}')"
        gaps = f"list_transform(string_split_regex(x, '{patterns[kind]}'), lambda g: length(g))"
        parts.append(f"{found} AS m_{kind}, {gaps} AS g_{kind}")
        start = f"list_sum(g_{kind}[1 : i]) + coalesce(list_sum(list_transform(m_{kind}[1 : i - 1], lambda y: length(y))), 0)"
        spans = f"list_transform(range(1, len(m_{kind}) + 1), lambda i: {{'s': CAST({start} AS BIGINT), 'e': CAST({start} + length(m_{kind}[i]) AS BIGINT), 'm': m_{kind}[i]}})"
        good = passes.get(kind, "true")
        if kind not in pii.BASE_KINDS:
            score = f"{pii.PRIOR[kind]} + CASE WHEN regexp_matches({around}, '{pii.FOR[kind]}') THEN {pii.BOOST} ELSE 0 END - CASE WHEN regexp_matches({around}, '{pii.AGAINST}') THEN {pii.CUT} ELSE 0 END"
            good += f" AND round(greatest(0, least(1, {score})), 4) >= 0.5"
        columns.append(f"list_transform(list_filter({spans}, lambda z: {good}), lambda z: '{kind}:' || z.s || ':' || z.e) AS {kind}")
    counts = ", ".join(f"CAST(len({kind}) AS BIGINT) AS n_{kind}" for kind in pii.BASE_KINDS)
    base = "list_concat(list_concat(email, ip), list_concat(card, phone))"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), f AS (SELECT doc_id, x, {', '.join(parts)} FROM t
), k AS (SELECT doc_id, {', '.join(columns)} FROM f)
SELECT doc_id, {counts}, sha256(array_to_string({base}, ',')) AS base_sha256, array_to_string(list_concat({base}, list_concat(iban, ssn)), ',') AS spans FROM k"""


SQL["op8_pii_spans"] = _pii_sql()
