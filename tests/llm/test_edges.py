"""Each operator and stage over nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import time
from pathlib import Path

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from pagelore.llm import bpe, langid, mpegts, packing, pii, quality, simhash, substrings, topk, warc

BASE = ["doc_id", "text", "lang", "source", "n_chars"]
CLASH = {"component_id": "x", "score": 1.5, "row": 3, "chunk": "c", "fp": None, "kind": 0, "start": 9, "ids": "i", "media": "m", "gone": 1}
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(k, T.StringType()) for k in CLASH]
)
LONG_WORD = "é" * 150_000
MANY_WORDS = " ".join(f"wort{i % 977}x{i % 31}" for i in range(60_000))
WORDS60 = " ".join(f"shared{i}" for i in range(60))


def rows():
    texts = [
        (1, "The cat sat on the mat and the dog ran."), (1, "The cat sat on the mat and the dog ran."), (2, None), (3, ""), (4, " \t\n\r\x0b "), (None, "no id here at all"),
        (None, None), (5, LONG_WORD), (6, MANY_WORDS), (7, WORDS60 + " tail one"), (8, "head " + WORDS60), (9, WORDS60), (10, "12345 $$$ !!! ###"), (11, "\u0000 control \U0001f600   line"),
        (12, "mail me: a@b.co or +49 30 1234567, card 4111 1111 1111 1111, host 10.0.0.1"), (13, "a a a a " * 50),
    ]
    return [(i, t, "en" if i and i % 3 else None, "s", len(t) if t else None, *map(str, CLASH.values())) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


WORD, PIECE, BYTES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")


def every(docs):
    labels = docs.sparkSession.createDataFrame([(1, 1), (6, 1), (10, 0), (13, 0), (None, 1), (7, None)], "doc_id long, quality int")
    return {
        "quality": quality.score_quality(docs, labels, F.col("doc_id") == 1),
        "near": simhash.near_duplicates(docs),
        "similar": simhash.similar_documents(docs),
        "pack": packing.pack(docs, WORD),
        "repeats": substrings.remove_repeats(docs, window=50, digests=True),
        "language": langid.identify(docs, F.lit(True), PIECE, rounds=1),
        "pii": pii.digest(pii.find_spans(docs)),
        "redact": pii.redact(docs),
        "tokens": bpe.token_digests(docs, BYTES, P.PATTERN),
        "media": mpegts.features(mpegts.store(docs)),
    }


def test_empty_tables(empty):
    for name, out in every(empty).items():
        assert out.count() == 0, name


def test_rows_in_rows_out(docs):
    n = len(rows())
    for name, out in every(docs).items():
        if name != "pack":
            assert out.count() == n, name


def test_packing_covers_every_id(docs):
    out = packing.pack(docs, WORD, with_ids=True).collect()
    sizes, at = {}, {}
    for r in out:
        assert r["length"] == len(r["ids"]) > 0
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert max(sizes.values()) <= 2048
    for pieces in at.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
    padding = sum(2048 - s for s in sizes.values() if s & (s - 1))
    assert padding == 0
    assert sum(sizes.values()) == sum(r["doc_tokens"] for r in out if r["start"] == 0)
    assert [r["length"] for r in out if r["doc_id"] == 3] == [1]


def test_tokens_round_trip(docs):
    for r, t in zip(bpe.token_digests(docs.orderBy("doc_id", "text"), BYTES, P.PATTERN).collect(), [r["text"] for r in docs.orderBy("doc_id", "text").collect()], strict=True):
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decoded(bpe.encoded(docs, BYTES, P.PATTERN), BYTES, P.PATTERN)
    assert sorted((r["text"] for r in back.collect())) == sorted((t or "") for _, t, *_ in rows())


def test_repeats_keep_columns_and_first_copy(docs):
    out = substrings.remove_repeats(docs, window=50)
    assert out.columns == [*docs.columns, "n_words", "n_removed"]
    got = by_id(out)
    assert (got[7]["n_removed"], got[8]["n_removed"], got[9]["n_removed"]) == (0, 60, 60)
    assert got[8]["text"] == "head" and got[9]["text"] == "" and got[7]["text"] == WORDS60 + " tail one"
    assert got[2]["n_words"] == 0 and got[2]["text"] is None and got[13]["n_removed"] == 0
    assert got[6]["component_id"] == "x"


def test_repeats_of_one_row_stand_as_one(spark):
    """A third of all rows are one row; others repeat an id with other texts, or have no id."""
    texts = [(7, WORDS60 + " tail", k) for k in range(40)] + [(3, WORDS60, 100), (9, WORDS60, 101), (9, "other", 102), (9, "other", 103), (None, WORDS60, 104), (None, WORDS60, 105), (None, None, 106), (None, None, 107)]
    docs = spark.createDataFrame([(i, t, k, "x") for i, t, k in texts], "doc_id long, text string, nth int, `repeat key` string").repartition(4)
    out = substrings.remove_repeats(docs, window=50, digests=True)
    assert out.columns == [*docs.columns, "n_words", "n_removed", "kept_sha256"]
    got = {r["nth"]: (r["doc_id"], r["text"], r["n_words"], r["n_removed"], r["repeat key"]) for r in out.collect()}
    assert len(got) == len(texts)
    for i, t, k in texts:
        want = {7: ("tail", 61, 60), 3: (WORDS60, 60, 0), None: (t, 60 if t else 0, 0)}.get(i) or (("", 60, 60) if k == 101 else ("other", 1, 0))
        assert got[k] == (i, *want, "x")
    slim = substrings.remove_repeats(docs, window=50, with_text=False)
    assert slim.columns == ["doc_id", "n_words", "n_removed"] and slim.count() == len(texts)


def test_near_duplicates_defined(docs):
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert {c for i, _, c in got if i in (2, 3, 4)} == {2} and {f for i, f, _ in got if i in (2, 3, 4)} == {0}
    assert [c for i, _, c in got if i is None] == [None, None] and [c for i, _, c in got if i == 1] == [1, 1]


def test_one_of_each(docs):
    found = simhash.similar_documents(docs)
    left = [r["doc_id"] for r in simhash.one_of_each(docs, found).collect()]
    assert sorted(i for i in left if i is not None) == [1, 2, 5, 6, 7, 10, 11, 12, 13]  # 8 and 9 repeat 7
    assert left.count(1) == 1 and left.count(None) == 2 and 3 not in left


def test_language_undecided(docs):
    got = by_id(langid.identify(docs, F.lit(True), PIECE, rounds=1))
    assert {got[i]["lang_pred"] for i in (2, 3, 4, 10)} == {"und"} and got[6]["lang_pred"] == "en"
    nothing = langid.identify(docs, F.lit(False), PIECE)
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_quality_defined(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_quality(docs, none, F.lit(False)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert min(r["score"] for r in quality.score_quality(docs, one, F.lit(False)).collect()) > 0.99


def test_pii_and_redaction(docs):
    got = by_id(pii.digest(pii.find_spans(docs)))
    r = got[12]
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1) and got[2]["spans"] == ""
    clean = by_id(pii.redact(docs))
    assert clean[12]["text"] == "mail me: [EMAIL] or [PHONE], card [CARD], host [IP]"
    assert clean[2]["text"] is None and clean[11]["text"] == rows()[13][1] and clean[12]["score"] == "1.5"


def test_media_defined(docs):
    got = by_id(mpegts.features(mpegts.store(docs)))
    assert got[2]["payload_bytes"] == 64 and got[2]["n_bytes"] == 0 and got[2]["media_sha256"] == got[3]["media_sha256"]


def test_stages(spark, docs, empty):
    for start in (docs, empty):
        now = start
        for _name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, "")
            assert out.columns == start.columns
            now = corpus_pipeline.written(out, "stage")
        corpus_pipeline.STAGES[-1][1](spark, now, "").count()


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [2.0]), (200, [1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.exact_top_k(df, F.col("vec_id") % 100 == 0, k=2).collect()}
    assert got == {(0, 1): (1, 1 << 20), (0, 2): (2, 1 << 20), (100, 1): (0, 1 << 19), (100, 2): (1, 1 << 19), (200, 1): (7, 1 << 21)}
    assert topk.exact_top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    none = spark.createDataFrame([(0, []), (3, []), (2, []), (100, [1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.exact_top_k(none, F.col("vec_id") % 100 == 0, k=1).collect())) == [(0, 1, 2, 0)]
    big = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [3.0, 2.0**30])], "vec_id long, embedding array<double>")
    assert topk.exact_top_k(big, F.col("vec_id") == 0, scale=1).first()["score"] == 3 * 2**40 + 2**30


def test_warc_edges(spark):
    rows = [(3, "http://a/\r\nx", "same"), (1, None, "same"), (1, None, "same"), (2, "u", None), (4, "u", ""), (None, "n", "same"), (5, "v", "é" * 100_000)]
    pages = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, sha256 int")
    archive = warc.write_archive(pages)
    got = sorted(((r["page_id"] or -1), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_pages(warc.read_records(spark, archive)).collect())
    assert got == [(-1, "response", None, 4), (1, "response", None, 4), (1, "response", None, 4), (2, "response", None, 0), (3, "revisit", 1, 4), (4, "revisit", 2, 0), (5, "response", None, 200_000)]
    stored = [r["payload"] for r in warc.verified_payloads(spark, archive).collect()]
    assert len(stored) == len({bytes(p) for p in stored}) == 3
    records = {(r["page_id"] or -1): bytes(r["record"]) for r in warc.read_records(spark, archive).collect()}
    assert records[5].endswith(("\r\n\r\n" + "é" * 100_000 + "\r\n\r\n").encode()) and b"WARC-Refers-To: <urn:page:1>" in records[3] and records[3].endswith(b"\r\n\r\n\r\n\r\n")
    assert warc.read_pages(warc.read_records(spark, warc.write_archive(pages.limit(0)))).count() == 0
    few = warc.describe(pages, min_bytes=1).where("page_id in (2, 4)")
    assert {r["record_type"] for r in few.collect()} == {"response"}


def test_archives_leave_no_shuffle_files(spark):
    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "repeat(sha2(string(id % 300), 256), 20) AS html")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {str(f) for folder in folders for f in Path(folder).rglob("shuffle_*.data")}
    before, setting = shuffled(), spark.conf.get(key)
    archive = warc.write_archive(pages)
    until = time.monotonic() + 5
    while (left := shuffled() - before) and time.monotonic() < until:  # files go in the background
        time.sleep(0.1)
    assert not left and spark.conf.get(key) == setting
    got = warc.read_pages(warc.read_records(spark, archive))
    for _ in range(2):
        assert {tuple(r) for r in got.select("page_id", "record_type", "refers_to", "payload_bytes").collect()} == {(i, "revisit", i - 300, 1280) if i >= 300 else (i, "response", None, 1280) for i in range(400)}


def test_spoiled_archives_are_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "one"), (2, "u", "one"), (3, "u", "three")], "page_id long, url string, html string")
    good = warc.write_archive(pages, path=str(tmp_path / "good"))
    stored = spark.read.parquet(good.payloads)
    for name, payload in (("payloads", F.when(F.col("payload") == F.lit(b"one"), F.lit(b"two")).otherwise(F.col("payload"))), ("headers", None)):
        bad = warc.Archive(good.headers, str(tmp_path / "bad")) if payload is not None else warc.Archive(str(tmp_path / "other"), good.payloads)
        if payload is not None:
            stored.withColumn("payload", payload).write.parquet(bad.payloads)
        else:
            text = F.replace(F.decode("header", "UTF-8"), F.lit("Content-Length: 5"), F.lit("Content-Length: 4"))
            spark.read.parquet(good.headers).withColumn("header", F.encode(text, "UTF-8")).write.parquet(bad.headers)
        with pytest.raises(Exception, match="digest|disagrees"):
            warc.read_pages(warc.read_records(spark, bad)).collect()


def test_one_of_each_decides_by_row(spark):
    one, two, three, four = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    texts = [(1, one), (5, one), (5, two), (5, two), (7, three), (7, four), (7, four + " end"), (9, four), (None, one)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, nth int").repartition(3)
    left = simhash.one_of_each(docs, simhash.similar_documents(docs))
    assert left.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"]) for r in left.collect())
    assert got == sorted([(0, one), (1, one), (5, two), (7, three), (7, four)])
