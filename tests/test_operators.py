"""Operators on small hand-made pages, datasets on files, jobs as folds and as streams."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.operators import evaluate as E
from pagelore.operators import filters as L
from pagelore.operators import folds as D
from pagelore.operators import order as O
from pagelore.operators import registry as M
from pagelore.operators import render as R
from pagelore.operators import requests as Q
from pagelore.sources import datasets, images
from pagelore.streaming import jobs as J

BOX = "page long, rid long, x0 double, y0 double, x1 double, y1 double, score double, text string"


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, r[:4]), r[4], r[5] if len(r) > 5 else "t") for i, r in enumerate(rows)], BOX)


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_reading_order_of_columns(spark):
    rows = [(0, 0, 40, 10, 1.0), (60, 0, 100, 10, 1.0), (0, 12, 40, 22, 1.0), (60, 12, 100, 22, 1.0), (0, 60, 100, 70, 1.0)]
    got = O.reading_order(boxes(spark, rows), page="page", rid="rid").orderBy("grp", "place").collect()
    assert [r.rid for r in got] == [0, 2, 1, 3, 4]


def test_reading_order_without_boxes_and_overlaps(spark):
    df = boxes(spark, [(0, 0, 10, 10, 1.0), (8, 4, 20, 14, 1.0), (0, 9, 6, 19, 1.0)]).unionByName(spark.createDataFrame([(1, 9, None, None, None, None, 1.0, "t")], BOX))
    got = O.reading_order(df, page="page", rid="rid").orderBy("grp", "place").collect()
    assert [(r.grp, r.rid) for r in got] == [(0, 0), (0, 2), (0, 1), (1, 9)]
    many = [(i, 0.0, float(3 * i), 1.0, float(3 * i + 1)) for i in range(3000)]
    assert O.reading_groups_of(many) == [[i] for i in range(3000)]


def test_lines_agree(spark, data):
    """cluster_lines, a fold in the JVM, and the lines of the reading order say the same."""
    rows = boxes(spark, [(0, 0, 9, 10, 1.0), (5, 3, 30, 12, 1.0), (2, 8, 20, 20, 1.0), (1, 11, 3, 30, 1.0), (0, 0, 1, 31, 1.0)])
    got = O._lines([(r.rid, r.x0, r.y0, r.x1, r.y1) for r in rows.collect()])
    lines = {}
    for r in D.cluster_lines(rows, page="page", rid="rid").collect():
        lines.setdefault(r.line, {})[r.place] = r.rid
    assert [[lines[k][p] for p in sorted(lines[k])] for k in sorted(lines)] == got


def test_suppression(spark):
    df = boxes(spark, [(0, 0, 10, 10, 0.9), (0, 0, 10, 10, 0.8), (0, 0, 10, 5, 0.7), (50, 50, 60, 60, 0.1)])
    assert ids(D.suppress_overlaps(df, page="page", rid="rid", threshold=0.5), "rid") == [(0,), (2,), (3,)]
    assert ids(D.suppress_overlaps(df, page="page", rid="rid", threshold=0.4, limit=1), "rid") == [(0,)]
    other = df.withColumn("k", F.col("rid"))
    assert len(ids(D.suppress_overlaps(other, page="page", rid="rid", threshold=0.1, class_id="k"), "rid")) == 4


def test_routing(spark):
    rows = [(10, 10, 50, 50, 0.9), (12, 12, 40, 40, 0.8), (60, 60, 62, 61, 0.95), (200, 200, 210, 210, 0.9), (70, 70, 90, 90, 0.3)]
    df = boxes(spark, rows).withColumn("detected", F.col("rid") != 4)
    args = {"page": "page", "rid": "rid", "width": F.lit(100), "height": F.lit(100), "threshold": 0.7}
    assert ids(D.route_regions(df, min_area_ratio=0.01, max_regions=9, **args), "rid") == [(0,), (4,)]
    assert ids(D.route_regions(df, min_area_ratio=0.0, max_regions=1, **args), "rid") == [(2,)]
    with pytest.raises(ValueError):
        D.route_regions(df, min_area_ratio=0.0, max_regions=0, **args)


def test_matching_takes_second_choices(spark):
    pairs = spark.createDataFrame([(1, 0, 0, 0.9), (1, 0, 1, 0.8), (1, 1, 0, 0.7), (1, 1, 1, 0.5), (1, 2, 1, 0.5)], "page long, e long, p long, iou double")
    assert ids(D.match_one_to_one(pairs, page="page"), "e", "p") == [(0, 0), (1, 1)]


def test_deduplication(spark):
    df = boxes(spark, [(0, 0, 10, 10, 0.5, "a"), (0, 0, 10, 10, 0.9, "a"), (0, 0, 10, 10, 0.4, "b"), (50, 0, 60, 10, 0.1, "a"), (0, 0, 10, 10, 0.7, "a")])
    assert ids(D.deduplicate(df, page="page", rid="rid", text="text"), "rid", "score") == [(1, 0.9), (2, 0.4), (3, 0.1)]


def test_decoding(spark):
    frames = [(1, t, k, 0.5, c) for t, (k, c) in enumerate([(0, ""), (1, "a"), (1, "a"), (0, ""), (1, "a"), (2, "b")])] + [(2, 0, 0, 0.9, "")]
    df = spark.createDataFrame(frames, "line long, t long, token int, prob double, letter string")
    assert ids(O.ctc_decode(df, line="line", at=["t"], token="token", prob="prob", letter=F.col("letter")), "line", "text", "score") == [(1, "aab", 0.5), (2, "", 0.0)]
    rows = spark.createDataFrame([([0, 82, 1769, 2, 1, 1],), ([0, 82],), ([],)], "t array<bigint>").select(O.eos_prefix(F.col("t")).alias("e")).collect()
    assert [(r.e.prefix, r.e.eos_index, r.e.truncated) for r in rows] == [([0, 82, 1769, 2], 3, False), ([0, 82], None, True), ([], None, True)]
    vocab = F.create_map(*[F.lit(x).cast("long") if i % 2 == 0 else F.lit(x) for i, x in enumerate([0, "<s>", 2, "</s>", 5, "Ġx", 6, "y"])])
    text = datasets.decode_tokens(spark.createDataFrame([([0, 5, 6, 2, 6],)], "t array<bigint>"), "t", vocab).first()
    assert (text.text, text.eos_index, text.truncated) == ("xy", 3, False)
    assert O.word_islands_of("ab 中c", [True] * 5) == [("ab", [0, 1], "en"), ("中", [3], "cn"), ("c", [4], "en")]
    assert [w for w, _, _ in O.word_islands_of("ab", [True, *[False] * 6, True])] == ["a", "b"]


def test_tiles(spark):
    df = spark.createDataFrame([(100, 50), (40, 10)], "w int, h int")
    got = O.tiles(df, width=F.col("w"), height=F.col("h"), tile=60, overlap=10)
    assert ids(got.where("w = 100"), "tx", "ty", "tw", "th") == [(0, 0, 60, 50), (50, 0, 50, 50)] and got.where("w = 40").count() == 1
    with pytest.raises(ValueError):
        O.tiles(df, width=F.col("w"), height=F.col("h"), tile=10, overlap=10)


def test_markdown(spark):
    df = boxes(spark, [(0, 0, 10, 10, 1.0, "a"), (20, 2, 30, 11, 1.0, "b"), (0, 12, 9, 22, 1.0, "c"), (0, 40, 9, 50, 1.0, "d")])
    assert R.visual_lines(df, page="page", rid="rid", text="text").first()["markdown"] == "a   b\nc\n\nd"
    shown = df.withColumns({"grp": F.col("rid"), "place": F.lit(0), "latex": F.when(F.col("rid") == 2, "x^2"), "truncated": F.lit(False)})
    assert R.reading_markdown(shown, page="page", at=["grp", "place"]).first()["markdown"] == "a\nb\n$$\nx^2\n$$\n\nd"
    html = R.html_report(df.withColumn("text", F.lit("<b>")), page="page", rid="rid", title=F.lit("p&q"), width=F.lit(60), height=F.lit(60)).first()["html"]
    assert html.count("<rect") == 4 and "&lt;b&gt;" in html and "p&amp;q" in html


def test_summaries(spark):
    rows = [("none", True, True, 0.0, False), ("model_mismatch", False, True, 0.5, True), ("empty_ground_truth", False, False, 1.0, None), ("inference", False, False, 1.0, None)]
    df = spark.createDataFrame(rows, "failure string, exact boolean, normalized boolean, cer double, truncated boolean")
    r = E.summarize(df, []).first()
    assert (r.total, r.scored, r.pipeline_failures, r.exact_match_rate, r.normalized_match_rate, r.mean_cer, r.truncated) == (4, 2, 1, 0.5, 1.0, 0.25, 1)
    none = E.summarize(df.limit(0), []).first()
    assert (none.total, none.exact_match_rate, none.mean_cer) == (0, 0.0, 0.0)


def test_shards(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("z", 4)], "path string, v int")
    manifest = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "path string, position int")
    assert ids(E.shard_problems(rows, manifest, key="path"), "path", "problem") == [("b", "duplicate"), ("c", "gap"), ("z", "unknown")]
    with pytest.raises(ValueError):
        E.merge_shards(rows, manifest, key="path")


def test_violations_and_registry(spark):
    quad = [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0), (0.0, 5.0)]
    rows = [(1, "formula", "t", None, 0.5, None), (2, "text", None, "x", 1.5, quad), (3, "text", "t", None, 1.0, quad), (4, "text", "t", None, None, [(9.0, 9.0)] * 4)]
    df = spark.createDataFrame(rows, "id int, kind string, text string, latex string, score double, polygon array<struct<x:double,y:double>>")
    got = L.violations(df, L.region_rules(F.lit(6), F.lit(6)))
    assert ids(got, "id", "violations") == [(1, "formula without outcome,formula with text"), (2, "text with formula,score"), (4, "polygon")]
    with pytest.raises(Exception, match="bad row"):
        L.require(df, F.col("id") < 4, "bad row").collect()
    files = spark.createDataFrame([(True, 5, 5, "AB", "ab"), (True, 5, 6, None, "x"), (False, 5, None, "", None), (True, None, 9, " ", "x")], "e boolean, want long, size long, wd string, d string")
    assert [r.s for r in files.select(M.file_state(*(F.col(c) for c in files.columns)).alias("s")).collect()] == ["present", "corrupt", "missing", "present"]
    blobs = spark.createDataFrame([(bytearray(b"\x08\x07x"),), (bytearray(b"PK"),)], "c binary").select(M.looks_like_model(F.col("c")).alias("m"), M.partial_digest(F.col("c")).alias("p")).collect()
    assert [b.m for b in blobs] == [True, False] and blobs[0].p.head == blobs[0].p.tail


def test_requests():
    Q.Request(formulas=Q.Formulas(True, "m")).check()
    Q.EngineSettings.from_dict({"batch": 8})
    bad = [Q.Request(stages=Q.Stages(False, False, False)), Q.Request(words=True, stages=Q.Stages(recognition=False)), Q.Request(max_side=0), Q.Request(text_score=1.5), Q.Request(tiles=Q.Tiles(10, 10, 10)), Q.Request(formulas=Q.Formulas(True)), Q.Request(roi=(0, 0, 1, 1), formulas=Q.Formulas(True, "m")), Q.Request(scale_hint=float("nan"))]
    for request in bad:
        with pytest.raises(ValueError):
            request.check()
    for values in ({"nothing": 1}, {"min_side": 5000}, {"text_score": 2.0}, {"line_shape": (1, 2, 3)}):
        with pytest.raises(ValueError):
            Q.EngineSettings.from_dict(values)
    assert Q.decide_provider("gpu", False, False).fell_back and Q.Threads.plan(True, budget=16).pool == 4
    with pytest.raises(ValueError):
        Q.require_requested(Q.decide_provider("gpu", False, False))
    Q.check_formula_model([Q.Tensor("x", "float32", (None, 1, 384, 384))], [Q.Tensor("y", "int64", (None, None))])
    with pytest.raises(ValueError):
        Q.check_formula_model([Q.Tensor("x", "float32", (None, 1, 224, 224))], [Q.Tensor("y", "int64", (None, None))])


def png(image: np.ndarray, filters=None) -> bytes:
    h, w, n = image.shape
    rows, above = b"", np.zeros(w * n, int)
    for y in range(h):
        row, kind = image[y].ravel().astype(int), (filters or [0])[y % len(filters or [0])]
        left, corner = np.concatenate([np.zeros(n, int), row[:-n]]), np.concatenate([np.zeros(n, int), above[:-n]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        rows += bytes([kind]) + ((row - [0, left, above, (left + above) // 2, paeth][kind]) & 255).astype(np.uint8).tobytes()
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    rng = np.random.default_rng(1)
    for n in (1, 3, 4):
        image = rng.integers(0, 256, (7, 5, n), dtype=np.uint8)
        assert (images.decode(png(image, [0, 1, 2, 3, 4])) == image).all()
    picture = png(rng.integers(0, 256, (7, 5, 3), dtype=np.uint8))
    (tmp_path / "a.PNG").write_bytes(picture)
    (tmp_path / "b.txt").write_bytes(b"x")
    (tmp_path / "c.png").write_bytes(bytes(5000))
    files = images.image_files(spark, str(tmp_path), max_bytes=4000)
    sized = images.with_dimensions(files, 35)
    assert [(r.w, r.h) for r in sized.collect()] == [(5, 7)] and images.with_dimensions(files, 34).count() == 0
    assert images.decoded(files).first()["channels"] == 3
    gif, bmp = b"GIF89a" + struct.pack("<HH", 3, 4), b"BM" + bytes(16) + struct.pack("<ii", 6, -7)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 9, 8) + bytes(10)
    assert [images.dimensions_of(x) for x in (gif, bmp, jpeg, b"")] == [(3, 4), (6, 7), (8, 9), None]
    exif = b"\xff\xd8Exif\0\0II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x06\0\0\0"
    assert images.orientation_of(exif) == 6 and images.orientation_of(b"") is None


def test_datasets(spark, tmp_path):
    (tmp_path / "labels").write_text("zero\none\r\n\nthree")
    (tmp_path / "list").write_text("a.png 3\n\nb c.png 1\n")
    got = datasets.load_indexed_labels(spark, str(tmp_path / "list"), str(tmp_path / "labels"), dataset="d", split="test")
    assert ids(got, "relative_path", "ground_truth") == [("a.png", "three"), ("b c.png", "one")]
    (tmp_path / "bad").write_text("a.png 9\n")
    with pytest.raises(Exception, match="no such label"):
        datasets.load_indexed_labels(spark, str(tmp_path / "bad"), str(tmp_path / "labels"), dataset="d", split="test").collect()
    (tmp_path / "tabs").write_text("x/1.png\t a b \n\n../2.png\tc\n")
    with pytest.raises(Exception, match="bad path"):
        datasets.load_tab_separated(spark, str(tmp_path / "tabs"), dataset="d", split="train").collect()
    (tmp_path / "imgs").mkdir()
    for k in (3, 0):
        (tmp_path / "imgs" / f"{k:04d}.png").write_bytes(b"x")
    assert [r.ground_truth for r in datasets.load_numbered_images(spark, str(tmp_path / "imgs"), str(tmp_path / "labels"), dataset="u").collect()] == ["zero", "three"]
    (tmp_path / "cases.json").write_text(json.dumps([{"image": "a", "text": "t"}, {"image": "b", "text": "u", "boxes": [[[0, 0], [1, 0], [1, 1], [0, 1]]]}]))
    assert [len(r.boxes) for r in datasets.load_cases(spark, str(tmp_path / "cases.json"), 2).collect()] == [0, 1]
    with pytest.raises(ValueError):
        datasets.load_cases(spark, str(tmp_path / "cases.json"), 1)
    (tmp_path / "dict").write_text("a\n \n b \n")
    assert ids(datasets.load_dictionary(spark, str(tmp_path / "dict")), "index", "letter") == [(1, "a"), (2, "b")]
    manifest = {"schema_version": 1, "id": "m", "files": [{"name": "x.onnx", "role": "detector", "sha256": "0" * 64}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    assert datasets.load_model_manifest(spark, str(tmp_path / "m.json")).first()["name"] == "x.onnx"
    (tmp_path / "m2.json").write_text(json.dumps(manifest | {"schema_version": 2}))
    with pytest.raises(Exception, match="version"):
        datasets.load_model_manifest(spark, str(tmp_path / "m2.json")).collect()
    raw = json.dumps({"fast_tokenizer_file": {"model": {"vocab": {"<s>": 0, "<pad>": 1, "</s>": 2, "<unk>": 3, "x": 4}}, "added_tokens": []}})
    meta = datasets.tokenizer_metadata(spark.createDataFrame([(raw,), ("{}",)], "j string"), "j").collect()
    assert [(m.vocab_size, m.valid) for m in meta] == [(5, True), (0, False)]
    assert "| 1 | - |" in datasets.markdown_table(spark.createDataFrame([(1, None)], "a int, b int"), ["a", "b"], ["a"]).first()["table"]


def test_retention(spark):
    rows = [(1, i, "succeeded", 10 + i, i, i, 40, 10) for i in range(4)] + [(1, 9, "running", None, 0, 9, 500, 0)]
    df = spark.createDataFrame(rows, "owner long, id long, state string, finished long, queued long, seq long, original_bytes long, result_bytes long")
    act = lambda most, size: {r.id: r.action for r in J.retention(df, owner="owner", max_jobs=most, max_bytes=size).collect()}
    assert act(3, 10_000) == {0: "evict_count", 1: "keep", 2: "keep", 3: "keep", 9: "keep"}
    assert act(9, 620) == {0: "release", 1: "release", 2: "keep", 3: "keep", 9: "keep"}
    assert act(9, 525) == {0: "evict_bytes", 1: "evict_bytes", 2: "release", 3: "release", 9: "keep"}


def test_replay_and_gates(spark):
    rows = [(1, f"t{i}", i, "text") for i in range(7)] + [(1, f"f{i}", i, "formula") for i in range(2)]
    df = spark.createDataFrame(rows, "owner long, id string, at long, kind string")
    got = [r.id for r in J.replay(df, owner="owner", at=["at"], job="id", kind="kind", text_quota=3, formula_quota=1).orderBy("served").collect()]
    assert got == ["t0", "t1", "t2", "f0", "t3", "t4", "t5", "f1", "t6"]
    states = spark.createDataFrame([(s,) for s in ("ready", "blocked", "loading", "rebuilding", "failed")], "s string")
    assert [r.v for r in states.select(J.engine_admission(F.col("s")).alias("v")).collect()] == ["run", "models_missing", "queue", "queue", "unavailable"]


def test_stream_says_what_the_fold_says(spark, tmp_path):
    events = ["start", "succeed", "fail", "cancel"]
    log = spark.createDataFrame([(i % 5, i, events[(i * 7 + i // 5) % 4]) for i in range(60)], "job long, seq long, event string")
    fold = {(str(r.job), r.state, r.steps, r.rejected) for r in J.job_states(log, job="job", at=["seq"], event="event").collect()}
    for part in range(3):
        log.where(F.col("seq").between(part * 20, part * 20 + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    run = J.job_states_stream(stream, job="job", event="event").writeStream.outputMode("update").format("memory").queryName("job_states").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = {}
    for r in spark.sql("SELECT * FROM job_states").collect():
        if r.job not in last or r.steps + r.rejected > last[r.job][2] + last[r.job][3]:
            last[r.job] = (r.job, r.state, r.steps, r.rejected)
    assert set(last.values()) == fold


def test_result_cache_stream(spark, tmp_path):
    rows = spark.createDataFrame([("o", "a", 5, 0), ("o", "a", 1, 1), ("o", "b", 9, 2), ("o", "c", 4, 3), ("o", "d", 1, 4)], "owner string, id string, bytes long, seq long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = J.result_cache_stream(stream, owner="owner", most=2, max_bytes=10).writeStream.outputMode("update").format("memory").queryName("cache").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [r.accepted for r in spark.sql("SELECT * FROM cache").collect()] == [True, False, False, True, False]
