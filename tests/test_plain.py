"""Queries and operators that SQL can't express, or not at every size, against plain versions."""

import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.functions import pixels as P
from pagelore.functions import sizing as Z
from pagelore.functions import stats as S
from pagelore.functions import text as X
from pagelore.operators import detect as T
from pagelore.operators import registry as M
from pagelore.operators import requests as Q
from pagelore.plans import derive as V
from pagelore.plans.catalogue import QUERIES


def gap(spans):
    """The widest stretch that no span touches, the first of equals, by trying every pair of ends."""
    best = None
    for _, end in spans:
        after = [a for a, _ in spans if a > end]
        if after and not any(a <= end < b or (a <= end and b > end) for a, b in spans):
            start = min(after)
            if best is None or start - end > best[1] - best[0] or (start - end == best[1] - best[0] and end < best[0]):
                best = (end, start)
    return best


def lines_of(boxes):
    """Boxes from the top join the line that they overlap most, by half of the lesser height at least."""
    lines = []
    for b in sorted(boxes, key=lambda b: (b[2], b[1], b[0])):
        fits = []
        for k, line in enumerate(lines):
            top, low = min(x[2] for x in line), max(x[4] for x in line)
            common = max(0.0, min(low, b[4]) - max(top, b[2]))
            if common >= 0.5 * max(min(low - top, b[4] - b[2]), 0.0001):
                fits.append((-common, k))
        if fits:
            lines[min(fits)[1]].append(b)
        else:
            lines.append([b])
    order = sorted(lines, key=lambda line: (min(x[2] for x in line), min(x[1] for x in line)))
    return [[b[0] for b in sorted(line, key=lambda b: (b[1], b[2], b[0]))] for line in order]


def groups_of(boxes):
    """The recursion as it is told: section breaks, then columns, then rows, then lines."""
    if len(boxes) < 2:
        return [[b[0]] for b in boxes]
    heights = sorted(b[4] - b[2] for b in boxes if b[4] > b[2])
    median = heights[len(heights) // 2] if heights else 1.0
    for low, high, least in ((2, 4, 1.5 * median), (1, 3, max(0.5 * median, 2.0)), (2, 4, 1.0)):
        found = gap([(b[low], b[high]) for b in boxes])
        if found and found[1] - found[0] >= least:
            middle = sum(found) / 2
            before, after = [b for b in boxes if b[high] <= middle], [b for b in boxes if b[low] >= middle]
            if before and after and len(before) + len(after) == len(boxes):
                return groups_of(before) + groups_of(after)
    return lines_of(boxes)


@pytest.fixture(scope="module")
def pages(spark, data):
    out = {}
    for r in V.regions(spark, data).collect():
        out.setdefault(r["page"], []).append(r)
    return out


def test_reading_order_of_every_page(spark, data, pages):
    got = {}
    for r in QUERIES["reading_order"](spark, data).collect():
        got.setdefault(r["page"], []).append((r["grp"], r["place"], r["rid"]))
    assert got.keys() == pages.keys()
    for page, rows in pages.items():
        want = groups_of([(r["rid"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows])
        assert sorted(got[page]) == [(g, p, rid) for g, ids in enumerate(want) for p, rid in enumerate(ids)]


def test_reading_markdown_of_every_page(spark, data, pages):
    got = {r["page"]: r["markdown"] for r in QUERIES["reading_markdown"](spark, data).collect()}
    assert got.keys() == pages.keys()
    for page, rows in pages.items():
        at = {r["rid"]: r for r in rows}
        blocks, last = [], None
        for ids in groups_of([(r["rid"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows]):
            own, formula = [], False
            for rid in ids:
                r = at[rid]
                if r["class_id"] == 2:
                    formula = True
                    own.append(f"$$\nx^{r['text']}\n$$" + "\n\n<!-- formula truncated: no EOS token -->" * (r["score"] > 0.08))
                else:
                    own.append(r["text"])
            top, low = min(at[i]["y0"] for i in ids), max(at[i]["y1"] for i in ids)
            blank = last is not None and top - last[1] > 0.7 * min(low - top, last[1] - last[0])
            blocks.append("\n" * blank + ("\n" if formula else "   ").join(own))
            last = (top, low)
        assert got[page] == "\n".join(blocks)


def test_latex_repair_of_every_document(spark, data):
    """Where \\left and \\right pair at one depth, only the other steps act; they are done here by hand."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["latex"] for r in QUERIES["latex_repair"](spark, data).collect()}
    table = {ord(k): v for k, v in {**X.c1_pairs(), **X.LIGATURES, **X.width_pairs(), **dict.fromkeys(X.SINGLE_QUOTES, "'"), **dict.fromkeys(X.DOUBLE_QUOTES, '"')}.items()}
    checked = 0
    for i, text in texts.items():
        if set(text) & set("\\{}"):
            continue
        body = text.replace('"', "")
        plain = (
            rf"{{\alpha}} \left( {{{body} \right) }} \uparrow \begin{{matrix}} x \end{{matrix}}",  # a pair outside of all groups stays where it is
            rf"{{\left( {{{body}  }} y }} z\right)",  # seven characters go to where the group ended, counted before they were taken out
            rf"\begin{{cases}} \begin{{array}}{{ll}} ( {{ {body} ) \alpha \uplus \end{{array}} \end{{cases}}",
        )[i % 3]
        plain = re.sub("\r\n|[\r  \u0085]", "\n", re.sub("\x1b\\[[0-9;]*[a-zA-Z]", "", plain).translate(table))
        assert got[i] == re.sub(X.CONTROLS, "", unicodedata.normalize("NFC", plain))
        checked += 1
    assert checked > 150


def test_ranks_and_quantiles_of_large_groups(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.normal(size=30_000), "b": np.repeat([1.0, 2.0, 5.0], [12_000, 5_000, 4_000]), "c": rng.integers(0, 50, 300).astype(float), "d": np.array([7.0]), None: rng.random(11_000)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in S.quantiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0, "p100": 1.0}).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert np.allclose([got[k][n] for n in ("p50", "p95", "p0", "p100")], np.quantile(vs, [0.5, 0.95, 0, 1]), rtol=0, atol=1e-12)
    ranked = {r["g"]: r for r in S.ranked_from_histogram(df, "g", "v").collect()}
    for k, vs in values.items():
        n = len(vs)
        assert (ranked[k]["n"], ranked[k]["p50"], ranked[k]["p90"]) == (n, sorted(vs)[(n - 1) // 2], sorted(vs)[int((n - 1) * 0.9 + 0.5)])
    whole = {r["g"]: r for r in S.grouped_stats(df, ["g"], "v").collect()}
    assert (whole["e"]["n"], whole["e"]["p50"], whole["e"]["stddev"]) == (0, 0.0, 0.0) and whole["d"]["stddev"] == 0.0


def test_dear_values_are_computed_once(spark, data):
    out = QUERIES["summary_by_role"](spark, data)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("levenshtein") == 1 and "ReusedExchange" in final


def test_anchors_that_hold_no_box(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, 10.0, 10.0, 4.0, 4.0, [0.2, 0.9]), (1, 1, nan, 10.0, 4.0, 4.0, [0.9, 0.1]), (1, 2, 10.0, 10.0, inf, 4.0, [0.9, 0.1]), (1, 3, 10.0, 10.0, -4.0, 4.0, [0.9, 0.1]), (1, 4, 30.0, 30.0, 4.0, 4.0, [nan, nan]), (1, 5, 30.0, 30.0, 4.0, 4.0, [0.5, 0.5]), (1, 6, 500.0, 10.0, 4.0, 4.0, [0.9, 0.1]), (1, 7, 10.5, 10.0, 4.0, 4.0, [0.1, 0.8]), (1, 8, 10.5, 10.0, 4.0, 4.0, [0.7, 0.1])]
    anchors = spark.createDataFrame(rows, "page int, anchor int, cx double, cy double, w double, h double, scores array<double>").withColumns({n: F.lit(v) for n, v in (("scale", 1.0), ("left", 0.0), ("top", 0.0), ("width", 40), ("height", 40))})
    got = {r["anchor"]: (r["class_name"], r["score"]) for r in T.decode_anchors(anchors, page="page", anchor="anchor", names=F.array(F.lit("a")), confidence=0.4, overlap=0.5).collect()}
    assert got == {0: ("class_1", 0.9), 5: ("a", 0.5), 8: ("a", 0.7)}
    assert T.decode_anchors(anchors.limit(0), page="page", anchor="anchor", names=F.array(F.lit("a")), confidence=0.4, overlap=0.5).count() == 0
    for bad in (-0.1, 1.1, nan):
        with pytest.raises(ValueError):
            T.check_thresholds(confidence=bad)


def test_names_without_a_count(spark):
    one = spark.range(1)
    assert one.select(T.resolved_names(F.lit("{0: 'a'}"), F.lit(None).cast("int"))).first()[0] == ["a"]
    with pytest.raises(Exception, match="neither"):
        one.select(T.resolved_names(F.lit("x"), F.lit(None).cast("int"))).collect()


def test_registry_text_and_sets(spark):
    text = '{"v5": {"det": {"ch_PP-v5_det_mobile": {"model_url": "https://h/d.onnx", "sha256": "%s"}}, "rec": {"ch_PP-v5_rec_server": {"model_url": "https://h/r.onnx", "dictionary": {"url": "https://h/c.txt", "size_bytes": 3}}}}}' % ("a" * 64)
    rows = {r["task"]: r for r in M.load_registry(spark, text).collect()}
    assert (rows["det"]["lang"], rows["det"]["model_type"], rows["rec"]["model_type"], rows["rec"]["dict_url"], rows["rec"]["dict_size_bytes"]) == ("ch", "mobile", "server", "https://h/c.txt", 3)
    with pytest.raises(ValueError, match="address"):
        M.registry_rows({"v": {"det": {"m": {}}}})
    listed = M.load_registry(spark, text).select("model", M.language_tag_matches(F.col("model"), F.lit("ch")).alias("ch")).collect()
    assert all(r["ch"] for r in listed)


def test_limits_of_a_service():
    assert Q.ServiceLimits().check()["body_bytes"] == 64 << 20 and Q.ServiceLimits().check()["ttl_ms"] == 3_600_000
    for name in ("queue_text", "retained_mb", "ttl_seconds"):
        with pytest.raises(ValueError, match=name):
            Q.ServiceLimits(**{name: 0}).check()
    with pytest.raises(ValueError, match="too large"):
        Q.ServiceLimits(body_mb=1 << 50).check()


def test_settings_from_text():
    assert Q.EngineSettings.from_text('{"text_score": 0.4, "line_shape": [3, 32, 100]}').line_shape == (3, 32, 100)
    for bad in ('{"unknown": 1}', '{"text_score": 2}', "[1]"):
        with pytest.raises(ValueError):
            Q.EngineSettings.from_text(bad)


def test_cubic_weights_and_batches():
    table = P.cubic_weights()
    assert table.shape == (32, 32, 4, 4) and (table.sum((2, 3)) == 1 << 15).all()
    assert table[0, 0, 1, 1] == (1 << 15) - 1 and table[0, 0, 2, 2] == 1  # as far as sixteen bits go
    image = np.random.default_rng(0).integers(0, 256, (9, 12, 3), np.uint8)
    ys, xs = np.mgrid[0:9, 0:12].astype(float)
    assert np.array_equal(P.sample_cubic(image, xs, ys), image)
    flat = np.full((9, 12, 3), 77, np.uint8)
    assert (P.sample_cubic(flat, xs + 0.3, ys - 0.7) == 77).all()
    crop = P.perspective_crop(image, [(2, 1), (8, 1), (8, 5), (2, 5)], cubic=True)
    assert np.array_equal(crop, image[1:5, 2:8])
    batch = P.make_batch([image, flat], 1.5, (3, 8, 20))
    assert batch.shape == (2, 3, 8, 20) and P.make_batch([], 2.0).shape == (0, 3, 48, 320)


def test_mapped_sizes_and_first_change(spark):
    one = spark.range(1)
    assert tuple(one.select(T.mapped_size(F.lit(5), F.lit(1), F.lit(0.5), F.lit(0.1)).alias("s")).first()["s"]) == (2, 1)
    assert tuple(one.select(Z.short_side_size(F.lit(100), F.lit(30), 10).alias("s")).first()["s"]) == (33, 10)
    text = F.lit("a’b")
    name = one.select(X.first_change(text, {"codes": X.remove_terminal_codes(text), "quotes": X.uncurl_quotes(text), "lines": X.line_breaks(text)})).first()[0]
    assert name == "quotes" and one.select(X.first_change(F.lit("ab"), {"quotes": X.uncurl_quotes(F.lit("ab"))})).first()[0] is None


def test_resizing_in_whole_numbers():
    """Pixel by pixel, with the weights worked out one at a time."""
    import math

    rng = np.random.default_rng(4)
    image = rng.integers(0, 256, (7, 11, 3), np.uint8)
    for width, height in ((5, 9), (23, 4), (11, 14), (1, 1)):
        got = P.resize_linear(image, width, height)
        for y in range(height):
            for x in range(width):
                taps = []
                for at, n, m in ((x, 11, width), (y, 7, height)):
                    place = np.float32((at + 0.5) * (1.0 / (m / n)) - 0.5)
                    first = math.floor(place)
                    part = np.float32(place - np.float32(first))
                    if n == 11 and not 0 <= first < n - 1:
                        part = np.float32(0)
                    taps.append((min(max(first, 0), n - 1), min(max(first + 1, 0), n - 1), int(np.rint((np.float32(1) - part) * np.float32(2048))), int(np.rint(part * np.float32(2048)))))
                (xa, xb, wa, wb), (ya, yb, va, vb) = taps
                if not 0 <= math.floor(np.float32((x + 0.5) * (1.0 / (width / 11)) - 0.5)):
                    xb = 1
                for c in range(3):
                    row = lambda k: (int(image[k, xa, c]) * wa + int(image[k, xb, c]) * wb) >> 4  # noqa: B023, E731
                    assert got[y, x, c] == min(255, max(0, ((va * row(ya) >> 16) + (vb * row(yb) >> 16) + 2) >> 2))
    flat = np.full((9, 12, 3), 77, np.uint8)
    for kind in P.FILTERS:
        assert (P.resample(flat, 5, 14, kind) == 77).all()
    assert np.array_equal(P.resample(image, 11, 7), image)
    assert P.thumbnail_size(400, 300, 100, 100) == (100, 75) and P.thumbnail_size(3, 1000, 50, 50) == (1, 50) and P.thumbnail_size(10, 10, 10, 20) is None
    assert P.thumbnail(rng.integers(0, 256, (90, 120, 3), np.uint8), 12, 12).shape == (9, 12, 3)
    assert P.size_within(4000, 1000, 30, 2000) == (1984, 512) and P.size_within(500, 400, 30, 2000) == (500, 400) and P.size_within(5000, 20, 30, 2000) == (1984, 32)
    dark = np.array([[[10, 10, 10], [30, 30, 30]], [[20, 20, 20], [10, 30, 20]]], np.uint8)
    assert P.stretch_contrast(dark)[0].tolist() == [[0, 0, 0], [255, 255, 255]] and P.stretch_contrast(dark)[1, 0].tolist() == [128, 128, 128]
