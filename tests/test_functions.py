"""Literal cases of the functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelore.functions import geometry as G
from pagelore.functions import pixels as P
from pagelore.functions import stats as S
from pagelore.functions import text as X


@pytest.fixture(scope="module")
def ask(spark):
    """The value of an expression over literal columns."""

    def run(expression, **columns):
        names = list(columns)
        df = spark.createDataFrame([tuple(columns.values())], names) if names else spark.range(1)
        return df.select(expression.alias("v")).first()["v"]

    return run


A, B = F.col("a"), F.col("b")


@pytest.mark.parametrize(("a", "b", "d"), [("abc", "abc", 0), ("abc", "abd", 1), ("abc", "ab", 1), ("abc", "abcd", 1), ("", "abc", 3), ("été", "ete", 2)])
def test_edit_distance(ask, a, b, d):
    assert ask(X.text_metrics(A, B)["distance"], a=a, b=b) == d


def test_rates(ask):
    assert ask(X.error_rate(A, B), a="abcd", b="abxd") == 0.25
    assert ask(X.page_error_rate(A, B), a="中文", b="中X文") == 0.5 and ask(X.page_error_rate(A, B), a="", b="x") == 1.0
    assert ask(X.text_metrics(A, B)["normalized"], a="x + y", b="x+y") and not ask(X.text_metrics(A, B)["normalized"], a="x + y", b="x-y")


@pytest.mark.parametrize(("a", "b", "cut", "kind"), [("x+y", "x+", True, "truncated_no_eos"), ("x + y", "x+y", False, "model_mismatch"), (" ", "x", True, "empty_ground_truth"), ("x", "x", True, "none")])
def test_failures(ask, a, b, cut, kind):
    assert ask(X.failure_kind(A, B, F.lit(cut)), a=a, b=b) == kind


def test_error_classes(ask):
    assert ask(X.error_failure(A), a="tokenizer") == "tokenizer_decode" and ask(X.error_failure(A), a="nothing") is None
    assert set(X.ERROR_FAILURES.values()) <= set(X.PIPELINE_FAILURES) < set(X.FAILURES)


@pytest.mark.parametrize(
    ("a", "want"),
    [
        ("“here’s a test”", '"here\'s a test"'), ("ＬＯＵＤ　ＮＯＩＳＥＳ", "LOUD NOISES"), ("\x1b[36;44mblue\x1b[0m", "blue"), ("a\x00b\x0bc\x0e", "abc"), ("﻿x", "x"),
        ("a\r\nb\rc d e\u0085f", "a\nb\nc\nd\ne…f"), ("&amp;", "&amp;"), ("éﬁǄ", "éfiDŽ"), ("ﬅ", "ſt"),
    ],
)
def test_fix_text(ask, a, want):
    assert ask(X.fix_text(A), a=a) == want


@pytest.mark.parametrize(
    ("f", "a", "want"),
    [
        (X.balance_left_right, "\\left( x", "( x"), (X.balance_left_right, "\\left( x \\right)", "\\left( x \\right)"),
        (X.balance_left_right, "{\\left( a} b \\right)", "{\\left( a\\right)} b "), (X.balance_left_right, "\\frac{\\left(a}{b\\right)}", "\\frac{\\left(a}{b\\right)}"),
        (X.balance_environments, "\\begin{array}{c} x", "\\begin{array}{c} x \\end{array}"), (X.balance_environments, "x \\end{array}", "\\begin{array}{c} x \\end{array}"),
        (X.balance_environments, "x \\end{align*}", "\\begin{align*} x \\end{align*}"),
        (X.remove_up, "\\uparrow \\upalpha \\uparrowx", "\\uparrow \\alpha \\arrowx"), (X.remove_unsupported, "\\lefteqn{x} \\emph{y}", "{x} {y}"),
        (X.repair_latex, 'a"b', "ab"), (X.repair_latex, "a“b", 'a"b'), (X.unwrap_cjk_text, "\\text{ 中文 } x", "中文 x"),
        (X.escape_attribute, "<a href='x'>\n&\t", "&lt;a href=&#39;x&#39;&gt;&#10;&amp;&#9;"), (X.display_math, "a $$ b \r\n\r\n c  ", "a \\$\\$ b\n c"),
    ],
)
def test_latex(ask, f, a, want):
    assert ask(f(A), a=a) == want


def test_blocks_and_names(ask):
    assert ask(X.markdown_block(A, F.lit(True)), a="x") == "$$\nx\n$$\n\n" + X.TRUNCATED and ask(X.markdown_block(A, F.lit(False)), a=" \n") == ""
    assert ask(X.language_tag(A), a="ch_PP-v4_rec") == "ch" and ask(X.language_tag(A), a="_PP-v4") is None
    assert tuple(ask(X.parse_shard(A), a="2/5")) == (2, 5) and ask(X.parse_shard(A), a="5/5") is None and ask(X.parse_shard(A), a="x") is None
    assert ask(X.parse_split(A), a=" Val ") == "validate" and ask(X.parse_split(A), a="other") is None
    assert not ask(X.is_model_file_name(A), a="../x") and ask(X.is_model_file_name(A), a="x.onnx")
    assert ask(X.has_chinese(A), a="a中") and not ask(X.has_chinese(A), a="a")


def test_percentiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double")
    r = df.agg(*S.stats(F.col("v"))).first()
    assert (r.n, r.min, r.max, r.mean, r.p50, round(r.p95, 9)) == (4, 1, 4, 2.5, 2.5, 3.85)
    assert tuple(df.limit(0).agg(*S.stats(F.col("v"))).first()) == (0, 0, 0, 0, 0, 0, 0)
    assert df.limit(1).agg(*S.stats(F.col("v"))).first().stddev == 0
    ranked = S.ranked_from_histogram(df.withColumn("g", F.lit(1)), "g", "v").first()
    assert (ranked.p50, ranked.p90) == (2.0, 4.0)


def test_ledger(spark):
    df = spark.createDataFrame([(10.0, 4.0, 3.0, 2.0, 1.0, 5.0)], "total double, preprocess double, decode double, resize double, crop double, detector_infer double")
    for c in S.TIMINGS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    r = S.conservation(S.with_ledger(df)).first()
    assert (r.input_other, r.input_named_within, r.input_overflow, r.attributed, r.unattributed) == (0, 4, 2, 11, -1)
    assert not r.conserved and r.verdict == "parts exceed total" and r.excess == 0 and r.rust == 4 and r.inference == 5


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_polygons(ask):
    quad = lambda pts: F.array(*[G.point(x, y) for x, y in pts])
    a, b = square(0.0, 0.0, 2.0, 2.0), square(1.0, 1.0, 3.0, 3.0)
    assert ask(G.polygon_area(quad(a))) == 4 and ask(G.signed_area(quad(a[::-1]))) == -4 and ask(G.perimeter(quad(a))) == 8
    assert ask(G.quad_iou(quad(a), quad(b))) == pytest.approx(1 / 7) and ask(G.quad_iou(quad(a), quad(a))) == 1 and G.quad_iou_of(a, [(5.0, 5.0)] * 4) == 0
    diamond = [(1.0, 0.0), (2.0, 1.0), (1.0, 2.0), (0.0, 1.0)]
    assert G.quad_iou_of(a, diamond) == pytest.approx(0.5)
    mixed = [a[2], a[0], a[3], a[1]]
    assert [tuple(p) for p in ask(G.order_clockwise(quad(mixed)))] == a and [tuple(p) for p in ask(G.order_by_rows(quad(mixed)))] == a
    assert not ask(G.is_vertical(quad(a))) and ask(G.is_vertical(quad(square(0.0, 0.0, 2.0, 3.0))))
    assert ask(G.polygon_in_image(quad(a), F.lit(2), F.lit(2))) and not ask(G.polygon_in_image(quad(b), F.lit(2), F.lit(2)))
    assert ask(F.size(G.convex_hull(quad([*a, (1.0, 1.0)])))) == 4
    assert G._area(G.min_area_rect_of(diamond)) == pytest.approx(2.0) and G._area(G.min_area_rect_of(a)) == pytest.approx(4.0)
    turned = ask(G.rotate(G.point(2, 1), F.lit(math.pi / 2), G.point(1, 1)))
    assert (turned.x, turned.y) == (pytest.approx(1), pytest.approx(0))
    m = np.array(G.homography_of(a, square(0.0, 0.0, 4.0, 2.0))).reshape(3, 3)
    assert np.allclose(m @ [1, 1, 1], [2, 1, 1]) and G.homography_of([(0, 0)] * 4, a) == [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]


def test_boxes(ask):
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, ("x0", "y0", "x1", "y1"), strict=True)])
    assert ask(G.box_iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0 and ask(G.covered_ratio(box(0, 0, 1, 1), box(0, 0, 2, 2))) == 1
    assert tuple(ask(G.clamped_box(box(-5, -5, 5, 5), F.lit(4), F.lit(9)))) == (0, 0, 4, 5) and ask(G.clamped_box(box(9, 9, 20, 20), F.lit(9.5), F.lit(20))) is None
    cols = F.array(F.lit(3), F.lit(1))
    assert [(b.x0, b.x1) for b in ask(G.char_boxes(cols, F.lit(4.0), F.lit(4.0), box(10, 0, 30, 5)))] == [(14, 18), (22, 26)]
    over = F.array(box(0, 0, 6, 1), box(4, 0, 9, 1), box(9, 0, 12, 1))
    assert [(b.x0, b.x1) for b in ask(G.spread_overlaps(over))] == [(0, 5), (5, 9), (9, 12)]
    assert ask(G.vertical_padding(F.lit(800), F.lit(20), 8.0, 30)) == 90 and ask(G.vertical_padding(F.lit(100), F.lit(50), 8.0, 30)) == 0


def test_pixels(ask, spark):
    assert ask(P.luma(F.lit(255), F.lit(255), F.lit(255))) == 255 and ask(P.blend_on_white(F.lit(0), F.lit(0))) == 255
    rgba = np.array([[[0, 0, 0, 255], [9, 9, 9, 0]]], np.uint8)
    assert P.flatten_alpha(rgba).tolist() == [[[0, 0, 0], [255, 255, 255]]]
    gray = np.arange(6, dtype=np.uint8).reshape(2, 3)
    assert P.gray_to_bgr(gray).shape == (2, 3, 3) and (P.oriented(P.oriented(gray, 6), 8) == gray).all() and P.oriented(gray, 99) is gray
    assert all(P.oriented(gray, k).shape == ((2, 3) if k < 5 else (3, 2)) for k in range(1, 9))
    assert P.resize_linear(np.array([[[1], [2]], [[3], [5]]], np.uint8), 1, 1).tolist() == [[[3]]] and P.size_within(4000, 1000, 30, 2000) == (1984, 512)
    assert P.dilate_2x2(np.array([[1, 0], [0, 0]], np.uint8)).tolist() == [[1, 1], [1, 1]] and P.masked_mean(np.array([1.0, 3.0]), np.array([1, 0])) == 1
    prob = np.zeros((30, 40))
    prob[5:15, 8:30] = 0.9
    (quad, score), = P.detect_boxes(prob, ratio=0.0)
    assert score > 0.7 and {(round(x), round(y)) for x, y in quad} == {(8, 5), (30, 5), (30, 15), (8, 15)}
    (grown, _), = P.detect_boxes(prob, size=(80, 30))
    assert min(x for x, _ in grown) < 16 and max(x for x, _ in grown) > 60 and P.detect_boxes(prob, box_limit=0.95) == []
    flat = np.full((6, 9, 3), 77, np.uint8)
    assert all((P.resample(flat, 4, 5, k) == 77).all() for k in P.FILTERS) and P.thumbnail(flat, 3, 9).shape == (2, 3, 3) and P.thumbnail(flat, 9, 9) is flat
    ramp = np.repeat(np.arange(0, 90, 10, dtype=np.uint8)[None, :, None], 6, 0)
    assert (P.perspective_crop(ramp, [(2.0, 1.0), (6.0, 1.0), (6.0, 4.0), (2.0, 4.0)])[..., 0] == [[20, 30, 40, 50]] * 3).all()
    assert P.perspective_crop(ramp, [(1.0, 0.0), (2.0, 0.0), (2.0, 5.0), (1.0, 5.0)]).shape == (1, 5, 1)
    assert P.draw_outlines(np.zeros((4, 4, 3), np.uint8), [square(0, 0, 3, 3)], [(1, 2, 3)])[..., 1].sum() == 24
    box = P.letterbox(200, 100)
    assert (box["width"], box["height"], box["top"]) == (768, 384, 192)
    assert P.crop_margin(np.pad(np.zeros((2, 3, 3), np.uint8), ((4, 4), (5, 5), (0, 0)), constant_values=255)).shape == (2, 3, 3)
    assert P.line_tensor(np.full((24, 24, 3), 255, np.uint8), 2.0).shape == (3, 48, 96) and P.normalized(np.zeros((1, 2, 3), np.uint8), 0.5, 0.5).min() == -1
    with pytest.raises(ValueError):
        P.pixels_of(bytes(12), 2, 2, 6, 3, roi=(1, 1, 2, 2))
    df = spark.createDataFrame([(1, 2, 1, bytearray(range(6)))], "id int, w int, h int, data binary")
    assert bytes(P.map_images(df, lambda i: i[:, ::-1]).first()["data"]) == bytes([3, 4, 5, 0, 1, 2])
    clear = spark.createDataFrame([(1, 0, 0, 0, 255), (2, 255, 255, 255, 255), (3, 0, 0, 0, 0)], "i int, r int, g int, b int, a int")
    assert {r.i: r.background for r in P.auto_background(clear, ["i"]).collect()} == {1: 255, 2: 0, 3: 255}


@pytest.mark.parametrize(("a", "want"), [("abc (1)", "abc (1)"), ("אבג", "גבא"), ("אב 12 גד", "דג 12 בא"), ("abc אבג def", "abc גבא def"), ("אב (ג)", ")ג( בא"), ("ا 12", "12 ا"), ("", "")])
def test_visual_order(ask, a, want):
    from pagelore.functions import bidi

    assert ask(bidi.visual_order(A), a=a) == want


def test_sql_names(spark):
    from pagelore.functions.sql import register

    register(spark)
    assert spark.sql("SELECT visual_order('אב') v, nfc('e\u0301') n").first() == ("בא", "é")


def test_sinks(spark, tmp_path):
    from pagelore.sources import sinks

    df = spark.createDataFrame([(1, "a"), (2, "bb")], "page long, text string")
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    with pytest.raises(Exception, match="too large"):
        sinks.write_json(df, str(tmp_path / "k"), limit=5)
    sinks.write_documents(df, str(tmp_path / "d"), page="page", document=F.col("text"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "d")).collect()} == {'{"page":1,"document":"a"}', '{"page":2,"document":"bb"}'}
    sinks.write_tables({"t": df}, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p/t")).count() == 2
