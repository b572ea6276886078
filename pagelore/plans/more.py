"""More queries: detection, sizes, registries, the job store, geometry, words, pixels, and the smaller functions, each with its SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelore.functions import geometry as G
from pagelore.functions import pixels as P
from pagelore.functions import sizing as Z
from pagelore.functions import stats as S
from pagelore.functions import text as X
from pagelore.operators import detect as T
from pagelore.operators import evaluate as E
from pagelore.operators import filters as L
from pagelore.operators import order as O
from pagelore.operators import registry as M
from pagelore.operators import render as R
from pagelore.operators import requests as Q
from pagelore.plans import derive as V
from pagelore.plans.catalogue import _BOX_IOU, _LEDGER, _PAIRS_IOU, _greedy, query
from pagelore.sources import addresses as A
from pagelore.sources import datasets as D
from pagelore.sources import images as I
from pagelore.streaming import jobs as J

# --- detection

_CAND = f"""{V.REGIONS}, a0 AS (SELECT page, rid, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, CASE WHEN rid % 5 = 0 THEN 0 ELSE x1 - x0 END AS w, y1 - y0 AS h,
  [score, (rid * 37 % 11) / 100.0, (page * 13 % 9) / 100.0] AS s FROM regions
), a1 AS (SELECT page, rid, list_max(s) AS score, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS class_id, cx - w / 2 AS p0, cy - h / 2 AS q0, cx + w / 2 AS p1, cy + h / 2 AS q1 FROM a0 WHERE w > 0 AND h > 0
), a2 AS (SELECT page, rid, score, class_id, least(greatest((p0 - 4.0) / 2.0, 0), 40) AS x0, least(greatest((q0 - 3.0) / 2.0, 0), 30) AS y0, least(greatest((p1 - 4.0) / 2.0, 0), 40) AS x1, least(greatest((q1 - 3.0) / 2.0, 0), 30) AS y1, '' AS text FROM a1 WHERE score > 0.04
), cand AS (SELECT * FROM a2 WHERE x1 > x0 AND y1 > y0)"""


@query(f"WITH RECURSIVE {_CAND}, {_PAIRS_IOU.replace('FROM regions a JOIN regions b', 'FROM cand a JOIN cand b')}, {_greedy('score DESC, rid', 'iou h WHERE h.page = o.page AND h.a = o.rid AND list_contains(w.k, h.b) AND h.ac = h.bc AND h.iou > 0.4', 'cand', 3)} SELECT page, rid, class_id, CASE class_id WHEN 0 THEN 'inline' WHEN 1 THEN 'display' ELSE 'class_2' END AS class_name, score, x0, y0, x1, y1 FROM kept JOIN cand USING (page, rid)")
def detect_decode(spark, d):
    rows = V.regions(spark, d)
    scores = F.array(F.col("score"), (F.col("rid") * 37 % 11) / 100.0, (F.col("page") * 13 % 9) / 100.0)
    w = F.when(F.col("rid") % 5 == 0, 0.0).otherwise(F.col("x1") - F.col("x0"))
    anchors = rows.select("page", "rid", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), w.alias("w"), (F.col("y1") - F.col("y0")).alias("h"), scores.alias("scores"), *[F.lit(v).alias(n) for n, v in (("scale", 2.0), ("left", 4.0), ("top", 3.0), ("width", 40), ("height", 30))])
    return T.decode_anchors(anchors, page="page", anchor="rid", names=T.names_of(F.lit("{0: 'inline', 1: 'display'}")), confidence=0.04, overlap=0.4, limit=3)


@query("WITH v AS (SELECT p_partkey, p_partkey % 5 AS k, p_partkey % 4 AS n FROM part), m AS (SELECT *, CASE k WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['b', 'a'] WHEN 4 THEN ['x y', 'z', 'w'] ELSE [] END AS names FROM v) SELECT p_partkey, array_to_string(names, '|') AS parsed, array_to_string(CASE WHEN len(names) = n THEN names ELSE list_transform(range(n), lambda i: 'class_' || i) END, '|') AS resolved FROM m")
def class_names(spark, d):
    k = F.col("p_partkey") % 5
    raw = F.when(k == 0, "{0: 'a', 1: 'b'}").when(k == 1, ' {1: "a",0:"b", } ').when(k == 2, "{0: 'a', 2: 'b'}").when(k == 3, "[a, b]").otherwise("{0: x y, 1: 'z', 2: w}")
    rows = V.table(spark, d, "part").select("p_partkey", raw.alias("raw"), (F.col("p_partkey") % 4).alias("n"))
    return rows.select("p_partkey", F.array_join(T.names_of(F.col("raw")), "|").alias("parsed"), F.array_join(T.resolved_names(F.col("raw"), F.col("n")), "|").alias("resolved"))


_MAP = "least(greatest(({v} - {pad}) * {r}, 0), {size})"


@query(f"WITH {V.REGIONS} SELECT page, rid, {_MAP.format(v='x0', pad=4, r=0.5, size=30)} AS mx0, {_MAP.format(v='y1', pad=12, r=0.75, size=25)} AS my1, least(greatest(round_even(x1 / 90 * 45, 0), 0), 45) AS sx1, least(greatest(round_even(y0 / 70 * 100, 0), 0), 100) AS sy0 FROM regions")
def map_back(spark, d):
    quad = G.box_quad(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    back = T.mapped_back(quad, F.lit(4), F.lit(12), F.lit(0.5), F.lit(0.75), F.lit(30), F.lit(25))
    scaled = T.scaled_to(quad, F.lit(90), F.lit(70), F.lit(45), F.lit(100))
    return V.regions(spark, d).select("page", "rid", back[0]["x"].alias("mx0"), back[2]["y"].alias("my1"), scaled[1]["x"].alias("sx1"), scaled[0]["y"].alias("sy0"))


@query(f"WITH {V.REGIONS}, b AS (SELECT page, rid, CAST(least(greatest(floor(x0 + 0.25), 0), 60) AS INTEGER) AS x, CAST(least(greatest(floor(y0 - 3.5), 0), 50) AS INTEGER) AS y, CAST(least(greatest(ceil(x1 + 0.25), 0), 60) AS INTEGER) AS ex, CAST(least(greatest(ceil(y1 - 3.5), 0), 50) AS INTEGER) AS ey FROM regions) SELECT page, rid, x, y, least(greatest(ex - x, 1), greatest(60 - x, 1)) AS w, least(greatest(ey - y, 1), greatest(50 - y, 1)) AS h FROM b")
def crop_boxes(spark, d):
    quad = G.box_quad(F.col("x0") + 0.25, F.col("y0") - 3.5, F.col("x1") + 0.25, F.col("y1") - 3.5)
    return V.regions(spark, d).withColumn("c", T.crop_bounds(quad, F.lit(60), F.lit(50))).select("page", "rid", "c.x", "c.y", "c.w", "c.h")


@query(f"WITH {V.REGIONS}, f AS (SELECT page, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) AS bs FROM regions WHERE class_id = 2 GROUP BY page) SELECT r.page, r.rid FROM regions r LEFT JOIN f USING (page) WHERE r.class_id <> 2 AND coalesce(len(list_filter(bs, lambda b: (r.x0 + r.x1) / 2 BETWEEN b.x0 AND b.x1 AND (r.y0 + r.y1) / 2 BETWEEN b.y0 AND b.y1)), 0) = 0")
def whitened_tokens(spark, d):
    rows = V.regions(spark, d)
    return T.outside_regions(rows.where("class_id <> 2"), rows.where("class_id = 2"), page="page").select("page", "rid")


# --- sizes

_SIDE = "CAST(greatest(round_even(greatest(floor(CAST({n} AS FLOAT) * ratio), 1) / 32, 0) * 32, 32) AS INTEGER)"


@query(f"""WITH p AS (SELECT p_partkey, CAST(p_size * 61 + p_partkey % 37 + 1 AS INTEGER) AS w, CAST(p_size * 23 + p_partkey % 91 + 1 AS INTEGER) AS h, CASE WHEN p_partkey % 3 = 0 THEN 'min' ELSE 'max' END AS kind FROM part
), l AS (SELECT *, CASE WHEN kind = 'min' THEN 736 WHEN greatest(w, h) < 960 THEN 960 WHEN greatest(w, h) < 1500 THEN 1500 ELSE 2000 END AS lim FROM p
), r AS (SELECT *, CAST(CASE WHEN kind = 'max' THEN CASE WHEN greatest(w, h) > lim THEN CAST(lim AS FLOAT) / CAST(greatest(w, h) AS FLOAT) ELSE 1 END ELSE CASE WHEN least(w, h) < lim THEN CAST(lim AS FLOAT) / CAST(least(w, h) AS FLOAT) ELSE 1 END END AS FLOAT) AS ratio FROM l)
SELECT p_partkey, lim AS side_limit, {_SIDE.format(n='w')} AS det_w, {_SIDE.format(n='h')} AS det_h,
  CAST(CASE WHEN w <= h THEN 384 ELSE 384 * w // h END AS INTEGER) AS short_w, CAST(CASE WHEN w <= h THEN 384 * h // w ELSE 384 END AS INTEGER) AS short_h,
  CAST(greatest(floor(48 * (CAST(w AS DOUBLE) / h)), 320) AS INTEGER) AS batch_w, CAST(least(ceil(48.0 * (CAST(w AS DOUBLE) / CAST(h AS DOUBLE))), 320) AS INTEGER) AS line_w,
  CAST(greatest(least(ceil(CAST(48 AS FLOAT) * CAST(CAST(w AS FLOAT) / CAST(h AS FLOAT) AS FLOAT)), 192), 1) AS INTEGER) AS cls_w FROM r""")
def image_sizes(spark, d):
    w, h = (F.col("p_size") * 61 + F.col("p_partkey") % 37 + 1).cast("int"), (F.col("p_size") * 23 + F.col("p_partkey") % 91 + 1).cast("int")
    rows = V.table(spark, d, "part").select("p_partkey", w.alias("w"), h.alias("h"), F.when(F.col("p_partkey") % 3 == 0, "min").otherwise("max").alias("kind"))
    rows = rows.withColumn("side_limit", Z.side_limit(F.col("kind"), F.lit(736), F.greatest("w", "h")))
    w, h = F.col("w"), F.col("h")
    size, short = Z.detector_size(w, h, F.col("kind"), F.col("side_limit")), Z.short_side_size(w, h, 384)
    return rows.select("p_partkey", "side_limit", size["w"].alias("det_w"), size["h"].alias("det_h"), short["w"].alias("short_w"), short["h"].alias("short_h"), Z.batch_width(w.cast("double") / h, 48, 320).alias("batch_w"), Z.line_width(w, h, 48, F.lit(320)).alias("line_w"), Z.classifier_width(w, h, 48, 192).alias("cls_w"))


@query(f"WITH {V.REGIONS}, q AS (SELECT page, rid, rid % 3 <> 0 AS upright, CAST(round_even(x0 + 0.5, 0) AS INTEGER) AS l, CAST(round_even(x1 + 0.5, 0) AS INTEGER) AS r, CAST(round_even(y0, 0) AS INTEGER) AS t, CAST(round_even(y1, 0) AS INTEGER) AS b FROM regions), c AS (SELECT page, rid, upright, least(greatest(l, 0), 49) AS x0, least(greatest(r, 0), 50) AS x1, least(greatest(t, 0), 39) AS y0, least(greatest(b, 0), 40) AS y1 FROM q) SELECT page, rid, x0, y0, x1, y1 FROM c WHERE upright AND x1 > x0 AND y1 > y0")
def axis_crops(spark, d):
    x0, y0, x1, y1 = F.col("x0") + 0.5, F.col("y0"), F.col("x1") + 0.5, F.col("y1")
    lean = F.when(F.col("rid") % 3 == 0, 0.5).otherwise(0.0005)
    quad = F.array(G.point(x0, y0), G.point(x1, y0 + lean), G.point(x1, y1), G.point(x0, y1))
    return V.regions(spark, d).withColumn("c", Z.axis_aligned_crop(quad, F.lit(50), F.lit(40))).where("c is not null").select("page", "rid", "c.x0", "c.y0", "c.x1", "c.y1")


_AWAY = "floor({v} + 0.5)"


@query("WITH p AS (SELECT p_partkey, p_size * 31 + 7 AS w, p_partkey % 500 + 20 AS h FROM part), s AS (SELECT *, least(768.0 / w, 768.0 / h) AS scale FROM p), r AS (SELECT *, floor(w * scale + 0.5) AS rw, floor(h * scale + 0.5) AS rh FROM s) SELECT p_partkey, scale, rw AS width, rh AS height, floor((768 - rw) / 2 - 0.1 + 0.5) AS pad_left, floor((768 - rh) / 2 - 0.1 + 0.5) AS pad_top FROM r")
def letterboxes(spark, d):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            boxes = [P.letterbox(w, h) for w, h in zip(pdf["w"], pdf["h"], strict=True)]
            yield pd.DataFrame({"p_partkey": pdf["p_partkey"]} | {n: [float(b[k]) for b in boxes] for n, k in (("scale", "scale"), ("width", "width"), ("height", "height"), ("pad_left", "left"), ("pad_top", "top"))})

    rows = V.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 31 + 7).cast("int").alias("w"), (F.col("p_partkey") % 500 + 20).cast("int").alias("h"))
    return rows.mapInPandas(run, "p_partkey long, scale double, width double, height double, pad_left double, pad_top double")


# --- names, addresses, blocks


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '_') || '-source.jpeg' WHEN 1 THEN replace(p_name, ' ', '_') || '-source.png' WHEN 2 THEN p_partkey || '.tar-source.png' ELSE 'source-source.png' END AS name FROM part")
def source_names(spark, d):
    k, name = F.col("p_partkey") % 4, F.replace("p_name", F.lit(" "), F.lit("_"))
    path = F.when(k == 0, F.concat(F.lit("a/b.c/"), name, F.lit(".jpeg"))).when(k == 1, name).when(k == 2, F.concat(F.lit("x/"), F.col("p_partkey").cast("string"), F.lit(".tar.png"))).otherwise("x/")
    return V.table(spark, d, "part").select("p_partkey", X.source_image_name(path).alias("name"))


_ESC = "replace(replace(replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_ATTR = f"replace(replace(replace({_ESC}, chr(10), '&#10;'), chr(13), '&#13;'), chr(9), '&#9;')"


@query(f"""SELECT doc_id, md5('<div class="formula" data-latex="' || {_ATTR.format(t='text')} || '" data-truncated="' || CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END || '" data-eos="' || CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE CAST(doc_id % 50 AS VARCHAR) END || '"><span class="formula-latex">' || {_ESC.format(t='text')} || '</span></div>') AS html FROM documents""")
def formula_blocks(spark, d):
    cut = F.col("doc_id") % 3 == 0
    html = X.formula_html(F.col("text"), cut, F.when(~cut, F.col("doc_id") % 50))
    return V.table(spark, d, "documents").select("doc_id", F.md5(html.cast("binary")).alias("html"))


@query("SELECT page_id, CASE WHEN NOT starts_with(u, 'https://') THEN 'scheme' WHEN regexp_extract(u, '^[a-z]+://([^/?#]+)', 1) NOT IN ('example.com', 'example.org') THEN 'host' END AS refusal FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN replace(url, 'https://', 'http://') WHEN 1 THEN 'https://example.com/m/' || page_id WHEN 2 THEN 'https://sub.example.com/m' ELSE 'https://example.org/?q=' || page_id END AS u FROM pages)")
def download_refusals(spark, d):
    k, i = F.col("page_id") % 4, F.col("page_id").cast("string")
    url = F.when(k == 0, F.replace("url", F.lit("https://"), F.lit("http://"))).when(k == 1, F.concat(F.lit("https://example.com/m/"), i)).when(k == 2, "https://sub.example.com/m").otherwise(F.concat(F.lit("https://example.org/?q="), i))
    return V.table(spark, d, "pages").select("page_id", X.download_refusal(url, ("example.com", "example.org")).alias("refusal"))


@query(r"SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'train' WHEN 1 THEN 'validate' WHEN 2 THEN 'validate' WHEN 3 THEN 'test' END AS split, p_partkey % 7 NOT IN (0, 1, 2, 3) AS bare, p_partkey % 3 = 0 AS digest, p_partkey % 4 IN (1, 2) AS chinese, trim(p_name) || ' x' AS line FROM part")
def names_and_splits(spark, d):
    k, name = F.col("p_partkey"), F.col("p_name")
    split = F.when(k % 6 == 0, " Train").when(k % 6 == 1, "VAL").when(k % 6 == 2, "validation ").when(k % 6 == 3, "test").otherwise("other")
    file = F.when(k % 7 == 0, F.concat(F.lit("a/"), name)).when(k % 7 == 1, "..").when(k % 7 == 2, F.concat(F.lit("c:"), name)).when(k % 7 == 3, F.concat(name, F.lit("\n"))).otherwise(F.concat(name, F.lit(".onnx")))
    digest = F.when(k % 3 == 0, F.upper(F.sha2(name.cast("binary"), 256))).otherwise(F.md5(name.cast("binary")))
    cjk = F.when(k % 4 == 1, F.concat(name, F.lit("中"))).when(k % 4 == 2, F.concat(F.lit("Ａ"), name)).otherwise(name)
    line = F.concat(F.lit("\r\n "), name, F.lit("\x00\n\t"), F.lit("x\x7f"))
    return V.table(spark, d, "part").select("p_partkey", X.parse_split(split).alias("split"), X.is_model_file_name(file).alias("bare"), X.is_sha256(digest).alias("digest"), X.has_chinese(cjk).alias("chinese"), X.one_line(line).alias("line"))


@query(r"SELECT page_id, length(u) > 0 AND NOT starts_with(u, '/') AND NOT regexp_matches(u, '(^|/)(\.{1,2})?(/|$)') AND NOT contains(u, chr(92)) AS safe FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) WHEN 1 THEN 'a/../' || page_id WHEN 2 THEN 'a//b' WHEN 3 THEN 'a' || chr(92) || 'b' ELSE 'img/p.' || page_id || '.png' END AS u FROM pages)")
def safe_paths(spark, d):
    k, i = F.col("page_id") % 5, F.col("page_id").cast("string")
    path = F.when(k == 0, F.parse_url("url", F.lit("PATH"))).when(k == 1, F.concat(F.lit("a/../"), i)).when(k == 2, "a//b").when(k == 3, "a\\b").otherwise(F.concat(F.lit("img/p."), i, F.lit(".png")))
    return V.table(spark, d, "pages").select("page_id", D.is_safe_path(path).alias("safe"))


@query("SELECT page_id, md5('data:image/png;base64,' || to_base64(encode(html))) AS url FROM pages")
def data_urls(spark, d):
    return V.table(spark, d, "pages").select("page_id", F.md5(R.data_url(F.encode("html", "UTF-8")).cast("binary")).alias("url"))


@query(rf"SELECT doc_id, md5(regexp_replace(t, '\x1b\[[0-9;]*[a-zA-Z]', '', 'g')) AS plain, md5(translate(t, chr(8216) || chr(8217) || chr(8220) || chr(8221), '''''\"\"')) AS quotes, md5(regexp_replace(t, '\r\n|[\r\x{{2028}}\x{{2029}}\x{{0085}}]', chr(10), 'g')) AS lines, md5(replace(replace(t, chr(64257), 'fi'), chr(307), 'ij')) AS ligatures, md5(translate(t, chr(146), chr(8217))) AS c1 FROM (SELECT doc_id, chr(27) || '[31m' || text || chr(27) || '[0m' || chr(13) || chr(10) || chr(8216) || chr(8221) || chr(64257) || chr(307) || chr(146) || chr(8232) || 'x' AS t FROM documents)")
def text_steps(spark, d):
    t = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0m\r\n‘”ﬁĳ\x92 x"))
    digest = lambda c, n: F.md5(c.cast("binary")).alias(n)
    return V.table(spark, d, "documents").select("doc_id", digest(X.remove_terminal_codes(t), "plain"), digest(X.uncurl_quotes(t), "quotes"), digest(X.line_breaks(t), "lines"), digest(X.replaced(t, X.LIGATURES), "ligatures"), digest(X.replaced(t, X.c1_pairs()), "c1"))


@query(r"SELECT doc_id, CAST(1 + doc_id % 3 AS INTEGER) AS n_left, md5(text || repeat(' ( x', CAST(1 + doc_id % 3 AS INTEGER)) || ' )') AS bare, md5(text || ' \alpha \uparrow \uplus') AS up, md5(replace(text, chr(34), '') || ' 中文 {x}') AS kept FROM documents")
def latex_steps(spark, d):
    n, text = (F.col("doc_id") % 3 + 1).cast("int"), F.col("text")
    pairs = F.concat(text, F.repeat(F.lit(r" \left( x"), n), F.lit(r" \right)"))
    plain = F.concat(text, F.lit(r" \upalpha \uparrow \uplus"))
    wrapped = F.concat(text, F.lit(r" \text{中文} \emph{x}"))
    digest = lambda c, name: F.md5(c.cast("binary")).alias(name)
    return V.table(spark, d, "documents").select("doc_id", X.count_command(pairs, "left").cast("int").alias("n_left"), digest(X.strip_left_right(pairs), "bare"), digest(X.remove_up(plain), "up"), digest(X.remove_unsupported(X.unwrap_cjk_text(wrapped)), "kept"))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN '$$' || chr(10) || 'a' || chr(10) || 'b ' || w || chr(10) || '$$' WHEN doc_id % 4 = 2 THEN '$$' || chr(10) || 'a\\$\\$b ' || w || chr(10) || '$$' ELSE '$$' || chr(10) || w || chr(10) || '$$' || chr(10) || chr(10) || '<!-- formula truncated: no EOS token -->' END) AS block FROM (SELECT doc_id, 'd' || doc_id AS w FROM documents)".replace("\\\\$", "\\$"))
def formula_markdown(spark, d):
    k, w = F.col("doc_id") % 4, F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    latex = F.when(k == 0, " \r\n \t").when(k == 1, F.concat(F.lit("\n  a \r\n \n"), F.lit("b "), w, F.lit("\n"))).when(k == 2, F.concat(F.lit("a$$b "), w)).otherwise(w)
    return V.table(spark, d, "documents").select("doc_id", F.md5(X.markdown_block(latex, k == 3).cast("binary")).alias("block"))


# --- the ledger and batches


@query(f"WITH {_LEDGER} SELECT user_id, day, total AS total, inference AS inference_ms, CASE WHEN total > 0 THEN round(inference / total, 6) END AS inference_share, abs(attributed - total) <= greatest(1.6e-5, abs(total) * 1e-6) AS conserved, input_named_within + input_other + detector_preprocess + classifier_preprocess + recognizer_preprocess + detector_postprocess + classifier_postprocess + recognizer_postprocess + page_postprocess + formula AS rust_ms FROM ledger")
def ledger_exports(spark, d):
    json = S.ledger_json(S.with_ledger(V.timings(spark, d)))
    rows = S.with_ledger(V.timings(spark, d)).select("user_id", "day", json.alias("j"))
    of = lambda path: F.get_json_object("j", path).cast("double")
    return rows.select("user_id", "day", of("$.total").alias("total"), of("$.inference_ms").alias("inference_ms"), F.round(of("$.shares.inference"), 6).alias("inference_share"), (F.get_json_object("j", "$.conservation.conserved") == "true").alias("conserved"), of("$.rust_ms").alias("rust_ms"))


@query("WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, CASE WHEN event_type = 'error' AND user_id % 4 = 1 THEN -1 ELSE (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 5 END AS t FROM events) SELECT user_id, bool_and(t = i % 5) AS matches FROM r GROUP BY user_id")
def batch_baselines(spark, d):
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = V.table(spark, d, "events").withColumn("i", i.cast("long"))
    own = F.when((F.col("event_type") == "error") & (F.col("user_id") % 4 == 1), F.lit(-1).cast("long")).otherwise(F.col("i") % 5)
    rows = rows.select("user_id", "i", F.array(own, own + 1).alias("tokens"))
    baselines = spark.range(5).select(F.col("id").alias("at"), F.array(F.col("id"), F.col("id") + 1).alias("tokens"))
    return S.matches_baselines(rows, baselines, by=["user_id"], position="i", tokens="tokens")


# --- registries

_V6 = "WITH q AS (SELECT event_id, ['det', 'rec', 'cls'][event_id % 3 + 1] AS task, ['ch', 'en', 'japan', 'multi', 'xx'][event_id // 3 % 5 + 1] AS lang, ['tiny', 'small', 'medium', 'server'][event_id // 15 % 4 + 1] AS size FROM events), o AS (SELECT *, CASE WHEN task = 'cls' THEN 'task' WHEN size = 'server' THEN 'size' WHEN NOT ((task = 'det' AND lang = 'multi') OR lang IN ('ch', 'en') OR (lang = 'japan' AND size <> 'tiny')) THEN 'language' WHEN size = 'medium' AND task = 'rec' THEN 'missing' ELSE 'found' END AS outcome FROM q)"


@query(f"{_V6} SELECT event_id, outcome, CASE WHEN outcome = 'found' THEN '{M.V6_NAME.split('{')[0]}' || task || '_' || size END AS model FROM o")
def select_models(spark, d):
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    i = F.col("event_id")
    asked = V.table(spark, d, "events").select("event_id", pick(("det", "rec", "cls"), i % 3).alias("task"), pick(("ch", "en", "japan", "multi", "xx"), F.floor(i / 3) % 5).alias("lang"), pick(("tiny", "small", "medium", "server"), F.floor(i / 15) % 4).alias("size"))
    names = [M.V6_NAME.format(task=t, size=s) for t in M.V6_TASKS for s in M.V6_SIZES if (t, s) != ("rec", "medium")]
    return M.select_v6(asked, spark.createDataFrame([(n,) for n in names], "model string")).select("event_id", "outcome", "model")


def _registry(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    task = F.element_at(F.array(*map(F.lit, ("det", "cls", "rec"))), (k % 3 + 1).cast("int"))
    url = F.concat(F.lit("https://example.org/m/"), k.cast("string"), F.lit(".onnx?x=1"))
    book = F.when((k % 3 == 2) & (k % 2 == 0), F.concat(F.lit("https://example.org/d/"), k.cast("string"), F.lit(".txt")))
    return V.table(spark, d, "part").select(
        task.alias("task"), F.col("p_brand").alias("version"), F.concat(F.lit("l"), (k % 4).cast("string")).alias("lang"), F.col("p_type").alias("model_type"), F.concat(F.lit("m"), k.cast("string")).alias("model"), url.alias("url"),
        F.sha2(k.cast("string").cast("binary"), 256).alias("sha256"), (k * 3).cast("long").alias("size_bytes"), book.alias("dict_url"), F.when(book.isNotNull(), F.md5(k.cast("string").cast("binary"))).alias("dict_sha256"), F.when(book.isNotNull(), k).cast("long").alias("dict_size_bytes"),
    )


_REGISTRY = """g AS (SELECT ['det', 'cls', 'rec'][p_partkey % 3 + 1] AS task, p_brand AS version, 'l' || (p_partkey % 4) AS lang, p_type AS model_type, p_partkey AS k FROM part
), q AS (SELECT DISTINCT version, model_type, l AS rec_lang, version || '-' || model_type || '-' || l AS set_id, l <> 'l1' AS with_cls FROM g, (SELECT unnest(['l0', 'l1', 'l2']) AS l)
), t AS (SELECT *, 'det' AS task, 'l0' AS lang, 0 AS place FROM q UNION ALL SELECT *, 'cls', 'l0', 1 FROM q WHERE with_cls UNION ALL SELECT *, 'rec', rec_lang, 2 FROM q
), c AS (SELECT task, version, lang, model_type, count(*) AS n, arg_min(k, 'https://example.org/m/' || k || '.onnx?x=1') AS k FROM g GROUP BY ALL
), j AS (SELECT t.*, n, k, CASE WHEN n IS NULL THEN t.task || ': missing' WHEN n > 1 THEN t.task || ': ambiguous' END AS wrong FROM t LEFT JOIN c USING (task, version, lang, model_type)
), s AS (SELECT set_id, arg_min(wrong, place) FILTER (WHERE wrong IS NOT NULL) AS problem FROM j GROUP BY set_id
), f AS (SELECT set_id, place, ['detector', 'classifier', 'recognizer'][place + 1] AS role, k || '.onnx' AS name, sha256(CAST(k AS VARCHAR)) AS sha256, k * 3 AS size_bytes FROM j UNION ALL SELECT set_id, 3, 'dictionary', k || '.txt', md5(CAST(k AS VARCHAR)), k FROM j WHERE place = 2 AND k % 2 = 0)"""


@query(f"WITH {_REGISTRY} SELECT s.set_id, s.problem, CAST(place AS INTEGER) AS place, role, name, sha256, size_bytes FROM s LEFT JOIN f ON f.set_id = s.set_id AND s.problem IS NULL")
def text_sets(spark, d):
    registry = _registry(spark, d)
    asked = registry.select("version", "model_type").distinct().withColumn("rec_lang", F.explode(F.array(*map(F.lit, ("l0", "l1", "l2")))))
    asked = asked.select(F.concat_ws("-", "version", "model_type", "rec_lang").alias("request"), "version", "model_type", F.lit("l0").alias("det_lang"), F.lit("l0").alias("cls_lang"), "rec_lang", (F.col("rec_lang") != "l1").alias("with_classifier"))
    return M.text_model_sets(asked, registry).drop("request")


@query(f"WITH {V.MODEL_FILES}, f AS (SELECT model_set, CASE WHEN length(name) % 2 = 0 THEN name ELSE 'a/' || name END AS name, sha256, CASE WHEN size % 3 = 0 THEN 'other' ELSE role END AS role, count(*) OVER (PARTITION BY model_set, CASE WHEN length(name) % 2 = 0 THEN name ELSE 'a/' || name END) AS n FROM model_files), b AS (SELECT model_set, name, CASE WHEN contains(name, '/') THEN 'name' WHEN n > 1 THEN 'repeated' WHEN sha256 <> '' AND length(sha256) <> 64 THEN 'digest' WHEN role = 'other' THEN 'role' END AS problem FROM f) SELECT * FROM b WHERE problem IS NOT NULL")
def set_problems(spark, d):
    files = V.model_files(spark, d)
    files = files.withColumns({"name": F.when(F.length("name") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("a/"), F.col("name"))), "role": F.when(F.col("size") % 3 == 0, "other").otherwise(F.col("role"))})
    return M.set_problems(files, "model_set")


@query(f"WITH {V.MODEL_FILES} SELECT name, role FROM model_files WHERE model_set = 'Brand#11' OR (NOT EXISTS (SELECT 1 FROM model_files WHERE model_set = 'Brand#11') AND role = 'detector')")
def chosen_files(spark, d):
    files = V.model_files(spark, d)
    return M.chosen_files(files.where("model_set = 'Brand#11'").select("name", "role"), files.where("role = 'detector'").select("name", "role"))


_SEEN = """p AS (SELECT p_partkey AS k, 'f' || p_partkey AS name, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN upper(sha256(chr(8) || chr(7) || p_name)) ELSE sha256(chr(8) || chr(7) || p_name || CASE WHEN p_partkey % 4 = 2 THEN '' ELSE '!' END) END AS expected FROM part
), c AS (SELECT p_partkey AS k, p_partkey % 7 <> 0 AS readable, CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE chr(8) END || chr(7) || p_name AS content, p_partkey % 3 AS old FROM part WHERE p_partkey % 6 <> 0
), o AS (SELECT k, readable, content, CASE WHEN readable THEN sha256(content) END AS digest, CASE old WHEN 0 THEN NULL WHEN 1 THEN sha256(content) ELSE sha256('old') END AS known FROM c)"""


@query(f"WITH {_SEEN} SELECT name, CASE WHEN o.k IS NULL THEN 'missing' WHEN CASE WHEN expected <> '' THEN lower(expected) = digest ELSE starts_with(content, chr(8)) END THEN 'present' ELSE 'corrupt' END AS state, digest AS sha256, CASE WHEN digest IS NULL OR known IS NULL THEN 'first_sight' WHEN known = digest THEN 'hit' ELSE 'content_changed' END AS cause FROM p LEFT JOIN o USING (k)")
def reverify_files(spark, d):
    k, part = F.col("p_partkey"), V.table(spark, d, "part")
    body = F.concat(F.lit("\x08\x07"), F.col("p_name"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    expected = F.when(k % 4 == 0, "").when(k % 4 == 1, F.upper(digest(body))).otherwise(digest(F.concat(body, F.when(k % 4 == 2, "").otherwise("!"))))
    planned = part.select(F.concat(F.lit("f"), k.cast("string")).alias("name"), F.lit("detector").alias("role"), expected.alias("expected"))
    content = F.concat(F.when(k % 5 == 0, "x").otherwise("\x08"), F.lit("\x07"), F.col("p_name"))
    seen = part.where("p_partkey % 6 <> 0").select(F.concat(F.lit("f"), k.cast("string")).alias("name"), (k % 7 != 0).alias("readable"), content.cast("binary").alias("content"), F.when(k % 3 == 1, digest(content)).when(k % 3 == 2, digest(F.lit("old"))).alias("known"))
    return M.reverify(planned, seen).drop("role")


@query("""WITH s0 AS (SELECT p_brand AS model_set, p_partkey AS k, 'f' || p_partkey AS name, CASE WHEN p_partkey % 7 = 0 THEN 'missing' WHEN p_partkey % 13 = 0 THEN 'corrupt' ELSE 'present' END AS state, CASE WHEN p_partkey % 50 <> 0 THEN 'd' ELSE '' END AS sha256, p_partkey * 10 AS size,
  CASE WHEN p_partkey % 29 = 0 THEN 'https://example.org/other' WHEN p_partkey % 37 = 0 THEN 'http://example.org/f' || p_partkey ELSE 'https://example.org/f' || p_partkey END AS url FROM part
), s1 AS (SELECT *, sum(CASE WHEN state <> 'present' THEN size ELSE 0 END) OVER (PARTITION BY model_set ORDER BY k) AS spent FROM s0
), s2 AS (SELECT *, CASE WHEN sha256 = '' THEN 'no digest' WHEN state = 'present' THEN NULL WHEN regexp_extract(url, '([^/]+)$', 1) <> name THEN 'other name' WHEN NOT starts_with(url, 'https') THEN 'scheme' WHEN spent > 60000 THEN 'too large' END AS stop FROM s1
), s3 AS (SELECT *, coalesce(bool_or(stop IS NOT NULL) OVER (PARTITION BY model_set ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after FROM s2)
SELECT model_set, name, CASE WHEN after THEN 'not reached' WHEN stop IS NOT NULL THEN stop WHEN state <> 'present' THEN 'fetch' ELSE 'keep' END AS action FROM s3""")
def downloads(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("f"), k.cast("string"))
    url = F.when(k % 29 == 0, "https://example.org/other").otherwise(F.concat(F.when(k % 37 == 0, "http").otherwise("https"), F.lit("://example.org/"), name))
    files = V.table(spark, d, "part").select(F.col("p_brand").alias("model_set"), k.alias("k"), name.alias("name"), F.when(k % 7 == 0, "missing").when(k % 13 == 0, "corrupt").otherwise("present").alias("state"), F.when(k % 50 != 0, "d").otherwise("").alias("sha256"), (k * 10).cast("long").alias("size_bytes"), url.alias("url"))
    return M.downloads(files, by="model_set", at="k", total=60_000, hosts=("example.org",)).select("model_set", "name", "action")


# --- the job store


@query(f"WITH {V.JOBS}, a AS (SELECT owner, seq, id % 40 AS job, original_bytes, row_number() OVER (PARTITION BY owner, id % 40 ORDER BY queued, seq) = 1 AS accepted, queued FROM jobs) SELECT owner, a.seq AS call, accepted, CASE WHEN accepted THEN CAST(count(*) FILTER (WHERE accepted) OVER w AS BIGINT) - 1 END AS place, CAST(coalesce(sum(original_bytes) FILTER (WHERE accepted) OVER w, 0) AS BIGINT) AS retained FROM a WINDOW w AS (PARTITION BY owner ORDER BY queued, seq ROWS UNBOUNDED PRECEDING)")
def insert_jobs(spark, d):
    calls = V.jobs(spark, d).select("owner", "queued", F.col("seq").alias("call"), (F.col("id") % 40).alias("job"), "original_bytes")
    out = J.insert_jobs(calls, owner="owner", at=["queued", "call"], job="job", size="original_bytes")
    return out.select("owner", "call", "accepted", F.col("seq").alias("place"), "retained")


@query(f"WITH {V.JOBS} SELECT a.id, CASE WHEN a.id % 3 <> 0 AND a.id % 2 = 0 THEN 'live' WHEN a.id % 3 = 0 THEN 'evicted' ELSE 'not_found' END AS found FROM jobs a")
def look_up_jobs(spark, d):
    jobs = V.jobs(spark, d)
    return J.look_up_jobs(jobs.select("id"), jobs.where("id % 3 <> 0 and id % 2 = 0"), jobs.where("id % 3 = 0 or id % 4 = 0"), job="id").select("id", "found")


@query(f"WITH {V.JOBS} SELECT owner, kind, id, CAST(row_number() OVER (PARTITION BY owner, kind ORDER BY queued, seq) - 1 AS INTEGER) AS position FROM jobs WHERE state = 'queued' AND id % 5 <> 0")
def remove_queued(spark, d):
    jobs = V.jobs(spark, d)
    return J.remove_queued(jobs.where("state = 'queued'"), jobs.where("id % 5 = 0"), by=["owner", "kind"], at=["queued", "seq"], job="id").select("owner", "kind", "id", "position")


@query(f"WITH {V.JOBS} SELECT owner, count(*) FILTER (WHERE NOT (state = 'succeeded' AND id % 4 <> 1)) AS removed, CAST(coalesce(sum(result_bytes) FILTER (WHERE state = 'succeeded' AND id % 4 <> 1), 0) AS BIGINT) AS bytes FROM jobs GROUP BY owner")
def retain_only(spark, d):
    jobs = V.jobs(spark, d)
    return J.retain_only(jobs.select("owner", "id", "result_bytes"), jobs.where("state = 'succeeded' and id % 4 <> 1"), owner="owner", job="id", size="result_bytes")[1]


_STATES = ("blocked", "loading", "ready", "failed", "rebuilding", "gone")


@query(f"WITH s AS (SELECT event_id, {list(_STATES)}[event_id % 6 + 1] AS a, {list(_STATES)}[event_id // 6 % 6 + 1] AS b FROM events) SELECT event_id, (a = 'blocked' AND b IN ('loading', 'blocked')) OR (a = 'ready' AND b IN ('loading', 'rebuilding')) OR (a = 'failed' AND b = 'loading') OR (a IN ('loading', 'rebuilding') AND b IN ('ready', 'failed')) AS legal, CASE a WHEN 'ready' THEN 'run' WHEN 'blocked' THEN 'models_missing' WHEN 'loading' THEN 'queue' WHEN 'rebuilding' THEN 'queue' ELSE 'unavailable' END AS admission, event_id % 9 * 3 AS wait FROM s")
def engine_steps(spark, d):
    pick = lambda at: F.element_at(F.array(*map(F.lit, _STATES)), (at + 1).cast("int"))
    i = F.col("event_id")
    a, b = pick(i % 6), pick(F.floor(i / 6) % 6)
    return V.table(spark, d, "events").select("event_id", J.engine_step(a, b)["legal"].alias("legal"), J.engine_admission(a).alias("admission"), J.wait_bound(i % 9, 3).alias("wait"))


_CALLS = """q0 AS (SELECT user_id % 50 AS owner, event_id AS call, CASE event_id % 5 WHEN 0 THEN 'take' WHEN 1 THEN 'take' WHEN 4 THEN 'remove' ELSE 'enqueue' END AS op, CASE WHEN event_id % 3 = 0 THEN 'formula' ELSE 'text' END AS kind, CASE WHEN event_id % 5 = 4 THEN event_id - 100 ELSE event_id END AS id FROM events
), q AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY call) AS n FROM q0)"""


@query(f"""WITH RECURSIVE {_CALLS}, w AS (SELECT owner, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS call, '' AS outcome, CAST([] AS BIGINT[]) AS t, CAST([] AS BIGINT[]) AS f, 0 AS st, 0 AS sf FROM (SELECT DISTINCT owner FROM q)
  UNION ALL SELECT owner, n, call,
    CASE WHEN op = 'enqueue' THEN CASE WHEN (kind = 'text' AND len(t) >= 6) OR (kind = 'formula' AND len(f) >= 6) THEN 'busy' WHEN kind = 'text' THEN CAST(len(t) AS VARCHAR) ELSE CAST(len(f) AS VARCHAR) END
      WHEN op = 'remove' THEN CASE WHEN list_contains(CASE WHEN kind = 'text' THEN t ELSE f END, id) THEN 'removed' ELSE 'absent' END
      WHEN x AND len(t) > 0 THEN CAST(t[1] AS VARCHAR) WHEN NOT x AND len(f) > 0 THEN CAST(f[1] AS VARCHAR) ELSE 'nothing' END,
    CASE WHEN op = 'enqueue' AND kind = 'text' AND len(t) < 6 THEN list_append(t, id) WHEN op = 'remove' AND kind = 'text' THEN list_filter(t, lambda y: y <> id) WHEN op = 'take' AND x THEN t[2:] ELSE t END,
    CASE WHEN op = 'enqueue' AND kind = 'formula' AND len(f) < 6 THEN list_append(f, id) WHEN op = 'remove' AND kind = 'formula' THEN list_filter(f, lambda y: y <> id) WHEN op = 'take' AND NOT x THEN f[2:] ELSE f END,
    CASE WHEN st + dt >= 2 AND sf + df >= 1 THEN 0 ELSE st + dt END, CASE WHEN st + dt >= 2 AND sf + df >= 1 THEN 0 ELSE sf + df END
  FROM (SELECT q.owner, q.n, q.call, op, kind, id, t, f, st, sf, len(t) > 0 AND (len(f) = 0 OR st < 2) AS x, CASE WHEN op = 'take' AND len(t) > 0 AND (len(f) = 0 OR st < 2) THEN 1 ELSE 0 END AS dt, CASE WHEN op = 'take' AND NOT (len(t) > 0 AND (len(f) = 0 OR st < 2)) AND len(f) > 0 THEN 1 ELSE 0 END AS df FROM w JOIN q ON q.owner = w.owner AND q.n = w.n + 1))
SELECT owner, call, outcome FROM w WHERE n > 0""")
def queue_replay(spark, d):
    i = F.col("event_id")
    op = F.when(i % 5 < 2, "take").when(i % 5 == 4, "remove").otherwise("enqueue")
    calls = V.table(spark, d, "events").select((F.col("user_id") % 50).alias("owner"), i.alias("call"), op.alias("op"), F.when(i % 3 == 0, "formula").otherwise("text").alias("kind"), F.when(i % 5 == 4, i - 100).otherwise(i).alias("id"))
    return J.queue_replay(calls, owner="owner", at=["call"], text_quota=2, formula_quota=1, capacity=6)


@query("""WITH r AS (SELECT event_id AS i FROM events) SELECT i, concat_ws(',', CASE WHEN i % 4 = 0 AND i % 3 = 0 THEN 'stage' END, CASE WHEN i % 5 = 0 AND i % 3 = 0 THEN 'words' END, CASE WHEN i % 7 = 0 AND i % 2 = 0 THEN 'formula model' END, CASE WHEN i % 7 = 0 AND i % 11 = 0 THEN 'formulas in a region' END, CASE WHEN i % 7 = 0 AND i % 6 = 0 THEN 'formulas in tiles' END,
  CASE WHEN i % 6 = 0 AND NOT (i % 50 > 0 AND i % 20 < i % 50) THEN 'tiles' END, CASE WHEN i % 13 > 10 THEN 'box_threshold' END, CASE WHEN i % 8 <> 1 AND i % 9 = 0 THEN 'max_side' END) AS violations FROM r
WHERE (i % 4 = 0 AND i % 3 = 0) OR (i % 5 = 0 AND i % 3 = 0) OR (i % 7 = 0 AND (i % 2 = 0 OR i % 11 = 0 OR i % 6 = 0)) OR (i % 6 = 0 AND NOT (i % 50 > 0 AND i % 20 < i % 50)) OR i % 13 > 10 OR (i % 8 <> 1 AND i % 9 = 0)""")
def request_violations(spark, d):
    i = F.col("i")
    rows = V.table(spark, d, "events").select(F.col("event_id").alias("i")).withColumns({
        "detection": i % 4 != 0, "classification": F.lit(False), "recognition": i % 3 != 0, "words": i % 5 == 0, "formulas": i % 7 == 0, "formula_model": F.when(i % 2 != 0, "m"), "roi": i % 11 == 0,
        "tile_width": F.when(i % 6 == 0, i % 50), "tile_height": i % 50, "tile_overlap": i % 20, "box_threshold": (i % 13) / 10, "text_score": F.lit(None).cast("double"),
        "max_side": F.when(i % 8 != 1, (i % 9).cast("double")), "scale_hint": F.lit(1.0), "unclip_ratio": F.lit(None).cast("double"),
    })
    return L.violations(rows, Q.request_rules()).select("i", "violations")


@query("SELECT event_id, concat_ws(',', CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'formula without outcome' END, CASE WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 'formula with text' END, CASE WHEN event_id % 3 <> 0 AND event_id % 2 <> 0 THEN 'text with formula' END, CASE WHEN event_id % 12 > 10 THEN 'score' END, CASE WHEN event_id % 40 + 25 > 60 THEN 'polygon' END) AS violations FROM events WHERE (event_id % 3 = 0 AND (event_id % 2 = 0 OR event_id % 5 = 0)) OR (event_id % 3 <> 0 AND event_id % 2 <> 0) OR event_id % 12 > 10 OR event_id % 40 + 25 > 60")
def region_rules(spark, d):
    i = F.col("event_id")
    x = (i % 40).cast("double")
    rows = V.table(spark, d, "events").select("event_id", F.when(i % 3 == 0, "formula").otherwise("text").alias("kind"), F.when(i % 5 == 0, "t").alias("text"), F.when(i % 2 != 0, "l").alias("latex"), ((i % 12) / 10).alias("score"), G.box_quad(x, F.lit(0.0), x + 25, F.lit(9.0)).alias("polygon"))
    return L.violations(rows, L.region_rules(F.lit(60), F.lit(10))).select("event_id", "violations")


@query("SELECT event_id, event_id % 9 > 0 AND event_id % 7 > 0 AND event_id % 50 + event_id % 9 <= 52 AND event_id % 30 + event_id % 7 <= 33 AS inside, event_id % 50 > 0 AND event_id % 30 > 0 AND event_id % 50 * (event_id % 30) <= 700 AS decodable, event_id % 9 > 0 AND event_id % 7 > 0 AND event_id % 50 >= event_id % 9 * 3 AND 200 >= event_id % 50 * (event_id % 7) AS fits FROM events")
def buffer_checks(spark, d):
    i = F.col("event_id")
    return V.table(spark, d, "events").select("event_id", G.region_in_image(i % 50, i % 30, i % 9, i % 7, F.lit(52), F.lit(33)).alias("inside"), P.decodable(i % 50, i % 30, 700).alias("decodable"), P.buffer_fits(i % 9, i % 7, i % 50, 3, F.lit(200)).alias("fits"))


@query("SELECT role, round(avg(cer), 9) AS mean_cer, round(avg(CAST(exact AS INTEGER)), 9) AS exact_match_rate, round(avg(precision), 9) AS mean_precision, round(avg(recall), 9) AS mean_recall, avg(NULL::DOUBLE) AS mean_iou FROM (SELECT role, (conv_id % 7) / 7.0 AS cer, turn % 2 = 0 AS exact, CASE WHEN conv_id % 3 > 0 THEN (conv_id % 3) / 4.0 END AS precision, (turn % 5) / 5.0 AS recall FROM conversations) GROUP BY role")
def page_summary(spark, d):
    c, t = F.col("conv_id"), F.col("turn")
    cases = V.table(spark, d, "conversations").select("role", (c % 7 / 7.0).alias("cer"), (t % 2 == 0).alias("exact"), F.when(c % 3 > 0, c % 3 / 4.0).alias("precision"), (t % 5 / 5.0).alias("recall"), F.lit(None).cast("double").alias("iou"))
    out = E.page_summary(cases, ["role"])
    return out.select("role", *[F.round(n, 9).alias(n) for n in ("mean_cer", "exact_match_rate", "mean_precision", "mean_recall")], "mean_iou")


# --- geometry


@query(f"WITH {V.REGIONS}, {_PAIRS_IOU} SELECT page, a, b, round(iou + 1e-9, 6) AS iou FROM iou WHERE a < b AND iou > 0.3 AND abs(iou - 0.3) > 1e-6")
def rotated_iou(spark, d):
    """Quads turned by the same angle overlap as the upright boxes do."""
    turned = lambda x, y: G.point(F.col(x) * 0.6 - F.col(y) * 0.8, F.col(x) * 0.8 + F.col(y) * 0.6)
    quad = F.array(turned("x0", "y0"), turned("x1", "y0"), turned("x1", "y1"), turned("x0", "y1"))
    rows = V.regions(spark, d).select("page", "rid", quad.alias("q"))
    pairs = rows.select("page", F.col("rid").alias("a"), F.col("q").alias("qa")).join(rows.select("page", F.col("rid").alias("b"), F.col("q").alias("qb")), "page").where("a < b")
    out = pairs.select("page", "a", "b", G.quad_iou("qa", "qb").alias("iou")).where((F.col("iou") > 0.3) & (F.abs(F.col("iou") - 0.3) > 1e-6))
    return out.withColumn("iou", F.round(F.col("iou") + 1e-9, 6))  # clear of halves


_POINTS = f"""{V.REGIONS}, pt AS (SELECT DISTINCT page, x, y FROM (SELECT page, x0 AS x, y0 AS y FROM regions UNION ALL SELECT page, x1, y0 FROM regions UNION ALL SELECT page, x1, y1 FROM regions UNION ALL SELECT page, x0, y1 FROM regions)
), edge AS (SELECT a.page, a.x AS px, a.y AS py, b.x AS qx, b.y AS qy FROM pt a JOIN pt b ON a.page = b.page AND (a.x <> b.x OR a.y <> b.y)
  WHERE NOT EXISTS (SELECT 1 FROM pt c WHERE c.page = a.page AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
    OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND ((c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y)) > 0)))
), hull AS (SELECT page, count(*) AS corners, sum(px * qy - qx * py) / 2 AS area FROM edge GROUP BY page
), side AS (SELECT page, px, py, qx, qy, sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)) AS n FROM edge
), ext AS (SELECT s.page, px, py, qx, qy, max((p.x * (qx - px) + p.y * (qy - py)) / n) - min((p.x * (qx - px) + p.y * (qy - py)) / n) AS w, max((p.y * (qx - px) - p.x * (qy - py)) / n) - min((p.y * (qx - px) - p.x * (qy - py)) / n) AS h FROM side s JOIN pt p ON p.page = s.page GROUP BY ALL)"""


@query(f"WITH {_POINTS}, least_rect AS (SELECT page, min(w * h) AS area FROM ext GROUP BY page) SELECT page, corners, round(hull.area, 6) AS area, round(least_rect.area, 4) AS rect_area, 4 AS rect_corners FROM hull JOIN least_rect USING (page)")
def hulls(spark, d):
    quad = F.array(*[G.point(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    pages = V.regions(spark, d).groupBy("page").agg(F.flatten(F.collect_list(quad)).alias("ps"))
    rows = pages.select("page", G.convex_hull("ps").alias("hull"), G.min_area_rect("ps").alias("rect"))
    return rows.select("page", F.size("hull").cast("long").alias("corners"), F.round(G.polygon_area(F.col("hull")), 6).alias("area"), F.round(G.polygon_area(F.col("rect")), 4).alias("rect_area"), F.size("rect").alias("rect_corners"))


@query(f"WITH {V.REGIONS} SELECT page, rid, x0 AS tl_x, y0 AS tl_y, x1 AS br_x, y1 AS br_y, x1 - x0 AS width, round(y0 - 1, 9) AS turned_x, round(5 - x0, 9) AS turned_y, CASE WHEN (x1 - x0) * 3 - (y1 - y0) * 4 > 0 THEN 1 ELSE 0 END AS left_of FROM regions")
def corner_measures(spark, d):
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    quad = G.order_by_rows(F.array(G.point(x1, y1), G.point(x0, y0), G.point(x1, y0), G.point(x0, y1)))
    b, turned = G.bounds(quad), G.rotate(G.point(x0, y0), F.lit(np.pi / 2), G.point(2.0, 3.0))
    side = G.cross(G.point(0.0, 0.0), G.point(x1 - x0, y1 - y0), G.point(4.0, 3.0))
    return V.regions(spark, d).select("page", "rid", b["x0"].alias("tl_x"), b["y0"].alias("tl_y"), b["x1"].alias("br_x"), b["y1"].alias("br_y"), G.distance(quad[0], quad[1]).alias("width"), F.round(turned["x"], 9).alias("turned_x"), F.round(turned["y"], 9).alias("turned_y"), F.when(side > 0, 1).otherwise(0).alias("left_of"))


_PLACED = "x0 * 0.6 - y0 * 0.8 + {u} * 0.6 - {v} * 0.8 AS {n}_x, x0 * 0.8 + y0 * 0.6 + {u} * 0.8 + {v} * 0.6 AS {n}_y"


@query(f"WITH {V.REGIONS}, w AS (SELECT page, rid, {_PLACED.format(u='2.0', v='2.0', n='a')}, {_PLACED.format(u='(x1 - x0 - 3.0)', v='4.0', n='b')} FROM regions) SELECT page, rid, round(a_x, 4) + 0.0 AS a_x, round(a_y, 4) + 0.0 AS a_y, round(b_x, 4) + 0.0 AS b_x, round(b_y, 4) + 0.0 AS b_y FROM w")
def words_on_page(spark, d):
    """A word's box in the crop of a turned line, and in one that was read upright by a quarter turn, back on the page."""
    turned = lambda x, y: G.point(F.col(x) * 0.6 - F.col(y) * 0.8, F.col(x) * 0.8 + F.col(y) * 0.6)
    line = F.array(turned("x0", "y0"), turned("x1", "y0"), turned("x1", "y1"), turned("x0", "y1"))
    word = G.box_quad(F.lit(2.0), F.lit(1.0), F.lit(4.0), F.lit(2.0))
    rows = V.regions(spark, d).select("page", "rid", G.words_to_page(line, F.array(word), F.lit(False)).alias("across"), G.words_to_page(line, F.array(G.box_quad(F.lit(2.0), F.lit(1.0), F.lit(4.0), F.lit(3.0))), F.lit(True)).alias("down"))
    first = {"a": F.col("across")[0][0], "b": F.col("down")[0][0]}
    return rows.select("page", "rid", *[(F.round(p[k], 4) + 0.0).alias(f"{n}_{k}") for n, p in first.items() for k in ("x", "y")])


@query(f"WITH {V.REGIONS} SELECT page, rid, x0 + greatest(coalesce(lag(x1) OVER w, x0) - x0, 0) / 2 AS x0, x1 - greatest(x1 - coalesce(lead(x0) OVER w, x1), 0) / 2 AS x1 FROM regions WINDOW w AS (PARTITION BY page ORDER BY rid)")
def spread_boxes(spark, d):
    box = F.struct("x0", "y0", "x1", "y1")
    pages = V.regions(spark, d).groupBy("page").agg(F.array_sort(F.collect_list(F.struct(F.col("rid"), box.alias("b")))).alias("rs"))
    out = F.arrays_zip(F.transform("rs", lambda r: r["rid"]).alias("rid"), G.spread_overlaps(F.transform("rs", lambda r: r["b"])).alias("b"))
    return pages.select("page", F.explode(out).alias("r")).select("page", "r.rid", "r.b.x0", "r.b.x1")


# --- frames and words

_KEPT = f"""{V.FRAMES}, fr AS (SELECT line, row_number() OVER (PARTITION BY line ORDER BY ts, event_id) - 1 AS col, token, token <> 0 AND token IS DISTINCT FROM lag(token) OVER (PARTITION BY line ORDER BY ts, event_id) AS k FROM frames
), ch AS (SELECT line, col, token, ['a', '中', ' ', 'b'][token] AS c, row_number() OVER (PARTITION BY line ORDER BY col) - 1 AS i, col - lag(col) OVER (PARTITION BY line ORDER BY col) AS gap, lag(token) OVER (PARTITION BY line ORDER BY col) AS before FROM fr WHERE k
), br AS (SELECT *, CASE WHEN i = 0 OR before = 3 OR (before = 2) <> (token = 2) OR gap > 5 THEN 1 ELSE 0 END AS b FROM ch WHERE token <> 3
), wd AS (SELECT *, sum(b) OVER (PARTITION BY line ORDER BY i) - 1 AS w FROM br)"""


def _word_lines(spark, d) -> DataFrame:
    w = Window.partitionBy("line").orderBy("ts", "event_id")
    letter = F.element_at(F.array(*map(F.lit, ("a", "中", " ", "b"))), F.greatest("token", F.lit(1)))
    kept = (F.col("token") != 0) & ~F.col("token").eqNullSafe(F.lag("token").over(w))
    rows = V.frames(spark, d).select("line", F.row_number().over(w).alias("n"), letter.alias("c"), kept.alias("k"))
    lines = rows.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("n", "c", "k"))).alias("fs"))
    text = F.array_join(F.transform(F.filter("fs", lambda x: x["k"]), lambda x: x["c"]), "")
    return lines.select("line", O.word_islands(text, F.transform("fs", lambda x: x["k"])).alias("words"))


@query(f"WITH {_KEPT} SELECT line, CAST(w AS INTEGER) AS nth, string_agg(c, '' ORDER BY i) AS word, CASE WHEN any_value(token) = 2 THEN 'cn' ELSE 'en' END AS kind, CAST(min(col) AS INTEGER) AS first_col, CAST(max(col) AS INTEGER) AS last_col FROM wd GROUP BY line, w")
def word_islands(spark, d):
    rows = _word_lines(spark, d).select("line", F.posexplode("words").alias("nth", "w"))
    return rows.select("line", "nth", "w.word", "w.kind", F.array_min("w.cols").alias("first_col"), F.array_max("w.cols").alias("last_col"))


@query(f"WITH {_KEPT}, ws AS (SELECT line, w, count(*) AS n, min(col) AS lo, max(col) AS hi, min(greatest(floor(greatest((col + 0.5) * 5 - 2, 0)), 0)) AS x0, max(floor(least((col + 0.5) * 5 + 2, 90000))) AS x1 FROM wd GROUP BY line, w), m AS (SELECT line, avg((hi - lo) * 5.0 / (n - 1)) FILTER (WHERE n > 1) AS mean, sum(n) AS chars FROM ws GROUP BY line) SELECT line, CAST(w AS INTEGER) AS nth, CAST(x0 + 10 AS DOUBLE) AS x0, CAST(x1 + 10 AS DOUBLE) AS x1, round(coalesce(mean, 90000.0 / chars), 6) AS char_width FROM ws JOIN m USING (line)")
def word_boxes(spark, d):
    lines = _word_lines(spark, d).withColumn("cols", F.transform("words", lambda w: w["cols"]))
    box = F.struct(F.lit(10.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(90010.0).alias("x1"), F.lit(9.0).alias("y1"))
    n = F.aggregate("cols", F.lit(0), lambda s, c: s + F.size(c))
    width = G.line_char_width(F.col("cols"), F.lit(5.0), box, n)
    rows = lines.select("line", F.round(width, 6).alias("char_width"), F.posexplode(G.word_boxes(F.col("cols"), F.lit(4.0), F.lit(5.0), box, F.lit(True))).alias("nth", "b"))
    return rows.select("line", "nth", "b.x0", "b.x1", "char_width")


@query("SELECT event_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS best, list_max(v) AS value FROM (SELECT event_id, [event_id * 7 % 10, event_id * 11 % 10, event_id * 13 % 10, event_id * 17 % 10] AS v FROM events)")
def argmax_frames(spark, d):
    i = F.col("event_id")
    values = F.array(i * 7 % 10, i * 11 % 10, i * 13 % 10, i * 17 % 10)
    return V.table(spark, d, "events").select("event_id", O.argmax(values).alias("best"), F.array_max(values).alias("value"))


_PIECES = ("<s>", "<pad>", "</s>", "<unk>", "Ġalpha", "Ġx", "^2", "{", "}", "中")
_IDS = f"{V.FRAMES}, t AS (SELECT line, list(CAST(CASE WHEN token = 4 AND event_id % 50 > 0 THEN 9 WHEN token = 4 THEN 2 WHEN token = 0 THEN event_id % 2 ELSE token + 3 + event_id % 2 END AS BIGINT) ORDER BY ts, event_id) AS ids FROM frames GROUP BY line)"


@query(f"WITH {_IDS}, p AS (SELECT line, CASE WHEN list_position(ids, 2) > 0 THEN ids[: list_position(ids, 2)] ELSE ids END AS ids, list_position(ids, 2) AS e FROM t) SELECT line, trim(replace(array_to_string(list_transform(list_filter(ids, lambda i: i > 3), lambda i: {list(_PIECES)}[i + 1]), ''), 'Ġ', ' ')) AS text, CASE WHEN e > 0 THEN CAST(e - 1 AS INTEGER) END AS eos_index, coalesce(e, 0) = 0 AS truncated FROM p")
def decode_tokens(spark, d):
    t, i = F.col("token"), F.col("event_id")
    ident = F.when((t == 4) & (i % 50 > 0), 9).when(t == 4, 2).when(t == 0, i % 2).otherwise(t + 3 + i % 2).cast("long")
    lines = V.frames(spark, d).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", ident.alias("id")))).alias("fs"))
    rows = lines.select("line", F.transform("fs", lambda x: x["id"]).alias("ids"))
    vocab = F.create_map(*[x for k, piece in enumerate(_PIECES) for x in (F.lit(k).cast("long"), F.lit(piece))])
    return D.decode_tokens(rows, "ids", vocab).drop("ids")


# --- pixels: a small image a part, its pixels by a rule

_PX = "px AS (SELECT p_partkey AS p, y, x, (p_partkey * 31 + y * 17 + x * 7) % 256 AS v FROM part, (SELECT unnest(range(4)) AS y), (SELECT unnest(range(6)) AS x))"


def _images(spark, d, channels: int = 1) -> DataFrame:
    """p, w, h, data: six by four pixels."""
    at = F.sequence(F.lit(0), F.lit(24 * channels - 1))
    k = lambda i: F.floor(i / channels)
    value = lambda i: (F.col("p") * 31 + F.floor(k(i) / 6) * 17 + k(i) % 6 * 7 + i % channels * 41) % 256
    data = F.unhex(F.array_join(F.transform(at, lambda i: F.lpad(F.hex(value(i).cast("long")), 2, "0")), ""))
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("p")).select("p", F.lit(6).alias("w"), F.lit(4).alias("h"), data.alias("data"))


def _pixels(images: DataFrame, channels: int = 1) -> DataFrame:
    rows = images.select("p", "w", F.col("data"), F.explode(F.sequence(F.lit(0), F.octet_length("data") - 1)).alias("i"))
    value = F.conv(F.hex(F.substring(F.col("data"), F.col("i") + 1, F.lit(1))), 16, 10).cast("long")
    k = F.floor(F.col("i") / channels)
    out = [F.floor(k / F.col("w")).cast("long").alias("y"), (k % F.col("w")).cast("long").alias("x"), value.alias("v")]
    return rows.select("p", *out) if channels == 1 else rows.select("p", *out, (F.col("i") % channels).cast("long").alias("c"))


_TURNS = {1: ("y", "x"), 2: ("y", "5 - x"), 3: ("3 - y", "5 - x"), 4: ("3 - y", "x"), 5: ("x", "y"), 6: ("x", "3 - y"), 7: ("5 - x", "3 - y"), 8: ("5 - x", "y")}


@query(f"WITH {_PX} SELECT p, CAST(CASE p % 8 + 1 {' '.join(f'WHEN {k} THEN {y}' for k, (y, _) in _TURNS.items())} END AS BIGINT) AS y, CAST(CASE p % 8 + 1 {' '.join(f'WHEN {k} THEN {x}' for k, (_, x) in _TURNS.items())} END AS BIGINT) AS x, v FROM px")
def turn_pixels(spark, d):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            turned = [P.oriented(P.pixels_of(b, 6, 4, 6, 1), int(p) % 8 + 1) for p, b in zip(pdf["p"], pdf["data"], strict=True)]
            yield pdf.assign(data=[np.ascontiguousarray(t).tobytes() for t in turned], w=[t.shape[1] for t in turned], h=[t.shape[0] for t in turned])

    rows = _images(spark, d)
    return _pixels(rows.mapInPandas(run, rows.schema))


@query(f"WITH {_PX} SELECT p, y // 2 AS y, x // 2 AS x, CAST((sum(v) + 2) AS BIGINT) >> 2 AS v FROM px GROUP BY p, y // 2, x // 2")
def halve_pixels(spark, d):
    return _pixels(P.map_images(_images(spark, d), lambda image: P.resize_linear(image, 3, 2), channels=1))


@query(f"WITH {_PX} SELECT p, y // 3 AS y, x // 4 AS x, ((CAST(sum(v) AS BIGINT) + count(*) // 2) * (16777216 // count(*))) >> 24 AS v FROM px GROUP BY p, y // 3, x // 4")
def reduce_pixels(spark, d):
    return _pixels(P.map_images(_images(spark, d), lambda image: P.reduce_box(image, 4, 3), channels=1))


@query(f"WITH {_PX} SELECT p, y, x, CASE WHEN greatest(v, coalesce(lag(v) OVER r, 0), coalesce(up, 0), coalesce(lag(up) OVER r, 0)) > 100 THEN 1 ELSE 0 END AS v FROM (SELECT *, lag(v) OVER (PARTITION BY p, x ORDER BY y) AS up FROM px) WINDOW r AS (PARTITION BY p, y ORDER BY x)")
def dilate_pixels(spark, d):
    return _pixels(P.map_images(_images(spark, d), lambda image: P.dilate_2x2(P.threshold_mask(image[..., 0], 100))[..., None], channels=1))


@query(f"WITH {_PX}, s AS (SELECT unnest(range(8)) AS y), t AS (SELECT unnest(range(8)) AS x) SELECT p_partkey AS p, s.y, t.x, coalesce(v, 0) AS v FROM part, s, t LEFT JOIN px ON px.p = p_partkey AND px.y = s.y - 2 AND px.x = t.x - 1")
def square_pixels(spark, d):
    return _pixels(P.map_images(_images(spark, d), lambda image: P.pad_to_square(image, 8), channels=1))


_RGBA = "cx AS (SELECT p_partkey AS p, y, x, c, (p_partkey * 31 + y * 17 + x * 7 + c * 41) % 256 AS v FROM part, (SELECT unnest(range(4)) AS y), (SELECT unnest(range(6)) AS x), (SELECT unnest(range(4)) AS c)), ax AS (SELECT p, y, x, v AS a FROM cx WHERE c = 3)"


@query(f"WITH {_RGBA} SELECT p, y, x, (v * a + 255 * (255 - a)) // 255 AS v, 2 - c AS c FROM cx JOIN ax USING (p, y, x) WHERE c < 3")
def blend_pixels(spark, d):
    return _pixels(P.map_images(_images(spark, d, 4), lambda image: P.swap_channels(P.flatten_alpha(image, 255)), channels=4), 3)


@query(f"WITH {_RGBA}, l AS (SELECT p, y, x, sum(v * [0.299, 0.587, 0.114][c + 1]) AS luma FROM cx WHERE c < 3 GROUP BY ALL), m AS (SELECT p, avg(luma) FILTER (WHERE a > 0) AS mean FROM l JOIN ax USING (p, y, x) GROUP BY p) SELECT p, CASE WHEN coalesce(mean, 0) < 128 THEN 255 ELSE 0 END AS background FROM m WHERE abs(mean - 128) > 1e-6")
def image_backgrounds(spark, d):
    rows = _pixels(_images(spark, d, 4), 4)
    pixels = rows.groupBy("p", "y", "x").pivot("c", [0, 1, 2, 3]).agg(F.first("v")).withColumnsRenamed({"0": "r", "1": "g", "2": "b", "3": "a"})
    near = pixels.groupBy("p").agg(F.avg(F.when(F.col("a") > 0, 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b"))).alias("mean")).where(F.abs(F.col("mean") - 128) > 1e-6)
    return P.auto_background(pixels, ["p"]).join(near.select("p"), "p")


@query(f"WITH {_PX} SELECT p, y, x, v, c FROM px, (SELECT unnest(range(3)) AS c)")
def gray_pixels(spark, d):
    return _pixels(P.map_images(_images(spark, d), lambda image: P.gray_to_bgr(image[..., 0]), channels=1), 3)


@query(f"WITH {_PX} SELECT p, round(avg(v) FILTER (WHERE y <= 2 AND x BETWEEN 1 AND 4) / 256, 9) AS score, round(coalesce(avg(v) FILTER (WHERE v > 100), 0), 9) AS mean FROM px GROUP BY p")
def contour_scores(spark, d):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images = [P.pixels_of(b, 6, 4, 6, 1)[..., 0].astype(float) for b in pdf["data"]]
            yield pd.DataFrame({"p": pdf["p"], "score": [P.contour_score(i / 256, [(1, 0), (4, 0), (4, 2), (1, 2)]) for i in images], "mean": [P.masked_mean(i, P.threshold_mask(i, 100)) for i in images]})

    return _images(spark, d).mapInPandas(run, "p long, score double, mean double").select("p", F.round("score", 9).alias("score"), F.round("mean", 9).alias("mean"))


@query(f"WITH {_PX} SELECT p, y, x, CASE WHEN y <= 2 AND x BETWEEN 1 AND 3 THEN 255 ELSE v END AS v FROM px")
def whiten_pixels(spark, d):
    return _pixels(P.map_images(_images(spark, d), lambda image: P.whitened(image, [[(0.6, -3.0), (3.4, -3.0), (3.4, 2.2), (0.6, 2.2)]]), channels=1))


@query(f"WITH {_PX} SELECT 'img/' || p || '.png' AS path, 6 AS w, 4 AS h, y, x, v FROM px")
def png_pixels(spark, d):
    """PNG files by way of bytes: sizes from headers, then pixels; every row filter of the format is used."""
    import struct
    import zlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        for pdf in batches:
            files = []
            for data in pdf["data"]:
                rows, above, lines = np.frombuffer(data, np.uint8).reshape(4, 6).astype(int), np.zeros(6, int), []
                for y, row in enumerate(rows):
                    left = np.concatenate([[0], row[:-1]])
                    guess = (np.zeros(6, int), left, above, (left + above) // 2)[y]
                    lines.append(bytes([y]) + ((row - guess) % 256).astype(np.uint8).tobytes())
                    above = row
                files.append(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 6, 4, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b""))
            yield pd.DataFrame({"path": "img/" + pdf["p"].astype(str) + ".png", "content": files})

    files = _images(spark, d).mapInPandas(run, "path string, content binary")
    images = I.decoded(I.with_dimensions(files, 100).select("path", "content"))
    return _pixels(images.withColumnRenamed("path", "p")).select(F.col("p").alias("path"), F.lit(6).alias("w"), F.lit(4).alias("h"), "y", "x", "v")


@query("SELECT page_id, sha256(encode(html)[1:200]) AS head, sha256(CASE WHEN strlen(html) > 200 THEN encode(html)[-200:] ELSE encode(html) END) AS tail, CAST(NULL AS VARCHAR) AS failure, lower(hex(encode(html)[1:2])) AS begins FROM pages")
def partial_digests(spark, d):
    content = F.encode("html", "UTF-8")
    digest = M.partial_digest(content, 200)
    return V.table(spark, d, "pages").select("page_id", digest["head"].alias("head"), digest["tail"].alias("tail"), F.when(M.looks_like_model(content), "model").alias("failure"), F.replace(M.undeclared_failure(content), F.lit("begins with "), F.lit("")).alias("begins"))


# --- models and addresses that are passed in


@query("WITH b AS (SELECT p_partkey AS page, 200 + p_partkey % 300 AS w, 100 + p_size * 7 AS h FROM part), s AS (SELECT *, least(768.0 / w, 768.0 / h) AS k FROM b), l AS (SELECT *, floor((768 - floor(w * k + 0.5)) / 2 - 0.1 + 0.5) AS px, floor((768 - floor(h * k + 0.5)) / 2 - 0.1 + 0.5) AS py FROM s) SELECT page, 'formula' AS class_name, round(least(greatest((300 - px) / k, 0), w), 6) AS x0, round(least(greatest((350 - py) / k, 0), h), 6) AS y0, round(least(greatest((500 - px) / k, 0), w), 6) AS x1, round(least(greatest((450 - py) / k, 0), h), 6) AS y1, true AS detected FROM l WHERE least(greatest((500 - px) / k, 0), w) > least(greatest((300 - px) / k, 0), w) AND least(greatest((450 - py) / k, 0), h) > least(greatest((350 - py) / k, 0), h)")
def detect_candidates(spark, d):
    anchors = [{"cx": 400.0, "cy": 400.0, "w": 200.0, "h": 100.0, "scores": [0.9]}, {"cx": 405.0, "cy": 400.0, "w": 200.0, "h": 100.0, "scores": [0.8]}, {"cx": 10.0, "cy": 10.0, "w": 5.0, "h": 5.0, "scores": [0.1]}]
    images = V.table(spark, d, "part").select(F.col("p_partkey").alias("page"), (200 + F.col("p_partkey") % 300).cast("int").alias("width"), (100 + F.col("p_size") * 7).cast("int").alias("height"))
    out = T.detect_candidates(images, P.constant_model({"anchors": anchors}), page="page", side=768, names=F.array(F.lit("formula")), confidence=0.25, overlap=0.7, limit=10)
    return out.select("page", "class_name", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")], "detected")


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'scheme' WHEN 2 THEN 'host' WHEN 3 THEN 'too many' ELSE 'no place' END AS refusal FROM pages")
def redirect_refusals(spark, d):
    k, good = F.col("page_id") % 5, F.concat(F.lit("https://example.org/"), F.col("page_id").cast("string"))
    hops = F.when(k == 0, F.array(good, good, good, good, good)).when(k == 1, F.array(good, F.lit("http://example.org/a"))).when(k == 2, F.array(good, F.lit("https://example.org.evil/a"))).when(k == 3, F.array_repeat(good, 6)).otherwise(F.array(good, F.lit(None).cast("string")))
    return V.table(spark, d, "pages").select("page_id", A.redirect_refusal(hops, ("example.org",)).alias("refusal"))


@query("SELECT p_brand AS model_set, p_partkey AS k, CAST(row_number() OVER w AS INTEGER) AS idx, count(*) OVER (PARTITION BY p_brand) AS total, CAST(coalesce(sum(p_partkey * 10) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bytes_before FROM part WHERE p_partkey % 7 = 0 WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)")
def download_progress(spark, d):
    k = F.col("p_partkey")
    files = V.table(spark, d, "part").select(F.col("p_brand").alias("model_set"), k.alias("k"), F.when(k % 7 == 0, "missing").otherwise("present").alias("state"), (k * 10).alias("size"))
    out = A.progress(files, by="model_set", at="k", size="size")
    return out.select("model_set", "k", F.col("index").alias("idx"), "total", "bytes_before")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'network: ValueError' WHEN 2 THEN 'too many bytes' ELSE 'not an image' END AS failure, page_id % 4 = 0 AS has_content FROM pages")
def read_addresses(spark, d):
    """Addresses behind a function that makes up what is there."""
    import io
    import struct

    def open_url(url: str) -> io.BytesIO:
        number = int(url.rsplit("/", 1)[1])
        if number % 4 == 1:
            raise ValueError(url)
        head = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 6, 4, 8, 0, 0, 0, 0)
        return io.BytesIO(head + b"x" * 1000 if number % 4 == 2 else head if number % 4 == 0 else b"<html>")

    rows = V.table(spark, d, "pages").select("page_id", F.concat(F.lit("https://example.org/"), F.col("page_id").cast("string")).alias("url"))
    out = A.read_addresses(rows, "url", open_url=open_url, most_bytes=500, most_pixels=100)
    return out.select("page_id", "failure", F.col("content").isNotNull().alias("has_content"))


@query("SELECT 'evaluations' AS section, CAST(row_number() OVER (ORDER BY lang, source) - 1 AS INTEGER) AS place, '{\"dataset\":\"' || lang || '\",\"split\":\"' || source || '\",\"total\":' || n || '}' AS entry FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) UNION ALL SELECT 'dataset_manifests', CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER), '{\"dataset\":\"' || lang || '\",\"limit\":0,\"entry_count\":' || n || '}' FROM (SELECT lang, count(*) AS n FROM documents GROUP BY ALL) UNION ALL SELECT 'reference_comparison', CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER), '{\"dataset\":\"' || lang || '\",\"link_differences\":2}' FROM (SELECT DISTINCT lang FROM documents) UNION ALL SELECT 'benchmarks', CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER), '{\"source\":\"' || source || '\",\"n\":' || n || '}' FROM (SELECT source, count(*) AS n FROM documents GROUP BY ALL)")
def baseline_payload(spark, d):
    docs, n = V.table(spark, d, "documents"), F.count(F.lit(1))
    by_lang = docs.groupBy(F.col("lang").alias("dataset")).agg(n.alias("entry_count"))
    evaluations = docs.groupBy(F.col("lang").alias("dataset"), F.col("source").alias("split")).agg(n.alias("total"))
    comparisons = by_lang.select("dataset", F.array(F.lit("a"), F.lit("b")).alias("link_differences"))
    return D.baseline_payload(evaluations, by_lang.select("dataset", F.lit(0).alias("limit"), "entry_count"), comparisons, docs.groupBy("source").agg(n.alias("n")))


# --- detection on maps, tensors, margins


_GROW = "w * h * 1.6 / (2 * (w + h))"


@query(f"WITH b AS (SELECT p_partkey AS p, p_partkey % 7 + 3 AS x, p_partkey % 5 + 2 AS y, CAST(p_partkey % 11 + 2 AS DOUBLE) AS w, CAST(p_size % 9 + 2 AS DOUBLE) AS h FROM part), g AS (SELECT *, {_GROW} AS g, w * h * 0.9 / ((w + 1) * (h + 1)) AS score FROM b) SELECT p, round(score, 5) AS score, least(greatest(round_even((x - g) * 2, 0), 0), 64) AS x0, least(greatest(round_even((y - g) * 2, 0), 0), 48) AS y0, least(greatest(round_even((x + w + g) * 2, 0), 0), 64) AS x1, least(greatest(round_even((y + h + g) * 2, 0), 0), 48) AS y1 FROM g WHERE least(w, h) >= 3 AND score >= 0.6 AND least(w, h) + 2 * g >= 5")
def map_boxes(spark, d):
    """A rectangle of high probability in a map is found, scored, grown and scaled to the page."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, x, y, w, h in pdf[["p", "x", "y", "w", "h"]].itertuples(index=False):
                prob = np.zeros((24, 32))
                prob[y : y + h, x : x + w] = 0.9
                for quad, score in P.detect_boxes(prob, size=(64, 48)):
                    xs, ys = [a for a, _ in quad], [b for _, b in quad]
                    rows.append((p, score, min(xs), min(ys), max(xs), max(ys)))
            yield pd.DataFrame(rows, columns=["p", "score", "x0", "y0", "x1", "y1"])

    k = F.col("p_partkey")
    shapes = V.table(spark, d, "part").select(k.alias("p"), (k % 7 + 3).cast("int").alias("x"), (k % 5 + 2).cast("int").alias("y"), (k % 11 + 2).cast("int").alias("w"), (F.col("p_size") % 9 + 2).cast("int").alias("h"))
    out = shapes.mapInPandas(run, "p long, score double, x0 double, y0 double, x1 double, y1 double")
    return out.withColumn("score", F.round("score", 5))


@query(f"WITH {_PX} SELECT p, y, x, round((v / 255 - 0.5) / 0.5, 4) + 0.0 AS v FROM px")
def tensor_values(spark, d):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, data in zip(pdf["p"], pdf["data"], strict=True):
                tensor = P.normalized(P.pixels_of(data, 6, 4, 6, 1), 0.5, 0.5)[0]
                y, x = np.mgrid[0:4, 0:6]
                yield pd.DataFrame({"p": p, "y": y.ravel(), "x": x.ravel(), "v": tensor.ravel().astype(float)})

    return _images(spark, d).mapInPandas(run, "p long, y long, x long, v double").withColumn("v", F.round("v", 4) + 0.0)


@query("SELECT p_partkey AS p, CAST(p_partkey % 5 + 1 AS INTEGER) AS w, CAST(p_size % 4 + 1 AS INTEGER) AS h FROM part")
def margin_crops(spark, d):
    """Dark ink on a light page: the crop is the ink's box."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = []
            for p, w, h in pdf[["p", "w", "h"]].itertuples(index=False):
                page = np.full((12, 14, 3), 240, np.uint8)
                page[p % 7 : p % 7 + h, p % 8 : p % 8 + w] = (30, 20, 10)
                sizes.append(P.crop_margin(page).shape)
            yield pd.DataFrame({"p": pdf["p"], "w": [s[1] for s in sizes], "h": [s[0] for s in sizes]})

    k = F.col("p_partkey")
    return V.table(spark, d, "part").select(k.alias("p"), (k % 5 + 1).cast("int").alias("w"), (F.col("p_size") % 4 + 1).cast("int").alias("h")).mapInPandas(run, "p long, w int, h int")


# --- files of models and reports, as JSON in a column


@query("SELECT p_brand AS id, 'file_' || p_partkey || '.onnx' AS name, 'detector' AS role, sha256(p_name) AS sha256, p_partkey * 7 AS size_bytes FROM part")
def manifest_sets(spark, d):
    k = F.col("p_partkey")
    file = F.struct(F.concat(F.lit("file_"), k.cast("string"), F.lit(".onnx")).alias("name"), F.lit("detector").alias("role"), F.sha2(F.col("p_name").cast("binary"), 256).alias("sha256"), (k * 7).alias("size_bytes"), F.lit("https://example.org/x").alias("source_url"))
    made = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.col("p_brand").alias("id"), F.lit("f").alias("family"), F.lit("v").alias("version"), F.collect_list(file).alias("files")))
    rows = V.table(spark, d, "part").groupBy("p_brand").agg(made.alias("json"))
    return D.parse_manifests(rows, "json").select("id", "name", "role", "sha256", "size_bytes")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 4 END AS vocab_size, 0 AS bos_id, CASE WHEN p_partkey % 4 = 0 THEN 9 ELSE 1 END AS pad_id, 2 AS eos_id, CASE WHEN p_partkey % 5 > 0 THEN 3 END AS unk_id, p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 AS valid FROM part")
def tokenizer_checks(spark, d):
    k = F.col("p_partkey")
    vocab = F.concat(F.lit('{"<s>":0,"a":4,"b":6,"c":7'), F.when(k % 3 == 0, ',"</s>":2').otherwise(""), F.lit("}"))
    added = F.concat(F.lit('[{"id":'), F.when(k % 4 == 0, "9").otherwise("1"), F.lit(',"content":"<pad>"},{"id":2,"content":"</s>"}'), F.when(k % 5 > 0, ',{"id":3,"content":"<unk>"}').otherwise(""), F.lit("]"))
    file = F.concat(F.lit('{"fast_tokenizer_file":{"model":{"vocab":'), vocab, F.lit('},"added_tokens":'), added, F.lit("}}"))
    out = D.tokenizer_metadata(V.table(spark, d, "part").select("p_partkey", file.alias("file")), "file").drop("file")
    return out.select("p_partkey", "vocab_size", *[F.col(c).cast("int").alias(c) for c in ("bos_id", "pad_id", "eos_id", "unk_id")], "valid")


@query(f"WITH {V.RECORDS}, f AS (SELECT role, failure, count(*) AS n FROM records WHERE failure <> 'none' GROUP BY ALL) SELECT '| role | failure | n |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || role || ' | ' || failure || ' | ' || n || ' |', chr(10) ORDER BY role, failure) AS table_text FROM f")
def failure_table(spark, d):
    failed = E.failure_counts(D.failed_records(V.records(spark, d)), ["role"])
    return D.markdown_table(failed, ["role", "failure", "n"], ["role", "failure"]).withColumnRenamed("table", "table_text")


@query(f"WITH {V.RECORDS}, r AS (SELECT *, failure <> 'empty_ground_truth' AS s FROM records) SELECT role AS dataset, 'all' AS split, count(*) AS total, count(*) FILTER (WHERE s) AS scored, round(coalesce(CAST(count(*) FILTER (WHERE exact AND s) AS DOUBLE) / nullif(count(*) FILTER (WHERE s), 0), 0), 9) AS exact_match_rate, round(coalesce(avg(cer) FILTER (WHERE s), 0), 9) AS mean_cer FROM r GROUP BY role")
def report_rows(spark, d):
    sums = E.summarize(V.records(spark, d), ["role"])
    reports = sums.select(F.col("role").alias("dataset"), F.lit("all").alias("split"), F.struct(*[c for c in sums.columns if c != "role"]).alias("summary"))
    out = D.flatten_reports(reports)
    return out.select("dataset", "split", "total", "scored", F.round("exact_match_rate", 9).alias("exact_match_rate"), F.round("mean_cer", 9).alias("mean_cer"))


# --- output documents

_ITEM = """'{"box":[[' || x0 || ',' || y0 || '],[' || x1 || ',' || y0 || '],[' || x1 || ',' || y1 || '],[' || x0 || ',' || y1 || ']],"txt":"' || t || '","score":' || CASE WHEN class_id = 2 THEN CASE WHEN rid % 2 = 0 THEN '0.0' ELSE CAST(score AS VARCHAR) END ELSE CAST(y0 / 64 AS VARCHAR) END || ',"kind":"' || CASE WHEN class_id = 2 THEN 'formula","latex":"' || t || '"' || CASE WHEN rid % 3 > 0 THEN ',"eos_index":' || (rid % 3) ELSE '' END || ',"truncated":' || CASE WHEN rid % 3 = 0 THEN 'true' ELSE 'false' END ELSE 'text"' END || '}'"""


@query(f"""WITH {V.REGIONS}, t AS (SELECT *, CASE WHEN class_id = 2 THEN 'x^' || text ELSE text END AS t FROM regions WHERE NOT (class_id = 1 AND rid % 4 = 0)), i AS (SELECT *, {_ITEM} AS item FROM t)
SELECT page, '{{"text":"' || string_agg(t, '\\n' ORDER BY y0, rid) || '","items":[' || string_agg(item, ',' ORDER BY rid) || '],"formulas":[' || coalesce(string_agg('{{"region":' || rid || ',"latex":"' || t || '"}}', ',' ORDER BY y0, rid) FILTER (WHERE class_id = 2), '') || ']}}' AS document FROM i GROUP BY page""")
def page_documents(spark, d):
    rid, formula = F.col("rid"), F.col("class_id") == 2
    item = R.output_item(
        found_score=F.when(rid % 2 != 0, F.col("score")), polygon=G.box_quad(*(F.col(c) for c in ("x0", "y0", "x1", "y1"))), text=F.when(~formula & ~((F.col("class_id") == 1) & (rid % 4 == 0)), F.col("text")), text_score=F.col("y0") / 64,
        latex=F.when(formula, F.concat(F.lit("x^"), F.col("text"))), eos_index=F.when(rid % 3 > 0, rid % 3), truncated=rid % 3 == 0,
    )
    return R.page_documents(V.regions(spark, d).withColumn("item", item), page="page", at=["y0", "rid"], rid="rid", item="item")


@query("SELECT doc_id, '{\"latex\":\"x_' || doc_id || '\",\"eos_index\":' || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE CAST(doc_id % 40 AS VARCHAR) END || ',\"truncated\":' || CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END || ',\"model_id\":\"m\",\"elapsed_ms\":' || (doc_id % 9) || ',\"batch_size\":8,\"token_ids\":[0,' || doc_id || ']}' AS json FROM documents")
def formula_json(spark, d):
    i, cut = F.col("doc_id"), F.col("doc_id") % 3 == 0
    json = R.formula_json(F.concat(F.lit("x_"), i.cast("string")), F.when(~cut, i % 40), cut, F.lit("m"), i % 9, F.lit(8), F.array(F.lit(0).cast("long"), i))
    return V.table(spark, d, "documents").select("doc_id", json.alias("json"))
