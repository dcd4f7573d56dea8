"""Queries of keyword search, of the order-dependent box rules and of whole runs."""
from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import functions as F

from drawmark.checks.catalog import query
from drawmark.checks.geometry_queries import _CLASS, _J2, CP, classified, items, segs, zones
from drawmark.checks.job_queries import _CENTRE, _ROUTED, _STABLE, _STATE, REPLACED, note_codes, replacements
from drawmark.checks.line_queries import _A10, _ALL, _SPANS
from drawmark.checks.text_queries import _SPAN_CODE, ext, stem
from drawmark.functions import boxes, text
from drawmark.functions.boxes import Box
from drawmark.operators import cells, keywords, overlap, regions, tables
from drawmark.operators import items as item_ops
from drawmark.operators.lines import LINE_ORDER
from drawmark.operators.profiles import peaks
from drawmark.plans import drawings
from drawmark.session import by_page, settled
from drawmark.settings import COLUMN_CHECK_KEYWORDS, COLUMN_CHECK_THRESHOLD, MATERIAL_KEYWORDS, MATERIAL_THRESHOLD
from drawmark.sources import files
from drawmark.sources.views import ink, line_profile, view

CORNERS = ("x1", "y1", "x2", "y2")


def headers(spark, sf):
    return view(spark, sf, "header_items")


# the header view has these texts; SQL takes what the fuzzy rules say about each of them from lists
_HEADER_TEXTS = ("MATERlAL CODE", "DEF", "DFF.", "品群", "零部件图号", "MATERIAL  CODE", "PARTS LST", "NAME", "代 号", "QTY", "DEF.")


def _ratio(text: str, word: str) -> float:
    return SequenceMatcher(None, text, word).ratio()


def _score(text: str, word: str) -> float:
    upper, word = text.upper().strip(), word.upper()
    return 1.0 if word in upper or word.replace(" ", "") in upper.replace(" ", "") else _ratio(upper.replace(" ", ""), word.replace(" ", ""))


def _listed(texts) -> str:
    return "(" + ", ".join(f"'{t}'" for t in texts) + ")"


_SCORED = ", ".join(f"('{t}', '{k}', {_score(t, k)!r})" for t in _HEADER_TEXTS for k in [max(MATERIAL_KEYWORDS, key=lambda k: _score(t, k))] if _score(t, k) >= MATERIAL_THRESHOLD)
_MATCHED = f""", s(text, keyword, score) AS (VALUES {_SCORED}),
   m AS (SELECT h.*, keyword, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, seq) AS r6, row_number() OVER (PARTITION BY page_id ORDER BY lang <> 'en', score DESC, seq) AS r7 FROM header_items h JOIN s USING (text)),
   hm AS (SELECT *, (x1 + x2) / 2 AS mat_cx, (y1 + y2) / 2 AS mat_cy FROM m WHERE r7 = 1)"""
_DEF = _listed(t for t in _HEADER_TEXTS if len(t) <= 5 and (t in ("DEF", "DEF.") or _ratio(t, "DEF") > 0.7))
_COLUMN = _listed(t for t in _HEADER_TEXTS if any(x in t.upper().replace(" ", "") for x in ("MATERIAL",)) or "零部件图号" in t or "代号" in t
                  or max(_score(t, k) for k in COLUMN_CHECK_KEYWORDS) >= COLUMN_CHECK_THRESHOLD)
HEADERS = ("header_items",)


@query("J6", _MATCHED + " SELECT page_id, seq, text, keyword, score FROM m WHERE r6 = 1", HEADERS)
def j6(spark, sf):
    return keywords.best_matches(headers(spark, sf), MATERIAL_KEYWORDS, MATERIAL_THRESHOLD).select("page_id", "seq", "text", "keyword", "score")


@query("J7", _MATCHED + " SELECT page_id, lang, seq, keyword, score FROM hm", HEADERS)
def j7(spark, sf):
    return keywords.header_matches(headers(spark, sf)).select("page_id", "lang", "seq", "keyword", "score")


@query("J5", _MATCHED + f""", near AS (SELECT hm.page_id, hm.mat_cx, h.seq, (h.x1 + h.x2) / 2 AS cx, h.text IN {_DEF} AS is_def, h.text = '品群' AS is_group FROM hm JOIN header_items h ON h.page_id = hm.page_id AND h.lang = hm.lang),
   sides AS (SELECT page_id, coalesce(max(cx) FILTER (is_def AND cx < mat_cx), arg_min(cx, {{d: abs(cx - mat_cx), s: seq, c: cx}}) FILTER (is_def)) AS def_cx,
     coalesce(min(cx) FILTER (is_group AND cx > mat_cx), arg_min(cx, {{d: abs(cx - mat_cx), s: seq, c: cx}}) FILTER (is_group)) AS group_cx FROM near GROUP BY page_id)
   SELECT page_id, mat_cx, def_cx, group_cx FROM hm LEFT JOIN sides USING (page_id)""", HEADERS)
def j5(spark, sf):
    h = headers(spark, sf)
    return keywords.neighbour_anchors(h, keywords.header_matches(h))


@query("J8", _MATCHED + f""", area AS (SELECT page_id, red_x AS ax1, greatest(0, red_y - 200) AS ay1, red_x + red_w AS ax2, red_y + red_h AS ay2 FROM page_regions WHERE red_x IS NOT NULL),
   anchored AS (SELECT page_id FROM hm JOIN area USING (page_id) WHERE score >= 0.95 AND mat_cx BETWEEN ax1 AND ax2 AND mat_cy BETWEEN ay1 AND ay2),
   named AS (SELECT page_id FROM header_items JOIN area USING (page_id) WHERE x1 >= ax1 AND y1 >= ay1 AND x2 <= ax2 AND y2 <= ay2 AND text IN {_COLUMN})
   SELECT page_id, page_id IN (SELECT page_id FROM anchored) OR page_id IN (SELECT page_id FROM named) AS valid FROM area""", ("header_items", "page_regions"))
def j8(spark, sf):
    h = headers(spark, sf)
    columns = view(spark, sf, "page_regions").filter("red_x IS NOT NULL").select("page_id", *regions.region_box("red").columns())
    return keywords.checked_columns(columns, h, keywords.header_matches(h)).select("page_id", "valid")


_SHARED = "greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0) * greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0)"


@query("J12", f""", d AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY token, crop, x1, y1, x2, y2) AS i, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) AS area FROM
     (SELECT page_id, token, crop, x1, y1, x2, y2, count(*) AS n FROM crop_hits GROUP BY ALL)),
   ov AS (SELECT p.page_id, p.i, list(q.i) AS js FROM d p JOIN d q ON p.page_id = q.page_id AND p.token = q.token AND q.crop < p.crop AND {_SHARED} > 0
     AND {_SHARED} / greatest(p.area + q.area - {_SHARED}, 1) >= 0.5 GROUP BY p.page_id, p.i),
   lists AS (SELECT page_id, i, coalesce(js, []::BIGINT[]) AS js FROM d LEFT JOIN ov USING (page_id, i)),
   walk AS (SELECT page_id, CAST(0 AS BIGINT) AS i, []::BIGINT[] AS fresh FROM (SELECT DISTINCT page_id FROM d) UNION ALL
     SELECT w.page_id, w.i + 1, CASE WHEN list_has_any(w.fresh, l.js) THEN w.fresh ELSE list_append(w.fresh, l.i) END FROM walk w JOIN lists l ON l.page_id = w.page_id AND l.i = w.i + 1),
   done AS (SELECT page_id, arg_max(fresh, i) AS fresh FROM walk GROUP BY page_id),
   crops AS (SELECT page_id, CAST(crop AS BIGINT) AS crop, CAST(sum(n) AS BIGINT) AS n_hits, CAST(coalesce(sum(n) FILTER (list_contains(fresh, i)), 0) AS BIGINT) AS n_new FROM d JOIN done USING (page_id) GROUP BY page_id, crop)
   SELECT *, n_new > 0 AS kept FROM crops""", ("crop_hits",))
def j12(spark, sf):
    return overlap.crop_hits(view(spark, sf, "crop_hits"))


@query("J15", _SPANS.format(gap=10) + """, c AS (SELECT page_id, red_x + red_w AS x2, red_y + red_h AS y2 FROM page_regions WHERE red_x IS NOT NULL AND red_x + red_w >= 30 AND red_y + red_h >= 30),
   part AS (SELECT page_id, axis, pos, greatest(lo, 0) AS lo, least(hi, CASE axis WHEN 'h' THEN x2 ELSE y2 END) AS hi, CASE axis WHEN 'h' THEN x2 ELSE y2 END AS side
     FROM c JOIN merged USING (page_id) WHERE pos >= 0 AND pos < CASE axis WHEN 'h' THEN y2 ELSE x2 END),
   long AS (SELECT page_id, axis, pos - lag(pos) OVER (PARTITION BY page_id, axis ORDER BY pos) AS gap FROM part WHERE hi > lo AND hi - lo > side * 0.5),
   bands AS (SELECT page_id, CAST(count(*) FILTER (axis = 'h' AND (gap IS NULL OR gap > 3)) AS INTEGER) AS h_bands, CAST(count(*) FILTER (axis = 'v' AND (gap IS NULL OR gap > 3)) AS INTEGER) AS v_bands FROM long GROUP BY page_id),
   met AS (SELECT h.page_id, CAST(count(*) AS INTEGER) AS crossings FROM part h JOIN part v ON h.page_id = v.page_id AND h.axis = 'h' AND v.axis = 'v' AND h.lo <= v.pos AND v.pos <= h.hi AND v.lo <= h.pos AND h.pos <= v.hi
     WHERE h.hi > h.lo AND v.hi > v.lo GROUP BY h.page_id)
   SELECT page_id, CAST(0 AS INTEGER) AS x1, CAST(0 AS INTEGER) AS y1, CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2, h_bands, v_bands, crossings
   FROM c JOIN bands USING (page_id) JOIN met USING (page_id) WHERE h_bands >= 3 AND v_bands >= 3 AND crossings >= 4""", ("line_segments", "page_regions"))
def j15(spark, sf):
    found = view(spark, sf, "page_regions").filter("red_x IS NOT NULL").select("page_id", *Box(F.lit(0), F.lit(0), F.col("red_x") + F.col("red_w"), F.col("red_y") + F.col("red_h")).columns())
    return tables.accepted_tables(found, drawings.merged_lines(segs(spark, sf)))


def component_boxes(spark, sf):
    return classified(spark, sf).select("page_id", F.col("cc_id").alias("seq"), "class", *Box.sized(*[F.col(c) for c in "xywh"]).columns())


_BOXED = f""", comp AS (SELECT page_id, cc_id AS seq, class, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM (SELECT *, {_CLASS} AS class FROM components JOIN page_sizes USING (page_id)))"""
_HULL = "x1: least({a}.x1, {b}.x1), y1: least({a}.y1, {b}.y1), x2: greatest({a}.x2, {b}.x2), y2: greatest({a}.y2, {b}.y2)"
# line after line, all pages at a time: d holds the squared distances to the boxes, near the first of the nearest
_GROWN = _BOXED + f""", ln AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS k FROM comp WHERE class = 'noise'),
   walk AS (SELECT page_id, CAST(0 AS BIGINT) AS k, coalesce(list({{seq: seq, x1: x1, y1: y1, x2: x2, y2: y2, parts: CAST(1 AS BIGINT)}} ORDER BY seq) FILTER (class <> 'noise'), []) AS b, []::BIGINT[] AS rest
       FROM comp WHERE class IN ('text', 'block', 'noise') GROUP BY page_id
     UNION ALL SELECT page_id, k + 1, CASE WHEN d[near] <= 900 THEN list_transform(b, lambda o, i: CASE WHEN i = near THEN {{seq: o.seq, {_HULL.format(a="o", b="ln")}, parts: o.parts + 1}} ELSE o END) ELSE b END,
       CASE WHEN d[near] <= 900 THEN rest ELSE list_append(rest, ln.seq) END
     FROM (SELECT *, list_position(d, list_min(d)) AS near FROM (SELECT w.*, ln, list_transform(b, lambda o: pow(greatest(0, ln.x1 - o.x2, o.x1 - ln.x2), 2) + pow(greatest(0, ln.y1 - o.y2, o.y1 - ln.y2), 2)) AS d
       FROM walk w JOIN ln ON ln.page_id = w.page_id AND ln.k = w.k + 1))),
   done AS (SELECT page_id, b, rest FROM walk QUALIFY k = max(k) OVER (PARTITION BY page_id)),
   grown AS (SELECT page_id, 'box' AS kind, unnest(b, recursive := true) FROM done UNION ALL
     SELECT page_id, 'line', seq, x1, y1, x2, y2, CAST(1 AS BIGINT) FROM comp JOIN done USING (page_id) WHERE class = 'noise' AND list_contains(rest, seq))"""


@query("J16", _GROWN + " SELECT page_id, kind, seq, x1, y1, x2, y2, parts FROM grown", CP)
def j16(spark, sf):
    found = component_boxes(spark, sf)
    reach = view(spark, sf, "page_sizes").select("page_id", F.lit(30).alias("reach"))
    return overlap.absorbed_lines(found.filter("class IN ('text', 'block')"), found.filter("class = 'noise'"), reach)


@query("U3", _GROWN + " SELECT page_id, kind, x1, y1, x2, y2 FROM grown", CP)
def u3(spark, sf):
    return j16(spark, sf).select("page_id", "kind", *CORNERS)


@query("W7")
def w7(spark, sf):
    return overlap.joined_short_texts(view(spark, sf, "short_items")).drop("order")


_MEET = "greatest(least(o.x2, n.x2) - greatest(o.x1, n.x1), 0) * greatest(least(o.y2, n.y2) - greatest(o.y1, n.y1), 0)"
# the first pair (by the boxes' order) that overlaps becomes one box, all pages at a time, until no page has one
_FIRST = ("list_filter(flatten(list_transform(range(1, len({b}) + 1), lambda i: list_transform(range(i + 1, len({b}) + 1), lambda j: {{p: [i, j], o: {b}[i], n: {b}[j]}}))), lambda q: "
          + " AND ".join([_MEET.replace("o.", "q.o.").replace("n.", "q.n.") + " > 0", _MEET.replace("o.", "q.o.").replace("n.", "q.n.")
                          + " / greatest((q.o.x2 - q.o.x1) * (q.o.y2 - q.o.y1) + (q.n.x2 - q.n.x1) * (q.n.y2 - q.n.y1) - " + _MEET.replace("o.", "q.o.").replace("n.", "q.n.") + ", 1) > 0.1"]) + ")[1].p")


@query("W12", _BOXED + f""", st AS (SELECT page_id, list({{seq: seq, x1: x1, y1: y1, x2: x2, y2: y2, parts: CAST(1 AS BIGINT)}} ORDER BY seq) AS b FROM comp WHERE class IN ('text', 'block') GROUP BY page_id),
   walk AS (SELECT page_id, b, {_FIRST.format(b="b")} AS p FROM st
     UNION ALL SELECT page_id, m, {_FIRST.format(b="m")} FROM (SELECT page_id, list_filter(list_transform(b, lambda o, i: CASE WHEN i = p[1] THEN {{seq: o.seq, {_HULL.format(a="o", b="b[p[2]]")}, parts: o.parts + b[p[2]].parts}}
       WHEN i = p[2] THEN NULL ELSE o END), lambda o: o IS NOT NULL) AS m FROM walk WHERE p IS NOT NULL))
   SELECT page_id, unnest(b, recursive := true) FROM walk WHERE p IS NULL""", CP)
def w12(spark, sf):
    return overlap.merged_boxes(component_boxes(spark, sf).filter("class IN ('text', 'block')"))


@query("W13", """, bx AS (SELECT page_id, cc_id, x AS x1, y AS y1, x + w AS x2, y + h AS y2, row_number() OVER (PARTITION BY page_id ORDER BY cc_id) AS i, greatest(w * h, 1) AS a FROM components),
   cov AS (SELECT p.page_id, p.i, q.i AS j FROM bx p JOIN bx q ON p.page_id = q.page_id AND p.a > q.a AND p.x1 < q.x2 AND q.x1 < p.x2 AND p.y1 < q.y2 AND q.y1 < p.y2
     WHERE (least(p.x2, q.x2) - greatest(p.x1, q.x1)) * (least(p.y2, q.y2) - greatest(p.y1, q.y1)) / q.a >= 0.9),
   lists AS (SELECT bx.page_id, bx.i, coalesce(list(cov.j) FILTER (cov.j IS NOT NULL), []::BIGINT[]) AS js FROM bx LEFT JOIN cov ON cov.page_id = bx.page_id AND cov.i = bx.i GROUP BY bx.page_id, bx.i),
   walk AS (SELECT page_id, CAST(0 AS BIGINT) AS i, []::BIGINT[] AS gone FROM (SELECT DISTINCT page_id FROM bx) UNION ALL
     SELECT w.page_id, w.i + 1, CASE WHEN list_contains(w.gone, l.i) THEN w.gone ELSE list_concat(w.gone, l.js) END FROM walk w JOIN lists l ON l.page_id = w.page_id AND l.i = w.i + 1),
   done AS (SELECT page_id, arg_max(gone, i) AS gone FROM walk GROUP BY page_id)
   SELECT bx.page_id, cc_id AS seq FROM bx JOIN done USING (page_id) WHERE NOT list_contains(gone, bx.i)""", ("components",))
def w13(spark, sf):
    found = view(spark, sf, "components").select("page_id", F.col("cc_id").alias("seq"), *Box.sized(*[F.col(c) for c in "xywh"]).columns())
    return overlap.without_nested(found).select("page_id", "seq")


_KW = "CAST(60 + page_id % 400 AS INTEGER) AS kx1, CAST(140 + page_id % 400 AS INTEGER) AS kx2, CAST(100 + page_id % 400 AS DOUBLE) AS kw_cx, CAST(120 + page_id % 100 AS DOUBLE) AS kw_cy, CASE WHEN page_id % 3 = 0 THEN NULL ELSE CAST(58 + page_id % 400 AS DOUBLE) END AS def_cx, 1000 AS roi_w, 900 AS roi_h"


def keyword_facts(spark, sf):
    spikes = peaks(line_profile(spark, sf), 1, 10).groupBy("page_id").agg(F.array_sort(F.collect_set("centre")).alias("peaks"))
    lines_of = drawings.merged_lines(segs(spark, sf))
    from drawmark.operators.lines import ints
    return lines_of.join(spikes, "page_id", "left").withColumn("peaks", F.coalesce("peaks", ints())).selectExpr("*", *_KW.split(", CASE")[0].replace("INTEGER", "INT").split(", "), "CASE" + _KW.split(", CASE")[1].split(", 1000")[0], "1000 AS roi_w", "900 AS roi_h")


@query("W16", _SPANS.format(gap=10) + f""", vl AS (SELECT page_id, coalesce(list_sort(list({{pos: pos, lo: lo, hi: hi}}) FILTER (axis = 'v')), []) AS vs FROM merged GROUP BY page_id),
   prof AS (SELECT page_id, pos, CAST(count(*) AS INTEGER) AS value FROM line_segments GROUP BY page_id, pos),
   pk AS (SELECT page_id, list_sort(list(centre)) AS peaks FROM (SELECT page_id, CAST(min(pos) + (max(pos) - min(pos) + 1) // 2 AS INTEGER) AS centre FROM (SELECT *, pos - row_number() OVER (PARTITION BY page_id ORDER BY pos) AS grp FROM prof WHERE value > 1) GROUP BY page_id, grp HAVING max(pos) - min(pos) + 1 <= 10) GROUP BY page_id),
   kf AS (SELECT page_id, vs, coalesce(peaks, []::INT[]) AS peaks, {_KW} FROM vl LEFT JOIN pk USING (page_id)),
   bd AS (SELECT *, CAST(greatest(0, trunc(kw_cx - 400)) AS INTEGER) AS xl, CAST(least(1000, trunc(kw_cx + 400)) AS INTEGER) AS xh, greatest(0, kw_cy - 100) AS t1, kw_cy + 100 AS b1, kw_cy - 50 AS t2, kw_cy + 270 AS b2 FROM kf),
   nf AS (SELECT *, list_filter(vs, lambda s: s.pos >= xl AND s.pos < xh AND least(s.hi, b1) - greatest(s.lo, t1) >= greatest(trunc((b1 - t1) * 0.3), 15)) AS near, list_filter(vs, lambda s: s.pos >= xl AND s.pos < xh AND least(s.hi, b2) - greatest(s.lo, t2) >= greatest(trunc((b2 - t2) * 0.1), 20)) AS far FROM bd),
   fs AS (SELECT *, list_transform(CASE WHEN len(near) >= 2 THEN near ELSE far END, lambda s: s.pos) AS first, list_filter(peaks, lambda p: p >= xl AND p < xh) AS third FROM nf),
   lv AS (SELECT *, CASE WHEN len(first) >= 2 AND kw_cx >= first[1] - 200 AND kw_cx <= first[-1] + 200 THEN CASE WHEN len(near) >= 2 THEN 1 ELSE 2 END WHEN len(third) >= 2 AND kw_cx >= third[1] - 200 AND kw_cx <= third[-1] + 200 THEN 3 ELSE 4 END AS level FROM fs)
   SELECT page_id, level, array_to_string(CASE WHEN level <= 2 THEN first WHEN level = 3 THEN third END, ',') AS lines, CAST(greatest(kx1 - 5, CASE WHEN def_cx < kx1 THEN trunc((def_cx + kx1) / 2) END) AS INTEGER) AS own_left, kx2 + 5 AS own_right FROM lv""", ("line_segments",))
def w16(spark, sf):
    out = cells.column_lines(keyword_facts(spark, sf))
    return out.select("page_id", "level", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), "own_left", "own_right")


_CLUSTERED = (", al AS (SELECT page_id, list_sort(list(pos)) AS ps FROM (SELECT page_id, CAST(floor(avg(pos)) AS INTEGER) AS pos FROM (SELECT *, sum(CASE WHEN gap < 10 THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS grp FROM "
              "(SELECT *, pos - lag(pos) OVER (PARTITION BY page_id ORDER BY pos) AS gap FROM (SELECT DISTINCT page_id, pos FROM line_segments))) GROUP BY page_id, grp) GROUP BY page_id)")


@query("Q2", _J2.replace(_ALL, _CLUSTERED) + " SELECT page_id, cell_top, cell_bottom, cell_text, struck FROM j2", ("line_segments", "ocr_items"))
def q2(spark, sf):
    return drawings.red_cells(items(spark, sf), segs(spark, sf)).select("page_id", "cell_top", "cell_bottom", "cell_text", "struck")


@query("Q4")
def q4(spark, sf):
    drawn = by_page(segs(spark, sf).drop("level"), order=LINE_ORDER)
    return drawings.locate_columns(headers(spark, sf), drawn, ink(drawn), view(spark, sf, "page_sizes"))


def strong_profile(spark, sf):
    return line_profile(spark, sf).withColumn("value", F.col("value") * 15)


@query("Q5")
def q5(spark, sf):
    return drawings.bottom_right_numbers(items(spark, sf), segs(spark, sf), strong_profile(spark, sf), view(spark, sf, "page_sizes"))


@query("Q6")
def q6(spark, sf):
    return drawings.top_left_numbers(items(spark, sf), segs(spark, sf), view(spark, sf, "page_regions").select("page_id", "red_x", "red_y", "red_w", "red_h"))


def table_boxes(spark, sf):
    return view(spark, sf, "page_regions").filter("red_x IS NOT NULL").select("page_id", *regions.region_box("red").columns())


@query("Q7")
def q7(spark, sf):
    return drawings.note_codes(items(spark, sf), view(spark, sf, "components"), view(spark, sf, "page_sizes"), table_boxes(spark, sf), zones(spark, sf))


_ZONES, _ZONE = _A10.rsplit("SELECT h.page_id", 1)


@query("Q8", _ZONES + ", zn AS (SELECT h.page_id" + _ZONE + """) SELECT page_id, count(*) AS n_outside FROM ocr_items LEFT JOIN zn USING (page_id)
   WHERE NOT coalesce((x1 + x2) / 2 BETWEEN 0 AND zone_right AND (y1 + y2) / 2 BETWEEN 0 AND zone_bottom, false) GROUP BY page_id""", ("line_segments", "page_sizes", "ocr_items"))
def q8(spark, sf):
    """Table zones, and the items of each page that are left for the note search."""
    found = tables.table_zones(segs(spark, sf), view(spark, sf, "page_sizes"))
    left = regions.centre_outside_zone(items(spark, sf), found.select("page_id", "zone_right", "zone_bottom"))
    return left.groupBy("page_id").agg(F.count("*").alias("n_outside"))


@query("Q9")
def q9(spark, sf):
    """All regions of each page, and how many note codes it has."""
    pages, texts, drawn = (by_page(df) for df in (view(spark, sf, "page_sizes"), items(spark, sf), segs(spark, sf)))
    found = by_page(drawings.detected_regions(pages, texts, headers(spark, sf), drawn, strong_profile(spark, sf)), placed=True)
    named = drawings.as_regions(found, view(spark, sf, "drawing_files"))
    codes = drawings.detected_note_codes(named, pages, texts, view(spark, sf, "components"), table_boxes(spark, sf), drawn)
    counts = codes.groupBy("page_id").agg(F.count("*").alias("n_note_codes"))
    return found.join(counts, "page_id", "left").withColumn("n_note_codes", F.coalesce("n_note_codes", F.lit(0).cast("bigint")))


_VECTOR_ROWS = f"(SELECT f.file_id, f.file_name, seq, {_SPAN_CODE} AS old_text FROM ocr_items JOIN {_ROUTED} f ON f.file_id = page_id AND f.method = 'vector' WHERE seq % 3 <> 0 AND length({_SPAN_CODE}) >= 7)"


@query("Q10", f"SELECT file_name, seq, old_text, 'H' || old_text AS new_text FROM {_VECTOR_ROWS}", ("ocr_items", "drawing_files"))
def q10(spark, sf):
    routed = files.routed(view(spark, sf, "drawing_files"))
    return drawings.vector_rewrites(routed, item_ops.as_spans(items(spark, sf))).select("file_name", "seq", "old_text", "new_text")


_OUT_EXT = f"CASE WHEN method = 'vector' THEN '.pdf' WHEN {ext('file_name')} IN ('.tif', '.tiff', '.pdf') THEN '.tif' ELSE {ext('file_name')} END"


# every 29th page cannot be read
_RUN = REPLACED + f""", rt AS {_ROUTED}, nv AS (SELECT file_id, count(*) AS n FROM {_VECTOR_ROWS} GROUP BY file_id), opened AS (SELECT page_id FROM page_sizes WHERE page_id % 29 <> 0),
   mine AS (SELECT rep.* FROM rep JOIN rt ON file_id = page_id AND method = 'ocr' WHERE page_id IN (SELECT page_id FROM opened)), nr AS (SELECT page_id AS file_id, count(*) AS n FROM mine GROUP BY page_id),
   results AS (SELECT rt.file_id, file_name, CASE WHEN o.page_id IS NULL THEN 'error' ELSE 'success' END AS status, CASE WHEN o.page_id IS NULL THEN 'page could not be read' END AS error,
     CASE WHEN o.page_id IS NOT NULL THEN method END AS method, CASE WHEN o.page_id IS NOT NULL THEN coalesce(CASE WHEN method = 'vector' THEN nv.n ELSE nr.n END, 0) END AS total,
     CASE WHEN o.page_id IS NOT NULL THEN 'output/' || CASE WHEN method = 'vector' THEN 'PDF_Replacement' ELSE 'VLMOCR' END || '/' || {stem('file_name')} || {_OUT_EXT} END AS output_path
     FROM rt LEFT JOIN opened o ON o.page_id = rt.file_id LEFT JOIN nv USING (file_id) LEFT JOIN nr USING (file_id))"""
_RUN_ON = ("line_segments", "ocr_items", "page_regions", "drawing_files", "page_sizes")


def readable(spark, sf):
    return view(spark, sf, "page_sizes").filter("page_id % 29 <> 0")


def batch(spark, sf):
    read_back = items(spark, sf).withColumn("text", text.rewritten(F.col("text")))
    return drawings.batch_run(files.routed(view(spark, sf, "drawing_files")), item_ops.as_spans(items(spark, sf)), readable(spark, sf), items(spark, sf),
                              segs(spark, sf), view(spark, sf, "page_regions"), note_codes(spark, sf), read_back)


@query("Q1", _RUN + " SELECT * FROM results", _RUN_ON)
def q1(spark, sf):
    routed = files.routed(view(spark, sf, "drawing_files"))
    opened = readable(spark, sf)
    scanned = routed.filter("method = 'ocr'").select(F.col("file_id").alias("page_id"))
    return drawings.batch_results(routed, item_ops.as_spans(items(spark, sf)), replacements(spark, sf).join(scanned, "page_id", "left_semi"), opened)


@query("Q1_summary", _RUN.replace(_J2, _J2.replace(_ALL, _CLUSTERED)) + " SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS failed, CAST(coalesce(sum(total) FILTER (status = 'success'), 0) AS BIGINT) AS replacements FROM results", _RUN_ON)
def q1_summary(spark, sf):
    return batch(spark, sf)["summary"]


@query("Q1_verification", _RUN.replace(_J2, _J2.replace(_ALL, _CLUSTERED)) + f""" SELECT r.file_id AS page_id, r.total AS expected, coalesce(found, 0) AS found, coalesce(found, 0) >= r.total AS match FROM results r LEFT JOIN
   (SELECT page_id, CAST(sum({' + '.join(_CENTRE.format(r) for r in ('red', 'green', 'orange'))}) AS BIGINT) AS found FROM (SELECT page_id, (x1 + x2) // 2 AS cx, (y1 + y2) // 2 AS cy FROM ocr_items WHERE regexp_matches('H' || text, 'H[A-Z][A-Z0-9][A-Z0-9-]{{2,}}')) JOIN sup USING (page_id) GROUP BY page_id) f
   ON f.page_id = r.file_id WHERE status = 'success' AND method = 'ocr'""", _RUN_ON)
def q1_verification(spark, sf):
    return batch(spark, sf)["verification"]


@query("Q1_detected")
def q1_detected(spark, sf):
    """A batch whose regions come from the detection of all regions instead of a table."""
    routed = files.routed(view(spark, sf, "drawing_files"))
    pages, texts, drawn = (by_page(df) for df in (readable(spark, sf), items(spark, sf), segs(spark, sf)))
    detected = by_page(drawings.detected_regions(pages, texts, headers(spark, sf), drawn, strong_profile(spark, sf)), placed=True)
    found = by_page(drawings.as_regions(detected, routed), placed=True)
    codes = drawings.detected_note_codes(found, pages, texts, view(spark, sf, "components"), table_boxes(spark, sf), drawn)
    place = F.col("y1").cast("bigint") * 100_000 + F.col("x1")
    codes = by_page(codes.select("page_id", place.alias("seq"), F.col("token").alias("code"), *CORNERS), placed=True)
    return drawings.batch_run(routed, item_ops.as_spans(texts), pages, texts, drawn, found, codes, texts)["results"]


@query("Q11", _STABLE + _STATE + """, q AS (SELECT DISTINCT CAST(substr(path, 9, 6) AS BIGINT) AS job_id, replace(path, 'inbox/', '') AS source_file FROM stable)
   SELECT j.job_id, substr(source_file, 1, 8) AS drawing_no, '1' AS revision, CASE status WHEN 'done' THEN 'O' ELSE 'N' END AS ocr_flag, CASE status WHEN 'done' THEN 'success' ELSE 'failed' END AS status, strftime(finished_at, '%Y-%m-%dT%H:%M:%S') AS process_date
   FROM jobs j JOIN q USING (job_id) WHERE status IN ('done', 'failed')""", ("file_observations", "job_events"))
def q11(spark, sf):
    number = F.substring("source_file", 3, 6).cast("bigint")
    out = drawings.watched_log(view(spark, sf, "file_observations"), view(spark, sf, "job_events"), number)
    return out.select("job_id", "drawing_no", "revision", "ocr_flag", "status", "process_date")
