"""Queries of the box functions and of the joins between items, lines and regions."""
from __future__ import annotations

from pyspark.sql import functions as F

from drawmark.checks.catalog import query
from drawmark.checks.line_queries import PL, _SPANS, _W4, all_lines, segs
from drawmark.checks.text_queries import CELL_TEXT, num, tr
from drawmark.functions import boxes
from drawmark.functions.boxes import Box
from drawmark.operators import cells, lines, regions
from drawmark.operators import items as item_ops
from drawmark.settings import DEFAULT_REGIONS
from drawmark.sources.views import line_profile, view

ITEMS = ("ocr_items",)
XYXY = ("x1", "y1", "x2", "y2")


def items(spark, sf):
    return view(spark, sf, "ocr_items")


@query("P18", f"SELECT page_id, seq, x1, y1, x2 - 1 AS x2, y2 + 2 AS y2, {tr('x2 - 0.3 - (x1 + 0.6)')} AS w FROM ocr_items", ITEMS)
def p18(spark, sf):
    x1, y1, x2, y2 = (F.col(c) for c in XYXY)
    poly = F.array(F.array(x1 + 0.6, y1 + 0.2), F.array(x2 - 0.3, y1 + 0.5), F.array(x2 - 0.9, y2 + 2.5), F.array(x1 + 0.7, y2 + 1.5))
    hull = boxes.hull_of_points(poly)
    width = boxes.whole(F.array_max(F.transform(poly, lambda p: p[0])) - F.array_min(F.transform(poly, lambda p: p[0])))
    return items(spark, sf).select("page_id", "seq", *hull.columns(), width.alias("w"))


@query("P19", """SELECT i.page_id, seq, x2 - x1 AS w, y2 - y1 AS h, red_x <= (x1 + x2) // 2 AND (x1 + x2) // 2 <= red_x + red_w AND red_y <= (y1 + y2) // 2 AND (y1 + y2) // 2 <= red_y + red_h AS has_centre,
   red_x <= x1 AND red_y <= y1 AND red_x + red_w >= x2 AND red_y + red_h >= y2 AS has_box FROM ocr_items i JOIN page_regions USING (page_id)""", ("ocr_items", "page_regions"))
def p19(spark, sf):
    red, box = regions.region_box("red"), Box.corners()
    return items(spark, sf).join(view(spark, sf, "page_regions"), "page_id").select(
        "page_id", "seq", box.w.alias("w"), box.h.alias("h"), red.has_point(box.cx, box.cy).alias("has_centre"), red.has(box).alias("has_box"))


@query("P20", "SELECT page_id, name, " + ", ".join([
    tr("xa * img_w") + " AS x1", tr("ya * img_h") + " AS y1", f"{tr('xa * img_w')} + {tr('(xb - xa) * img_w')} AS x2", f"{tr('ya * img_h')} + {tr('(yb - ya) * img_h')} AS y2"]) +
    " FROM page_sizes, (VALUES ('left_table', 0.0, 0.18, 0.0, 1.0), ('bottom_right_title', 0.75, 1.0, 0.85, 1.0), ('top_left_number', 0.0, 0.20, 0.0, 0.08)) r(name, xa, xb, ya, yb)", ("page_sizes",))
def p20(spark, sf):
    rows = F.array(*[F.struct(F.lit(n).alias("name"), boxes.percent_box(r, F.col("img_w"), F.col("img_h")).pack().alias("b")) for n, r in DEFAULT_REGIONS.items()])
    return view(spark, sf, "page_sizes").select("page_id", F.explode(rows).alias("r")).select("page_id", "r.name", *[F.col(f"r.b.{c}").alias(c) for c in XYXY])


_FRAME5 = f"{tr('img_w * 0.05')} AS fx, img_w - 2 * {tr('img_w * 0.05')} AS fw"


@query("P21", f"""SELECT page_id, {tr('img_w * 0.08')} AS red_x1, fx + {tr('fw * (2.8 / 8.0)')} AS red_x2, {tr('img_h * 0.95')} AS red_y2, {tr('img_w * (5.0 / 8.0)')} AS green_x1, {tr('img_h * (5.0 / 6.0)')} AS green_y1,
   coalesce(red_x, {tr('img_w * (2.0 / 8.0)')}) AS orange_x2, CASE WHEN red_x IS NULL THEN {tr('img_h * (2.0 / 12.0)')} ELSE red_y END AS orange_y2
   FROM (SELECT *, {_FRAME5} FROM page_sizes JOIN page_regions USING (page_id))""", ("page_sizes", "page_regions"))
def p21(spark, sf):
    w, h = F.col("img_w"), F.col("img_h")
    mx, my = boxes.whole(w * 0.05), boxes.whole(h * 0.05)
    areas = regions.search_areas(w, h, Box(mx, my, w - mx, h - my), regions.region_box("red"))
    out = view(spark, sf, "page_sizes").join(view(spark, sf, "page_regions"), "page_id")
    return out.select("page_id", areas["red"].x1.alias("red_x1"), areas["red"].x2.alias("red_x2"), areas["red"].y2.alias("red_y2"),
                      areas["green"].x1.alias("green_x1"), areas["green"].y1.alias("green_y1"),
                      areas["orange"].x2.alias("orange_x2"), areas["orange"].y2.alias("orange_y2"))


_SCALE = "CASE WHEN greatest(img_w, img_h) > 2100 THEN 2100 / greatest(img_w, img_h) ELSE 1.0 END"


@query("P22", f"SELECT page_id, s AS scale, {tr('red_x / s')} + 10 AS x1, {tr('red_y / s')} + 20 AS y1, {tr('red_x / s')} + 10 + {tr('red_w / s')} AS x2, {tr('red_y / s')} + 20 + {tr('red_h / s')} AS y2 "
              f"FROM (SELECT *, {_SCALE} AS s FROM page_sizes JOIN page_regions USING (page_id))", ("page_sizes", "page_regions"))
def p22(spark, sf):
    scaled = view(spark, sf, "page_sizes").join(view(spark, sf, "page_regions"), "page_id").withColumn("scale", boxes.shrink_factor(F.col("img_w"), F.col("img_h")))
    back = boxes.map_back(*[F.col(f"red_{c}") for c in "xywh"], F.col("scale"), F.lit(10), F.lit(20))
    return scaled.select("page_id", "scale", *back.columns())


_RS = "CASE WHEN {mx} * s0 > 3500 THEN {cap} ELSE s0 END"
_S0 = "CASE WHEN least(w, h) < 80 THEN 5.0 WHEN least(w, h) < 200 THEN 3.0 WHEN greatest(w, h) > 2100 THEN 2100 / greatest(w, h) ELSE 1.0 END"
_S1 = "CASE WHEN least(w, h) < 80 THEN 5.0 WHEN least(w, h) < 200 THEN 3.0 ELSE 1.0 END"


@query("P23", f"""SELECT page_id, seq, scale, upscale, CASE WHEN h < 100 AND w < 400 THEN greatest({tr('least(' + tr('w * scale') + ', ' + tr('h * scale') + ') * 0.35')}, 40) ELSE 0 END AS pad FROM
   (SELECT *, CASE WHEN greatest(w, h) * s0 > 3500 THEN 3500.0 / greatest(w, h) ELSE s0 END AS scale, CASE WHEN greatest(w, h) * s1 > 3500 THEN greatest(3500.0 / greatest(w, h), 1.0) ELSE s1 END AS upscale FROM
   (SELECT *, {_S0} AS s0, {_S1} AS s1 FROM (SELECT page_id, seq, (x2 - x1) * (CASE WHEN seq % 3 = 0 THEN 20 ELSE 1 END) AS w, (y2 - y1) * (CASE WHEN seq % 3 = 0 THEN 10 ELSE 3 END) AS h FROM ocr_items)))""", ITEMS)
def p23(spark, sf):
    sized = items(spark, sf).selectExpr("page_id", "seq", "(x2 - x1) * (CASE WHEN seq % 3 = 0 THEN 20 ELSE 1 END) AS w",
                                        "(y2 - y1) * (CASE WHEN seq % 3 = 0 THEN 10 ELSE 3 END) AS h")
    w, h = F.col("w"), F.col("h")
    sized = sized.withColumn("scale", boxes.reading_scale(w, h)).withColumn("upscale", boxes.reading_scale(w, h, shrink=False))
    return sized.select("page_id", "seq", "scale", "upscale", boxes.reading_pad(w, h, F.col("scale")).alias("pad"))


@query("P24", "SELECT page_id, img_h > img_w AS rotated, greatest(img_w, img_h) AS img_w, least(img_w, img_h) AS img_h FROM page_sizes", ("page_sizes",))
def p24(spark, sf):
    return regions.landscape(view(spark, sf, "page_sizes"))


@query("P38", """SELECT page_id, CASE WHEN f IN ('Y', 'P', 'G', 'O', 'J') THEN red_x END AS red_x, CASE WHEN f IN ('Y', 'B') THEN green_x END AS green_x, CASE WHEN f IN ('Y', 'B') THEN orange_x END AS orange_x
   FROM (SELECT *, upper(substr(file_name, 1, 1)) AS f FROM page_regions)""", ("page_regions",))
def p38(spark, sf):
    return regions.suppressed(view(spark, sf, "page_regions")).select("page_id", "red_x", "green_x", "orange_x")


_CELL = PL + f""", j3 AS (SELECT page_id, seq, text, x1, y1, x2, y2, least(coalesce(list_sort(list_transform(list_filter(vs, lambda x: x <= (x1 + x2) // 2 AND x >= x1 - (x2 - x1) * 0.1 AND x <= x1 + (x2 - x1) * 0.1), lambda x: {{d: abs(x - x1), x: x}}))[1].x, x1), x1) AS cell_x1,
   least(coalesce(list_filter(hs, lambda y: y <= (y1 + y2) // 2)[-1], y1), y1) AS cell_y1, greatest(coalesce(list_filter(vs, lambda x: x >= (x1 + x2) // 2)[1], x2), x2) AS cell_x2,
   greatest(coalesce(list_filter(hs, lambda y: y >= (y1 + y2) // 2)[1], y2), y2) AS cell_y2 FROM ocr_items LEFT JOIN pl USING (page_id))"""
IL = ("ocr_items", "line_segments")


def celled(spark, sf):
    return cells.enclosing_cells(items(spark, sf), lines.page_lines(segs(spark, sf)))


@query("J3", _CELL + " SELECT page_id, seq, cell_x1, cell_y1, cell_x2, cell_y2 FROM j3", IL)
def j3(spark, sf):
    return celled(spark, sf).select("page_id", "seq", "cell_x1", "cell_y1", "cell_x2", "cell_y2")


_BIG = "(x2 - x1) * (y2 - y1) > (c2 - c1) * (d2 - d1)"


@query("P43", _CELL + f""" SELECT page_id, seq, CASE WHEN {_BIG} THEN c1 ELSE greatest(x1, c1) END AS x1, CASE WHEN {_BIG} THEN d1 ELSE greatest(y1, d1) END AS y1,
   CASE WHEN {_BIG} THEN least(x2, c2) ELSE least(x2, c2) END AS green_x2, CASE WHEN {_BIG} THEN least(x2, c2) ELSE x2 END AS orange_x2, CASE WHEN {_BIG} THEN d2 ELSE least(y2, d2) END AS y2
   FROM (SELECT *, cell_x1 + 8 AS c1, cell_y1 + 3 AS d1, cell_x2 - 12 AS c2, cell_y2 - 2 AS d2 FROM j3)""", IL)
def p43(spark, sf):
    item = Box.corners()
    cell = Box(F.col("cell_x1") + 8, F.col("cell_y1") + 3, F.col("cell_x2") - 12, F.col("cell_y2") - 2)
    green, orange = boxes.merge_with_cell(item, cell, True), boxes.merge_with_cell(item, cell, False)
    return celled(spark, sf).select("page_id", "seq", green.x1.alias("x1"), green.y1.alias("y1"), green.x2.alias("green_x2"),
                                    orange.x2.alias("orange_x2"), green.y2.alias("y2"))


_CLASS = """CASE WHEN w > img_w * 0.7 OR h > img_h * 0.7 THEN 'huge' WHEN area < 8 THEN 'noise'
   WHEN greatest(w, h) / greatest(least(w, h), 1) > 8 AND area / greatest(w * h, 1) < 0.15 THEN 'line' WHEN area > 5000 AND greatest(w, h) > 100 THEN 'block' ELSE 'text' END"""
CP = ("components", "page_sizes")


def classified(spark, sf):
    return regions.classified(view(spark, sf, "components"), view(spark, sf, "page_sizes"))


@query("P44", f"SELECT page_id, cc_id, {_CLASS} AS class FROM components JOIN page_sizes USING (page_id)", CP)
def p44(spark, sf):
    return classified(spark, sf).select("page_id", "cc_id", "class")


@query("P45", f"""SELECT page_id, cc_id, class FROM (SELECT *, {_CLASS} AS class, (x + x + w) // 2 AS cx, (y + y + h) // 2 AS cy FROM components JOIN page_sizes USING (page_id))
   WHERE ((class = 'text' AND area >= 200) OR class = 'block' OR (class = 'line' AND greatest(w, h) <= least(img_w, img_h) * 0.3))
   AND NOT ((cx < 100 OR cx > img_w - 100 OR cy < 100 OR cy > img_h - 100) AND w * h < 500) AND w >= 6 AND h >= 6""", CP)
def p45(spark, sf):
    kept = classified(spark, sf).filter(regions.usable_component()).filter(~regions.small_at_edge(Box.sized(*[F.col(c) for c in "xywh"]), F.col("img_w"), F.col("img_h")))
    return kept.filter("w >= 6 AND h >= 6").select("page_id", "cc_id", "class")


@query("P46", """SELECT page_id, fn_left, fn_top, fn_right, fn_bottom, CASE WHEN ok THEN rx1 END AS red_x1, CASE WHEN ok THEN ry1 END AS red_y1, CASE WHEN ok THEN rx2 END AS red_x2, CASE WHEN ok THEN ry2 END AS red_y2 FROM
   (SELECT *, red_x IS NOT NULL AND rx2 > rx1 AND ry2 > ry1 AS ok FROM (SELECT *, greatest(red_x - fn_left, 0) AS rx1, greatest(red_y - fn_top, 0) AS ry1, least(red_x + red_w - fn_left, fn_right - fn_left) AS rx2, least(red_y + red_h - fn_top, fn_bottom - fn_top) AS ry2 FROM
   (SELECT *, 0 AS fn_top, coalesce(green_y, img_h) AS fn_bottom, coalesce(orange_x, 0) AS fn_left, img_w AS fn_right FROM page_regions JOIN page_sizes USING (page_id))) WHERE fn_bottom > fn_top AND fn_right > fn_left)
   """, ("page_regions", "page_sizes"))
def p46(spark, sf):
    out = regions.note_areas(view(spark, sf, "page_regions"), view(spark, sf, "page_sizes"))
    return out.select("page_id", "fn_left", "fn_top", "fn_right", "fn_bottom", "red_x1", "red_y1", "red_x2", "red_y2")


@query("P47", """SELECT DISTINCT page_id, axis, pos, start_px, end_px FROM line_segments JOIN (SELECT page_id, img_w // 4 AS w, img_h // 4 AS h FROM page_sizes) USING (page_id)
   WHERE (axis = 'h' AND end_px - start_px >= CAST(trunc(w * 0.95) AS INTEGER) AND (pos < h * 0.25 OR pos > h * 0.75)) OR (axis = 'v' AND end_px - start_px >= CAST(trunc(h * 0.95) AS INTEGER) AND (pos < w * 0.25 OR pos > w * 0.75))""",
       ("line_segments", "page_sizes"))
def p47(spark, sf):
    small = view(spark, sf, "page_sizes").selectExpr("page_id", "CAST(floor(img_w / 4) AS INT) AS img_w", "CAST(floor(img_h / 4) AS INT) AS img_h")
    return regions.border_segments(segs(spark, sf), small, band=0.25).select("page_id", "axis", "pos", "start_px", "end_px").distinct()


_STRIKE = _W4 + """, marks AS (SELECT DISTINCT page_id, pos, end_px - start_px AS len, CAST(1 + start_px % 6 AS INTEGER) AS thick FROM line_segments)
  , cl AS (SELECT page_id, unnest(rows) AS y, cell_height AS h FROM w4)"""


@query("P50", _STRIKE + """ SELECT page_id, y AS cell_top, pos, len, thick FROM cl JOIN marks USING (page_id) WHERE thick <= 4 AND len >= greatest(CAST(trunc(700 * 0.4) AS INTEGER), 15) AND h >= 10
   AND pos - y >= CAST(trunc(h * 0.15) AS INTEGER) AND pos - y <= CAST(trunc(h * 0.85) AS INTEGER)""", SEGS := ("line_segments",))
def p50(spark, sf):
    marks = segs(spark, sf).selectExpr("page_id", "pos", "end_px - start_px AS len", "1 + start_px % 6 AS thick").distinct()
    return regions.strike_candidates(marks, grid_pages(spark, sf), cell_width=700)


def grid_pages(spark, sf, of=lambda df: df):
    return lines.row_grid(all_lines(spark, sf, of))


_J2 = _W4 + f""", pre AS (SELECT page_id, seq, (y1 + y2) / 2 AS cy, {CELL_TEXT} AS cell_text FROM (SELECT *, replace(text, ' ', '') AS s FROM ocr_items)),
  placed AS (SELECT page_id, seq, cell_text, cell_height, list_filter(rows, lambda y: y <= cy AND cy < y + cell_height)[1] AS cell_top, list_filter(ps, lambda y: NOT list_contains(rows, y)) AS strikes FROM pre JOIN w4 USING (page_id) WHERE cell_text IS NOT NULL),
  j2 AS (SELECT page_id, cell_top, CAST(cell_top + any_value(cell_height) AS INTEGER) AS cell_bottom, arg_min(cell_text, seq) AS cell_text, len(list_filter(any_value(strikes), lambda s: s > cell_top AND s < cell_top + any_value(cell_height))) > 0 AS struck FROM placed WHERE cell_top IS NOT NULL GROUP BY page_id, cell_top)"""


@query("J2", _J2 + " SELECT page_id, cell_top, cell_bottom, cell_text FROM j2", IL)
def j2(spark, sf):
    return cells.grid_cells(items(spark, sf), grid_pages(spark, sf)).select("page_id", "cell_top", "cell_bottom", "cell_text")


@query("J9", _J2 + " SELECT page_id, cell_top, struck FROM j2", IL)
def j9(spark, sf):
    return cells.grid_cells(items(spark, sf), grid_pages(spark, sf)).select("page_id", "cell_top", "struck")


_J4V = PL + ", coarse AS (SELECT page_id, list_sort(list(DISTINCT pos) FILTER (axis = 'v' AND level = 0)) AS cs FROM line_segments GROUP BY page_id), kw AS (SELECT page_id, vs, coalesce(cs, []::INT[]) AS cs, CAST(100 + page_id % 400 AS DOUBLE) AS c, CASE WHEN page_id % 3 = 0 THEN NULL ELSE CAST(70 + page_id % 400 AS DOUBLE) END AS d, CASE WHEN page_id % 4 = 0 THEN NULL ELSE CAST(140 + page_id % 400 AS DOUBLE) END AS g FROM pl JOIN coarse USING (page_id))"
_IV = "list_filter(list_transform({v}[2:], lambda b, i: {{a: {v}[i], b: b}}), lambda r: r.a <= c AND c <= r.b)[1]"
_NEAR = "list_sort(list_transform(vs[2:], lambda b, i: {d: abs((vs[i] + b) / 2 - c), i: i, a: vs[i], b: b}))[1]"


@query("J4", _J4V + f""", r1 AS (SELECT *, {_IV.format(v='vs')} AS r, {_NEAR} AS n, {_IV.format(v='cs')} AS k, list_filter(vs, lambda x: x > d AND x < c)[1] AS bl, list_filter(vs, lambda x: x > c AND x < g)[1] AS br FROM kw),
   r2 AS (SELECT *, CASE WHEN r.a <= d AND d <= r.b AND bl IS NOT NULL THEN bl ELSE r.a END AS left_x FROM r1),
   r3 AS (SELECT *, CASE WHEN r IS NULL THEN n.a ELSE left_x END AS x1, CASE WHEN r IS NULL THEN n.b WHEN left_x <= g AND g <= r.b AND br IS NOT NULL THEN br ELSE r.b END AS x2 FROM r2)
   SELECT page_id, CASE WHEN x2 - x1 <= 90 THEN x1 WHEN k.b - k.a <= 90 THEN k.a END AS x1, CASE WHEN x2 - x1 <= 90 THEN x2 WHEN k.b - k.a <= 90 THEN k.b END AS x2 FROM r3 WHERE x2 - x1 <= 90 OR k.b - k.a <= 90""", SEGS)
def j4(spark, sf):
    s = segs(spark, sf)
    p = s.groupBy("page_id").agg(F.array_sort(F.collect_set(F.when(F.col("axis") == "v", F.col("pos")))).alias("vs"),
                                 F.array_sort(F.collect_set(F.when((F.col("axis") == "v") & (F.col("level") == 0), F.col("pos")))).alias("cs"))
    k = p.selectExpr("page_id", "vs", "cs", "CAST(100 + page_id % 400 AS DOUBLE) AS c",
                     "CASE WHEN page_id % 3 = 0 THEN NULL ELSE CAST(70 + page_id % 400 AS DOUBLE) END AS d",
                     "CASE WHEN page_id % 4 = 0 THEN NULL ELSE CAST(140 + page_id % 400 AS DOUBLE) END AS g")
    col = cells.column_interval(F.col("vs"), F.col("c"), F.col("d"), F.col("g"), F.col("cs"), max_width=90)
    return k.select("page_id", col.alias("r")).filter("r IS NOT NULL").select("page_id", F.col("r.a").alias("x1"), F.col("r.b").alias("x2"))


_REG3 = "(VALUES (1), (2), (3))"
_IN = "({r}_x <= x1 AND {r}_y <= y1 AND {r}_x + {r}_w >= x2 AND {r}_y + {r}_h >= y2)"


@query("J10", f"SELECT i.page_id, seq FROM ocr_items i LEFT JOIN page_regions USING (page_id) WHERE NOT coalesce({_IN.format(r='red')}, false)", ("ocr_items", "page_regions"))
def j10(spark, sf):
    return regions.outside(items(spark, sf), view(spark, sf, "page_regions"), ("red",)).select("page_id", "seq")


_OV = "coalesce(greatest(least(x2, {r}_x + {r}_w) - greatest(x1, {r}_x), 0) * greatest(least(y2, {r}_y + {r}_h) - greatest(y1, {r}_y), 0) / greatest((x2 - x1) * (y2 - y1), 1) > {t}, false)"


@query("J11", f"SELECT i.page_id, seq, NOT ({' OR '.join(_OV.format(r=r, t=0.5) for r in ('red', 'green', 'orange'))}) AS keep_half, NOT ({' OR '.join(_OV.format(r=r, t=0.3) for r in ('red', 'green', 'orange'))}) AS keep_note "
              f"FROM ocr_items i LEFT JOIN page_regions USING (page_id)", ("ocr_items", "page_regions"))
def j11(spark, sf):
    joined = items(spark, sf).join(view(spark, sf, "page_regions"), "page_id", "left")
    return joined.select("page_id", "seq", (~regions.mostly_in_regions(Box.corners(), 0.5)).alias("keep_half"),
                         (~regions.mostly_in_regions(Box.corners(), 0.3)).alias("keep_note"))


_ZONE = "(SELECT page_id, CAST(300 + page_id % 300 AS INTEGER) AS zone_right, CAST(150 + page_id % 200 AS INTEGER) AS zone_bottom FROM page_sizes)"


def zones(spark, sf):
    return view(spark, sf, "page_sizes").selectExpr("page_id", "CAST(300 + page_id % 300 AS INT) AS zone_right", "CAST(150 + page_id % 200 AS INT) AS zone_bottom")


@query("J13", f"SELECT i.page_id, seq FROM ocr_items i LEFT JOIN {_ZONE} z USING (page_id) WHERE NOT coalesce((x1 + x2) / 2.0 BETWEEN 0 AND zone_right AND (y1 + y2) / 2.0 BETWEEN 0 AND zone_bottom, false)", ("ocr_items", "page_sizes"))
def j13(spark, sf):
    return regions.centre_outside_zone(items(spark, sf), zones(spark, sf)).select("page_id", "seq")


@query("J14", f"SELECT i.page_id, seq FROM ocr_items i JOIN {_ZONE} z USING (page_id) WHERE x1 >= 0 AND y1 >= 0 AND x2 <= zone_right AND y2 <= zone_bottom", ("ocr_items", "page_sizes"))
def j14(spark, sf):
    return regions.inside_zone(items(spark, sf), zones(spark, sf)).select("page_id", "seq")


@query("J18", f"""SELECT page_id, coalesce(red_x, {tr('img_w * (2.0 / 8.0)')}) AS orange_right, CASE WHEN red_x IS NULL THEN {tr('img_h * (2.0 / 12.0)')} ELSE red_y END AS orange_bottom,
   coalesce(green_y, img_h) AS note_bottom, coalesce(orange_x, 0) AS note_left FROM page_sizes LEFT JOIN page_regions USING (page_id)""", ("page_sizes", "page_regions"))
def j18(spark, sf):
    return regions.dependent_areas(view(spark, sf, "page_sizes"), view(spark, sf, "page_regions"))


@query("J19", """, prof AS (SELECT page_id, pos, CAST(count(*) * 15 AS INTEGER) AS value FROM line_segments GROUP BY page_id, pos), rg AS (SELECT *, greatest(0, x2 - greatest((x2 - x1) // 9, 10)) AS a, least(img_w, x2 + greatest((x2 - x1) // 9, 10) // 2) AS b FROM ocr_items JOIN page_sizes USING (page_id))
   SELECT page_id, seq, CAST(arg_max(pos, value * 100000 - pos) AS INTEGER) AS line_x FROM rg JOIN prof USING (page_id) WHERE pos >= a AND pos < b AND value > (y2 - y1) * 0.5 GROUP BY page_id, seq""", ("ocr_items", "line_segments", "page_sizes"))
def j19(spark, sf):
    profile = line_profile(spark, sf).withColumn("value", F.col("value") * 15)
    return cells.right_lines(items(spark, sf), profile, view(spark, sf, "page_sizes"))


@query("J20", _ALL20 := """, al AS (SELECT page_id, list_sort(list(DISTINCT pos)) AS ps FROM line_segments GROUP BY page_id), it AS (SELECT i.page_id, seq, (y1 + y2) // 2 - 60 AS cy, coalesce(ps, []::INT[]) AS ps FROM ocr_items i LEFT JOIN al USING (page_id)),
   inn AS (SELECT *, list_filter(list_transform(ps[2:], lambda b, i: {a: ps[i], b: b}), lambda r: r.a <= cy AND cy <= r.b)[1] AS r FROM it)
   SELECT page_id, seq, CASE WHEN len(ps) < 2 THEN greatest(cy - 8, 0) WHEN r IS NOT NULL THEN r.a WHEN cy > ps[-1] THEN ps[-1] ELSE ps[1] - (ps[2] - ps[1]) END AS row_top,
   CASE WHEN len(ps) < 2 THEN cy + 8 WHEN r IS NOT NULL THEN r.b WHEN cy > ps[-1] THEN ps[-1] + ps[-1] - ps[-2] ELSE ps[1] END AS row_bottom FROM inn""", IL)
def j20(spark, sf):
    joined = items(spark, sf).join(all_lines(spark, sf), "page_id", "left")
    cy = boxes.half(F.col("y1") + F.col("y2")) - 60
    top, bottom = cells.row_of(cy, F.coalesce("ps", lines.ints()))
    return joined.select("page_id", "seq", top.alias("row_top"), bottom.alias("row_bottom"))


_J22 = _SPANS.format(gap=10) + """, it AS (SELECT *, (x1 + x2) // 2 AS cx, (y1 + y2) // 2 AS cy FROM ocr_items JOIN page_sizes USING (page_id)), near AS (SELECT it.page_id, seq,
   max(pos) FILTER (axis = 'v' AND pos < cx AND lo <= cy AND cy <= hi AND pos BETWEEN greatest(0, x1 - 2 * (x2 - x1)) AND least(img_w, x2 + 2 * (x2 - x1))) AS l, min(pos) FILTER (axis = 'v' AND pos > cx AND lo <= cy AND cy <= hi AND pos BETWEEN greatest(0, x1 - 2 * (x2 - x1)) AND least(img_w, x2 + 2 * (x2 - x1))) AS r,
   max(pos) FILTER (axis = 'h' AND pos < cy AND lo <= cx AND cx <= hi AND pos BETWEEN greatest(0, y1 - 2 * (y2 - y1)) AND least(img_h, y2 + 2 * (y2 - y1))) AS t, min(pos) FILTER (axis = 'h' AND pos > cy AND lo <= cx AND cx <= hi AND pos BETWEEN greatest(0, y1 - 2 * (y2 - y1)) AND least(img_h, y2 + 2 * (y2 - y1))) AS b
   FROM it LEFT JOIN merged USING (page_id) GROUP BY it.page_id, seq)"""


@query("J22", _J22 + " SELECT page_id, seq, coalesce(l, 0) AS cell_x1, coalesce(t, 0) AS cell_y1, coalesce(r, img_w) AS cell_x2, coalesce(b, img_h) AS cell_y2 FROM near JOIN page_sizes USING (page_id)", ("ocr_items", "line_segments", "page_sizes"))
def j22(spark, sf):
    p = lines.page_spans(segs(spark, sf))
    p = p.select("page_id", lines.merge_spans(F.col("h_spans"), 10).alias("h_spans"), lines.merge_spans(F.col("v_spans"), 10).alias("v_spans"))
    facts = view(spark, sf, "page_sizes").join(p, "page_id", "left")
    return cells.strict_cells(items(spark, sf), facts).select("page_id", "seq", "cell_x1", "cell_y1", "cell_x2", "cell_y2")


@query("A8", f"""SELECT page_id, m AS median_h, greatest({tr('m * 8')}, 12) AS h_gap, greatest({tr('m * 1.5')}, 8) AS v_gap FROM (SELECT page_id, coalesce(CAST(trunc(median(h) FILTER ({_CLASS} = 'text')) AS INTEGER), 20) AS m
   FROM components JOIN page_sizes USING (page_id) GROUP BY page_id)""", CP)
def a8(spark, sf):
    return regions.text_gaps(classified(spark, sf))


_HITS = f"""SELECT *, coalesce({num('t')}, {num('f')}) AS number, CASE WHEN {num('t')} IS NOT NULL THEN t ELSE f END AS full_text FROM (SELECT *, {{bf}} AS f FROM (SELECT *, replace(upper(text), ' ', '') AS t FROM ocr_items))"""


def _hits() -> str:
    from drawmark.checks.text_queries import backfill
    return _HITS.format(bf=backfill("t"))


@query("A13", f", hits AS ({_hits()}) SELECT page_id, arg_min(number, {{a: -((x2 - x1) * (y2 - y1)), s: seq}}) AS number, max((x2 - x1) * (y2 - y1)) AS area FROM hits WHERE number IS NOT NULL GROUP BY page_id", ITEMS)
def a13(spark, sf):
    return item_ops.largest_number(items(spark, sf)).select("page_id", "number", "area")


@query("A19", """, s AS (SELECT page_id, min(start_px) FILTER (axis = 'h') AS lt, max(end_px) FILTER (axis = 'h') AS lb, min(start_px) FILTER (axis = 'v') AS rt, max(end_px) FILTER (axis = 'v') AS rb FROM line_segments GROUP BY page_id)
   SELECT page_id, coalesce(least(lt, rt), lt, rt, 0) AS table_top, coalesce(greatest(lb, rb), lb, rb, 900) AS table_bottom FROM s""", SEGS)
def a19(spark, sf):
    def pick(fn, col, axis):
        return fn(F.when(F.col("axis") == axis, F.col(col)))
    s = segs(spark, sf).groupBy("page_id").agg(
        pick(F.min, "start_px", "h").alias("lt"), pick(F.max, "end_px", "h").alias("lb"),
        pick(F.min, "start_px", "v").alias("rt"), pick(F.max, "end_px", "v").alias("rb"))
    return s.select("page_id", *[c.alias(n) for n, c in regions.both_sides("lt", "lb", "rt", "rb", F.lit(0), F.lit(900)).items()])
