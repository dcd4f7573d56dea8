"""Queries of the line operators."""
from __future__ import annotations

from pyspark.sql import functions as F

from drawmark.checks.catalog import query
from drawmark.checks.text_queries import tr
from drawmark.operators import lines
from drawmark.sources.views import line_profile, view

PL = (", pl AS (SELECT page_id, coalesce(list_sort(list(DISTINCT pos) FILTER (axis = 'h')), []::INT[]) AS hs, "
      "coalesce(list_sort(list(DISTINCT pos) FILTER (axis = 'v')), []::INT[]) AS vs FROM line_segments GROUP BY page_id)")
SEGS = ("line_segments",)


def spaced(arr: str, gap: str, op: str = ">") -> str:
    return (f"list_reduce({arr}, lambda acc, x: CASE WHEN len(acc) = 0 OR x - acc[-1] {op} {gap} "
            f"THEN list_append(acc, x) ELSE acc END, []::INT[])")


def gap_list(arr: str) -> str:
    return f"list_transform({arr}[2:], lambda v, i: v - {arr}[i])"


def segs(spark, sf):
    return view(spark, sf, "line_segments")


def pages(spark, sf):
    return lines.page_lines(segs(spark, sf))


@query("W1", PL + f" SELECT page_id, 'h' AS axis, unnest({spaced('hs', '5')}) AS pos FROM pl UNION ALL "
                  f"SELECT page_id, 'v', unnest({spaced('vs', '8')}) FROM pl", SEGS)
def w1(spark, sf):
    p = pages(spark, sf)
    both = F.array(F.struct(F.lit("h").alias("axis"), lines.keep_spaced(F.col("hs"), 5).alias("ps")),
                   F.struct(F.lit("v").alias("axis"), lines.keep_spaced(F.col("vs"), 8).alias("ps")))
    return p.select("page_id", F.explode(both).alias("b")).select("page_id", "b.axis", F.explode("b.ps").alias("pos"))


_SPANS = """, pt AS (SELECT page_id, axis, pos, min(start_px) AS lo, max(end_px) AS hi, max(end_px - start_px) AS len FROM line_segments GROUP BY ALL),
  ordered AS (SELECT *, row_number() OVER (PARTITION BY page_id, axis ORDER BY pos) AS i FROM pt),
  walk AS (SELECT page_id, axis, i, pos, pos AS head FROM ordered WHERE i = 1
    UNION ALL SELECT o.page_id, o.axis, o.i, o.pos, CASE WHEN o.pos - w.head <= {gap} THEN w.head ELSE o.pos END FROM walk w JOIN ordered o
      ON o.page_id = w.page_id AND o.axis = w.axis AND o.i = w.i + 1),
  merged AS (SELECT page_id, axis, head AS pos, min(lo) AS lo, max(hi) AS hi, max(len) AS len FROM walk JOIN pt USING (page_id, axis, pos) GROUP BY page_id, axis, head)"""


@query("W2", _SPANS.format(gap=10) + """, longest AS (SELECT page_id, max(hi - lo) AS m FROM merged WHERE axis = 'v' GROUP BY page_id),
  tall AS (SELECT page_id, min(lo) AS lo, max(hi) AS hi FROM merged JOIN longest USING (page_id) WHERE axis = 'v' AND hi - lo > m * 0.5 GROUP BY page_id)
  SELECT g.page_id, axis, pos, g.lo, g.hi, t.lo AS table_top, t.hi AS table_bottom FROM merged g LEFT JOIN tall t USING (page_id)""", SEGS)
def w2(spark, sf):
    p = lines.page_spans(segs(spark, sf))
    p = p.withColumn("h", lines.merge_spans(F.col("h_spans"), 10)).withColumn("v", lines.merge_spans(F.col("v_spans"), 10))
    top, bottom = lines.tall_extent(F.col("v"))
    both = F.array(F.struct(F.lit("h").alias("axis"), F.col("h").alias("s")), F.struct(F.lit("v").alias("axis"), F.col("v").alias("s")))
    return (p.select("page_id", top.alias("table_top"), bottom.alias("table_bottom"), F.explode(both).alias("b"))
            .select("page_id", "table_top", "table_bottom", "b.axis", F.explode("b.s").alias("s"))
            .select("page_id", "axis", "s.pos", "s.lo", "s.hi", "table_top", "table_bottom"))


@query("W3", """SELECT page_id, axis, CAST(floor(avg(pos)) AS INTEGER) AS pos FROM (SELECT *, sum(CASE WHEN gap < 40 THEN 0 ELSE 1 END) OVER (PARTITION BY page_id, axis ORDER BY pos) AS grp FROM
   (SELECT *, pos - lag(pos) OVER (PARTITION BY page_id, axis ORDER BY pos) AS gap FROM (SELECT DISTINCT page_id, axis, pos FROM line_segments))) GROUP BY page_id, axis, grp""", SEGS)
def w3(spark, sf):
    p = pages(spark, sf)
    both = F.array(F.struct(F.lit("h").alias("axis"), lines.cluster_means(F.col("hs"), 40).alias("ps")),
                   F.struct(F.lit("v").alias("axis"), lines.cluster_means(F.col("vs"), 40).alias("ps")))
    return p.select("page_id", F.explode(both).alias("b")).select("page_id", "b.axis", F.explode("b.ps").alias("pos"))


_ALL = ", al AS (SELECT page_id, list_sort(list(DISTINCT pos)) AS ps FROM line_segments GROUP BY page_id)"


def all_lines(spark, sf, of=lambda df: df):
    """Pages whose horizontal and vertical positions are read as one list of rows."""
    return of(segs(spark, sf)).groupBy("page_id").agg(F.array_sort(F.collect_set("pos")).alias("ps"))


_A5 = (_ALL + """, g AS (SELECT page_id, unnest(list_transform(list_filter({gaps}, lambda v: v > 50), lambda v: CAST(round_even(v / 5, 0) AS INTEGER) * 5)) AS r,
   generate_subscripts(list_filter({gaps}, lambda v: v > 50), 1) AS i FROM al),
   a5 AS (SELECT page_id, arg_max(r, n * 1000000 - f) AS cell_height FROM (SELECT page_id, r, count(*) AS n, min(i) AS f FROM g GROUP BY page_id, r) GROUP BY page_id)""").format(gaps=gap_list("ps"))


@query("A5", _A5 + " SELECT page_id, CAST(cell_height AS INTEGER) AS cell_height FROM al LEFT JOIN a5 USING (page_id)", SEGS)
def a5(spark, sf):
    return all_lines(spark, sf).select("page_id", lines.common_gap(F.col("ps")).alias("cell_height"))


_GROUPED = ("list_reduce(s, lambda acc, g: CASE WHEN len(list_filter(acc, lambda m: abs(m[1] - g) <= 10)) = 0 THEN list_append(acc, [g]) "
            "ELSE list_transform(acc, lambda m, i: CASE WHEN i = list_position(list_transform(acc, lambda q: abs(q[1] - g) <= 10), true) THEN list_append(m, g) ELSE m END) END, []::INT[][])")
_MODE_OF = "list_filter({g}, lambda m: len(m) = list_max(list_transform({g}, lambda q: len(q))))[1]"


def voted(arr: str) -> str:
    sample = f"list_filter(({gap_list(arr)})[1:5], lambda v: v >= 30)"
    return sample


_A6 = (_ALL + f", sm AS (SELECT page_id, ps, {voted('ps')} AS s FROM al), gr AS (SELECT page_id, ps, {_GROUPED} AS g FROM sm), "
       f"a6 AS (SELECT page_id, ps, CAST(floor(list_avg({_MODE_OF.format(g='g')})) AS INTEGER) AS cell_height FROM gr)")


@query("A6", _A6 + " SELECT page_id, cell_height FROM a6", SEGS)
def a6(spark, sf):
    return all_lines(spark, sf).select("page_id", lines.voted_gap(F.col("ps")).alias("cell_height"))


_CHAIN = ("list_reduce(list_sort(list_filter({gaps}, lambda v: v >= 8)), lambda acc, g: CASE WHEN len(acc) > 0 AND g - acc[-1][-1] <= 3 THEN list_append(acc[1:len(acc) - 1], list_append(acc[-1], g)) "
          "ELSE list_append(acc, [g]) END, []::INT[][])").format(gaps=gap_list("ps"))


@query("A7", _ALL + f", ch AS (SELECT page_id, ps, {_CHAIN} AS g FROM al), hh AS (SELECT *, CAST(floor(list_avg({_MODE_OF.format(g='g')})) AS INTEGER) AS h FROM ch) "
             f"SELECT page_id, CAST(unnest(CASE WHEN len(ps) < 3 OR h IS NULL OR h < 5 THEN ps ELSE range(ps[1], ps[-1] + h + 1, h) END) AS INTEGER) AS row_y FROM hh", SEGS)
def a7(spark, sf):
    return all_lines(spark, sf).select("page_id", F.explode(lines.uniform_grid(F.col("ps"))).alias("row_y"))


_NEXT = "list_sort(list_transform(list_filter(ps, lambda y: y > acc[-1] AND abs(y - acc[-1] - cell_height) <= 3), lambda y: {d: abs(y - acc[-1] - cell_height), y: y}))[1].y"
_W4 = _A5 + (f", w4 AS (SELECT page_id, cell_height, ps, list_reduce(ps, lambda acc, x: CASE WHEN {_NEXT} IS NULL THEN acc ELSE list_append(acc, {_NEXT}) END, ps[1:1]) AS rows "
             f"FROM al JOIN a5 USING (page_id))")


@query("W4", _W4 + " SELECT page_id, y, list_contains(rows, y) AS is_row FROM (SELECT page_id, unnest(ps) AS y, rows FROM w4)", SEGS)
def w4(spark, sf):
    p = (all_lines(spark, sf).withColumn("h", lines.common_gap(F.col("ps"))).filter("h IS NOT NULL")
         .withColumn("rows", lines.grid_rows(F.col("ps"), F.col("h"))))
    return p.select("page_id", "rows", F.explode("ps").alias("y")).select("page_id", "y", F.array_contains("rows", F.col("y")).alias("is_row"))


_W5 = "CASE WHEN len(ps) < 4 OR cell_height IS NULL OR cell_height < 10 THEN ps ELSE " + spaced("ps", "cell_height * 0.7", ">=") + " END"


@query("W5", _A6 + f" SELECT page_id, unnest({_W5}) AS row_y FROM a6", SEGS)
def w5(spark, sf):
    return all_lines(spark, sf).select("page_id", F.explode(lines.without_false_rows(F.col("ps"))).alias("row_y"))


@query("W6", """, s AS (SELECT DISTINCT page_id, pos, start_px + (pos % 7) * 60 AS lo, start_px + (pos % 7) * 60 + 40 AS hi FROM line_segments WHERE axis = 'v'),
  strips AS (SELECT page_id, lo, hi FROM s GROUP BY ALL),
  seed AS (SELECT page_id, min({l: lo, h: hi}) AS b FROM strips WHERE lo <= 160 AND hi >= 140 GROUP BY page_id),
  down AS (SELECT page_id, b.h AS hi FROM seed UNION SELECT d.page_id, s.hi FROM down d JOIN strips s ON s.page_id = d.page_id AND s.lo > d.hi AND s.lo - d.hi <= 80
     AND s.lo = (SELECT min(q.lo) FROM strips q WHERE q.page_id = d.page_id AND q.lo > d.hi)),
  bottom AS (SELECT page_id, max(hi) AS hi FROM down GROUP BY page_id)
  SELECT page_id, b.hi AS y_max FROM strips p LEFT JOIN bottom b USING (page_id) GROUP BY page_id, b.hi""", SEGS)
def w6(spark, sf):
    strips = segs(spark, sf).filter("axis = 'v'").selectExpr(
        "page_id", "start_px + (pos % 7) * 60 AS lo", "start_px + (pos % 7) * 60 + 40 AS hi")
    p = strips.groupBy("page_id").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("ss"))
    return p.select("page_id", lines.linked_extent(F.col("ss"), F.lit(150))["hi"].alias("y_max"))


_LINKED = """, down{g} AS (SELECT page_id, b.h AS hi FROM seed UNION SELECT d.page_id, s.hi FROM down{g} d JOIN strips s ON s.page_id = d.page_id AND s.lo > d.hi AND s.lo - d.hi <= {g}
     AND s.lo = (SELECT min(q.lo) FROM strips q WHERE q.page_id = d.page_id AND q.lo > d.hi)
     AND s.hi = (SELECT min(q.hi) FROM strips q WHERE q.page_id = d.page_id AND q.lo = s.lo)),
  up{g} AS (SELECT page_id, b.l AS lo FROM seed UNION SELECT u.page_id, s.lo FROM up{g} u JOIN strips s ON s.page_id = u.page_id AND s.hi < u.lo AND u.lo - s.hi <= {g}
     AND s.lo = (SELECT min(q.lo) FROM strips q WHERE q.page_id = u.page_id AND q.hi < u.lo AND u.lo - q.hi <= {g})),
  ext{g} AS (SELECT page_id, lo, hi FROM (SELECT page_id, min(lo) AS lo FROM up{g} GROUP BY page_id) JOIN (SELECT page_id, max(hi) AS hi FROM down{g} GROUP BY page_id) USING (page_id))"""


@query("W6_top", """, s AS (SELECT DISTINCT page_id, pos, start_px + (pos % 7) * 60 AS lo, start_px + (pos % 7) * 60 + 40 AS hi FROM line_segments WHERE axis = 'v'),
  strips AS (SELECT page_id, lo, hi FROM s GROUP BY ALL), seed AS (SELECT page_id, min({l: lo, h: hi}) AS b FROM strips WHERE lo <= 410 AND hi >= 390 GROUP BY page_id)"""
       + _LINKED.format(g=80) + _LINKED.format(g=120) + """ SELECT p.page_id, CASE WHEN a.hi - a.lo < 500 THEN w.lo ELSE a.lo END AS y_min, CASE WHEN a.hi - a.lo < 500 THEN w.hi ELSE a.hi END AS y_max
  FROM (SELECT DISTINCT page_id FROM strips) p LEFT JOIN ext80 a USING (page_id) LEFT JOIN ext120 w USING (page_id)""", SEGS)
def w6_top(spark, sf):
    strips = segs(spark, sf).filter("axis = 'v'").selectExpr(
        "page_id", "start_px + (pos % 7) * 60 AS lo", "start_px + (pos % 7) * 60 + 40 AS hi")
    p = strips.groupBy("page_id").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("ss"))
    first, wider = (lines.linked_extent(F.col("ss"), F.lit(400), gap) for gap in (80, 120))
    grown = F.when(first["hi"] - first["lo"] < 500, wider).otherwise(first)
    return p.select("page_id", grown["lo"].alias("y_min"), grown["hi"].alias("y_max"))


_PROFILE = ", prof AS (SELECT page_id, pos, CAST(count(*) AS INTEGER) AS value FROM line_segments GROUP BY page_id, pos)"


@query("W8", _PROFILE + """ SELECT page_id, CAST(min(pos) + (max(pos) - min(pos) + 1) // 2 AS INTEGER) AS centre, CAST(max(pos) - min(pos) + 1 AS INTEGER) AS width FROM
   (SELECT *, pos - row_number() OVER (PARTITION BY page_id ORDER BY pos) AS grp FROM prof WHERE value > 0) GROUP BY page_id, grp HAVING max(pos) - min(pos) + 1 <= 10""", SEGS)
def w8(spark, sf):
    from drawmark.operators.profiles import peaks
    return peaks(line_profile(spark, sf), threshold=0, max_width=10)


_TWO = (", two AS (SELECT page_id, coalesce(list_sort(list(DISTINCT pos) FILTER (level < 2)), []::INT[]) AS wide, "
        "coalesce(list_sort(list(DISTINCT pos) FILTER (end_px - start_px >= 350)), []::INT[]) AS narrow FROM line_segments GROUP BY page_id)")


@query("W9", _TWO + f", mg AS (SELECT *, {spaced('list_sort(list_distinct(list_concat(wide, narrow)))', '8')} AS m FROM two), "
             f"ch AS (SELECT page_id, CASE WHEN len(narrow) > len(wide) * 1.5 AND len(narrow) >= 6 THEN narrow WHEN len(wide) > 0 AND len(narrow) > 0 AND len(m) > len(wide) * 1.2 THEN m "
             f"WHEN len(wide) > 0 THEN wide ELSE narrow END AS ps FROM mg), sm AS (SELECT page_id, ps, {voted('ps')} AS s FROM ch), gr AS (SELECT page_id, ps, {_GROUPED} AS g FROM sm), "
             f"a6 AS (SELECT page_id, ps, CAST(floor(list_avg({_MODE_OF.format(g='g')})) AS INTEGER) AS cell_height FROM gr) SELECT page_id, unnest({_W5}) AS row_y FROM a6", SEGS)
def w9(spark, sf):
    def found(cond):
        return F.array_sort(F.collect_set(F.when(cond, F.col("pos"))))
    p = segs(spark, sf).groupBy("page_id").agg(found(F.col("level") < 2).alias("wide"),
                                               found(F.col("end_px") - F.col("start_px") >= 350).alias("narrow"))
    return p.select("page_id", F.explode(lines.chosen_rows(F.col("wide"), F.col("narrow"))).alias("row_y"))


def _level(r: str) -> str:
    return spaced(f"list_sort(list_transform(list_filter(sp, lambda s: s.len >= {tr('1000 * ' + r)}), lambda s: s.pos))", "8")


@query("W10", ", pt AS (SELECT page_id, pos, max(end_px - start_px) AS len FROM line_segments GROUP BY page_id, pos), sp AS (SELECT page_id, list({pos: pos, len: len}) AS sp FROM pt GROUP BY page_id), "
              f"lv AS (SELECT page_id, {_level('0.30')} AS a, {_level('0.20')} AS b, {_level('0.15')} AS c FROM sp) SELECT page_id, unnest(CASE WHEN len(list_filter(a, lambda y: y BETWEEN 100 AND 440)) >= 3 THEN a "
              f"WHEN len(list_filter(b, lambda y: y BETWEEN 100 AND 440)) >= 3 THEN b ELSE c END) AS row_y FROM lv", SEGS)
def w10(spark, sf):
    at = segs(spark, sf).groupBy("page_id", "pos").agg(F.max(F.col("end_px") - F.col("start_px")).alias("len"))
    p = at.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "len"))).alias("sp"))
    return p.select("page_id", F.explode(lines.ladder_rows(F.col("sp"), F.lit(1000), F.lit(100), F.lit(440), 3)).alias("row_y"))


@query("W11", _A6 + """, e AS (SELECT page_id, cell_height AS h, unnest(ps) AS y, unnest(list_append(ps[2:], 700)) AS nxt FROM a6 WHERE cell_height IS NOT NULL),
   n AS (SELECT *, CAST(round_even((nxt - y) / h, 0) AS INTEGER) - 1 AS nf FROM e)
   SELECT DISTINCT page_id, row_y FROM (SELECT page_id, y AS row_y FROM n UNION ALL SELECT page_id, CAST(trunc(y + (nxt - y) / (nf + 1) * k) AS INTEGER) FROM
     (SELECT *, unnest(range(1, nf + 1)) AS k FROM n WHERE nxt - y > h * 1.8 AND nf > 0))""", SEGS)
def w11(spark, sf):
    p = all_lines(spark, sf).withColumn("h", lines.voted_gap(F.col("ps"))).filter("h IS NOT NULL")
    return p.select("page_id", F.explode(lines.filled_rows(F.col("ps"), F.col("h"), F.lit(700))).alias("row_y"))


@query("W14", PL + """, rc AS (SELECT page_id, hs, list_filter(hs, lambda y: y < 200) AS above FROM pl),
   rh AS (SELECT *, greatest(CAST(trunc((above[-1] - above[1]) / (len(above) - 1) * 3) AS INTEGER), 100) AS reach FROM rc WHERE len(above) >= 2),
   walk AS (SELECT page_id, 200 AS top, []::INTEGER[] AS found, false AS ended FROM rh UNION ALL
     SELECT w.page_id, CASE WHEN len(e.ext) > 0 THEN CAST(e.ext[-1] + 1 AS INTEGER) ELSE w.top END, list_concat(w.found, e.ext), len(e.ext) = 0
     FROM walk w JOIN rh ON rh.page_id = w.page_id, LATERAL (SELECT list_filter(rh.hs, lambda y: y >= w.top AND y < least(900, w.top + rh.reach)) AS ext) e
     WHERE NOT w.ended AND w.top < least(900, 200 + rh.reach * 3)),
   got AS (SELECT page_id, arg_max(found, len(found)) AS found FROM walk GROUP BY page_id)
   SELECT page_id, unnest(CASE WHEN found IS NULL THEN above ELSE list_concat(above, found) END) AS row_y FROM rc LEFT JOIN got USING (page_id)""", SEGS)
def w14(spark, sf):
    p = pages(spark, sf)
    rows = F.filter("hs", lambda y: y < 200)
    return p.select("page_id", F.explode(lines.extended_rows(rows, F.col("hs"), F.lit(200), F.lit(900))).alias("row_y"))


@query("W15", PL + " SELECT page_id, coalesce(list_filter(hs, lambda y: y >= 195)[1], hs[1], 0) AS top, coalesce(hs[-1], 900) AS bottom FROM pl", SEGS)
def w15(spark, sf):
    top, bottom = lines.data_rows(F.col("hs"), F.lit(200), F.lit(0), F.lit(900))
    return pages(spark, sf).select("page_id", top.alias("top"), bottom.alias("bottom"))


_A9 = """, seg AS (SELECT DISTINCT page_id, pos, start_px AS lo, end_px AS hi, end_px - start_px AS len FROM line_segments WHERE axis = '{ax}'),
  m AS (SELECT a.page_id, a.pos AS ap, a.lo AS alo, a.hi AS ahi, b.pos, b.lo, b.hi, b.len FROM seg a JOIN seg b ON a.page_id = b.page_id AND abs(a.lo - b.lo) <= 12 AND abs(a.hi - b.hi) <= 12),
  sc AS (SELECT page_id, ap, alo, ahi, count(*) AS n, list_sort(list(len))[count(*) // 2 + 1] AS med_len, max(pos) AS deepest, CAST(trunc(median(hi)) AS INTEGER) AS median_hi FROM m GROUP BY page_id, ap, alo, ahi HAVING count(*) >= 2),
  best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY med_len DESC, ap, alo, ahi) = 1)"""


@query("A9", _A9.format(ax="h") + " SELECT page_id, med_len, CAST(n AS INTEGER) AS n, ap AS anchor_pos, alo AS anchor_lo, ahi AS anchor_hi FROM best", SEGS)
def a9(spark, sf):
    return lines.aligned_sets(segs(spark, sf), "h", 12).select("page_id", "med_len", "n", "anchor_pos", "anchor_lo", "anchor_hi")


_A10 = (_A9.format(ax="h").replace("seg AS", "hseg AS").replace("seg a JOIN seg b", "hseg a JOIN hseg b").replace(" m AS", " hm AS").replace("FROM m ", "FROM hm ").replace(" sc AS", " hsc AS").replace("FROM sc ", "FROM hsc ").replace("best AS", "hbest AS")
       + _A9.format(ax="v") + """ , near AS (SELECT h.page_id, max(m.pos) AS x FROM hbest h JOIN best b USING (page_id) JOIN m ON m.page_id = b.page_id AND m.ap = b.ap AND m.alo = b.alo AND m.ahi = b.ahi
     WHERE abs(m.pos - h.median_hi) <= 20 GROUP BY h.page_id)
   SELECT h.page_id, least(img_w, coalesce(near.x, h.median_hi)) AS zone_right, least(img_h, h.deepest) AS zone_bottom FROM hbest h JOIN page_sizes USING (page_id) LEFT JOIN near USING (page_id)""")


@query("A10", _A10, ("line_segments", "page_sizes"))
def a10(spark, sf):
    from drawmark.operators.tables import table_zones
    return table_zones(segs(spark, sf), view(spark, sf, "page_sizes")).select("page_id", "zone_right", "zone_bottom")


def _cut(ax: str) -> str:
    return f"""{ax}s AS (SELECT page_id, list_sort(list(DISTINCT len)) AS sz FROM merged WHERE axis = '{ax}' GROUP BY page_id),
      {ax}g AS (SELECT page_id, sz, {gap_list('sz')} AS gs FROM {ax}s),
      {ax}c AS (SELECT page_id, len(sz) AS n, list_filter(list_transform(gs, lambda g, i: CASE WHEN g > greatest(list_sort(gs)[len(gs) // 2 + 1] * 3, 30) THEN sz[i] END), lambda v: v IS NOT NULL)[1] AS cut FROM {ax}g)"""


_A11 = _SPANS.format(gap=10) + ", " + _cut("v") + ", " + _cut("h") + """, longs AS (SELECT page_id, axis, pos FROM merged JOIN vc USING (page_id) WHERE axis = 'v' AND (n < 2 OR cut IS NULL OR len > cut)
   UNION ALL SELECT page_id, axis, pos FROM merged JOIN hc USING (page_id) WHERE axis = 'h' AND (n < 2 OR len > cut))"""


def long_pages(spark, sf):
    p = lines.page_spans(segs(spark, sf))
    return p.select("page_id", lines.long_lines(lines.merge_spans(F.col("h_spans"), 10), False).alias("h_long"),
                    lines.long_lines(lines.merge_spans(F.col("v_spans"), 10), True).alias("v_long"))


@query("A11", _A11 + " SELECT * FROM longs", SEGS)
def a11(spark, sf):
    both = F.array(F.struct(F.lit("h").alias("axis"), F.col("h_long").alias("ps")), F.struct(F.lit("v").alias("axis"), F.col("v_long").alias("ps")))
    return long_pages(spark, sf).select("page_id", F.explode(both).alias("b")).select("page_id", "b.axis", F.explode("b.ps").alias("pos"))


def _crop(v: int, h: int) -> str:
    return (f"SELECT page_id, coalesce(vl[-{v}], 0) AS x1, coalesce(hl[-{h}], 0) AS y1, 900 AS x2, 480 AS y2 FROM "
            f"(SELECT page_id, list_sort(list(pos) FILTER (axis = 'v')) AS vl, list_sort(list(pos) FILTER (axis = 'h')) AS hl FROM "
            f"(SELECT DISTINCT page_id, NULL AS axis, NULL AS pos FROM line_segments UNION ALL SELECT * FROM longs) GROUP BY page_id) WHERE 900 - coalesce(vl[-{v}], 0) >= 20 AND 480 - coalesce(hl[-{h}], 0) >= 20")


@query("O5", _A11 + " " + _crop(3, 3), SEGS)
def o5(spark, sf):
    p = long_pages(spark, sf)
    return p.select("page_id", lines.nth_crop(F.col("v_long"), F.col("h_long"), 3, 3, F.lit(900), F.lit(480)).alias("c")).filter("c IS NOT NULL").select("page_id", "c.*")


@query("O6", _A11 + f" SELECT page_id, CAST(min(step) AS INTEGER) AS step, x1, y1, x2, y2 FROM (SELECT 1 AS step, * FROM ({_crop(3, 3)}) UNION ALL SELECT 2, * FROM ({_crop(2, 2)})) GROUP BY page_id, x1, y1, x2, y2", SEGS)
def o6(spark, sf):
    p = long_pages(spark, sf)
    crops = F.array_distinct(F.array(*[lines.nth_crop(F.col("v_long"), F.col("h_long"), r, r, F.lit(900), F.lit(480)) for r in (3, 2)]))
    rows = p.select("page_id", F.posexplode(crops).alias("i", "c")).filter("c IS NOT NULL")
    return rows.select("page_id", (F.col("i") + 1).alias("step"), "c.*")


_FITS = "max(pos) FILTER (axis = '{a}' AND level = {l} AND len >= greatest(CAST(trunc({s} * ({r} / 100)) AS INTEGER), 100))"


def _frame_sql() -> str:
    picks, cols = [], []
    for r in (50, 40):
        for l in (0, 1, 2):
            for a, s in (("h", "img_w"), ("v", "img_h")):
                mx = _FITS.format(a=a, l=l, s=s, r=r)
                cols += [f"{mx} AS {a}_hi_{r}_{l}", f"{mx.replace('max(pos)', 'min(pos)')} AS {a}_lo_{r}_{l}"]
            k = f"_{r}_{l}"
            ok = f"v_lo{k} < v_hi{k} AND h_lo{k} < h_hi{k}"
            if r == 40:
                ok += f" AND v_lo{k} < img_w * 0.15 AND h_lo{k} < img_h * 0.15 AND v_hi{k} - v_lo{k} > img_w * 0.7 AND h_hi{k} - h_lo{k} > img_h * 0.7"
            picks.append(f"WHEN {ok} THEN [v_lo{k}, h_lo{k}, v_hi{k}, h_hi{k}]")
    return (f", agg AS (SELECT page_id, img_w, img_h, {', '.join(cols)} FROM (SELECT p.*, axis, level, pos, end_px - start_px AS len FROM page_sizes p LEFT JOIN line_segments USING (page_id)) GROUP BY page_id, img_w, img_h), "
            f"f AS (SELECT page_id, CASE {' '.join(picks)} ELSE [{tr('img_w * 0.05')}, {tr('img_h * 0.05')}, img_w - {tr('img_w * 0.05')}, img_h - {tr('img_h * 0.05')}] END AS b FROM agg) "
            f"SELECT page_id, b[1] AS x1, b[2] AS y1, b[3] AS x2, b[4] AS y2 FROM f")


@query("A12", _frame_sql(), ("page_sizes", "line_segments"))
def a12(spark, sf):
    return lines.frame_boxes(segs(spark, sf), view(spark, sf, "page_sizes")).select("page_id", "x1", "y1", "x2", "y2")


@query("A15", """SELECT page_id, arg_max(y, (y + h / 2) * 1000000000 - (CAST(row_no AS BIGINT))) AS y_cut FROM (SELECT c.*, img_w, img_h, row_number() OVER (PARTITION BY page_id ORDER BY y, x, cc_id) AS row_no FROM components c JOIN page_sizes USING (page_id)
   WHERE w >= CAST(trunc(img_w * 0.3) AS INTEGER) AND y + h / 2 > 400 * (2 / 3)) GROUP BY page_id""", ("components", "page_sizes"))
def a15(spark, sf):
    from drawmark.operators.tables import bottom_span
    pages = view(spark, sf, "page_sizes").select("page_id", "img_w", F.lit(400).alias("img_h"))
    return bottom_span(view(spark, sf, "components"), pages, share=0.3)


@query("A16", PL + f""", r AS (SELECT page_id, hs, vs, img_w AS w, img_h AS h, unnest(hs[2:]) AS bot, unnest(hs[1:len(hs) - 1]) AS top FROM pl JOIN page_sizes USING (page_id)),
   c AS (SELECT page_id, unnest(vs[2:]) AS rt, unnest(vs[1:len(vs) - 1]) AS lf FROM pl),
   k AS (SELECT r.page_id, bot, top, rt, lf, (bot / h) * 0.6 + ((rt - lf) / w) * 0.4 AS score FROM r JOIN c USING (page_id) WHERE bot - top >= 5 AND rt - lf >= 10 AND bot > h * 0.4 AND rt - lf > w * 0.15 AND bot - top > 8 AND bot - top < h * 0.5),
   b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, lf DESC, top DESC) = 1)
   SELECT page_id, CASE WHEN bot IS NULL THEN 0 ELSE lf + 4 END AS x1, CASE WHEN bot IS NULL THEN {tr('img_h * 0.7')} ELSE top + 4 END AS y1, CASE WHEN bot IS NULL THEN img_w ELSE lf + 4 + greatest(rt - lf - 8, 1) END AS x2,
   CASE WHEN bot IS NULL THEN img_h ELSE top + 4 + greatest(bot - top - 8, 1) END AS y2 FROM (SELECT page_id, img_w, img_h FROM page_sizes JOIN pl USING (page_id)) LEFT JOIN b USING (page_id)""", ("line_segments", "page_sizes"))
def a16(spark, sf):
    p = pages(spark, sf).join(view(spark, sf, "page_sizes"), "page_id")
    return p.select("page_id", *lines.fallback_cell(F.col("hs"), F.col("vs"), F.col("img_w"), F.col("img_h")).columns())


@query("A18", PL + _PROFILE + """, ln AS (SELECT page_id, sum(value) / CAST(1000 AS DOUBLE) AS mean FROM prof GROUP BY page_id),
   hi AS (SELECT pl.page_id, pos FROM prof JOIN ln USING (page_id) JOIN pl USING (page_id) WHERE value > greatest(mean * 3, 0.15) AND pos >= 1 AND pos < 999
     AND len(list_filter(vs, lambda e: abs(prof.pos - e) <= 10)) = 0),
   ord AS (SELECT page_id, list_sort(list(pos)) AS ps FROM hi GROUP BY page_id),
   walk AS (SELECT page_id, ps, ps[1] AS kept FROM ord UNION ALL
     SELECT page_id, ps, list_filter(ps, lambda p: p > walk.kept + 10)[1] FROM walk WHERE len(list_filter(ps, lambda p: p > walk.kept + 10)) > 0)
   SELECT page_id, unnest(vs) AS pos FROM pl UNION ALL SELECT page_id, kept FROM walk""", SEGS)
def a18(spark, sf):
    from drawmark.operators.profiles import with_profile_lines
    return with_profile_lines(pages(spark, sf).select("page_id", F.col("vs").alias("ps")), line_profile(spark, sf), side=1000)


@query("J17", _W4 + """, ch AS (SELECT page_id, cell_height, rows, unnest(range(0, len(rows), 2)) AS i FROM w4 WHERE len(rows) > 0)
   SELECT page_id, CAST(i // 2 AS INTEGER) AS chunk, rows[i + 1] AS top, CASE WHEN i + 3 < len(rows) THEN rows[i + 4] ELSE least(rows[-1] + cell_height, 500) END AS bottom, CAST(len(rows[i + 1:least(i + 3, len(rows))]) AS INTEGER) AS n_rows
   FROM ch WHERE i = 0 OR i - 2 + 3 < len(rows)""", SEGS)
def j17(spark, sf):
    from drawmark.operators.cells import row_chunks
    p = (all_lines(spark, sf).withColumn("h", lines.common_gap(F.col("ps"))).filter("h IS NOT NULL")
         .withColumn("rows", lines.grid_rows(F.col("ps"), F.col("h"))))
    return row_chunks(p, size=3, overlap=1, page_bottom=500)
