"""Joins of items with the lines around them.

Every join here is an equi join on the page with one row per page on the line side, so no pairs of
items and lines are formed and a crowded page can be cut into as many tasks as its items need."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawmark.functions.boxes import Box
from drawmark.functions.text import bind, found, led_cell, no_spaces, strip
from drawmark.operators.items import first_per
from drawmark.operators.lines import last


def nearest_below(arr: Column, value: Column, strict: bool = False) -> Column:
    return last(F.filter(arr, (lambda p: p < value) if strict else (lambda p: p <= value)))


def nearest_above(arr: Column, value: Column, strict: bool = False) -> Column:
    return F.get(F.filter(arr, (lambda p: p > value) if strict else (lambda p: p >= value)), F.lit(0))


def nearest_to(arr: Column, value: Column) -> Column:
    """Closest position, the first one on a tie."""
    ranked = F.transform(arr, lambda p, i: F.struct(F.abs(p - value).alias("d"), i.alias("i"), p.alias("p")))
    return F.array_min(ranked)["p"]


def row_chunks(pages: DataFrame, size: int = 10, overlap: int = 2, page_bottom: int | Column = 1 << 30) -> DataFrame:
    """Overlapping chunks of a page's rows. ``pages``: page_id, rows and the cell height h."""
    step = max(size - overlap, 1)
    bottom = page_bottom if isinstance(page_bottom, Column) else F.lit(page_bottom)
    n = F.size("rows")
    n_chunks = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    chunks = (pages.filter(n > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1)))
              .withColumn("i", F.col("chunk") * step))
    end = F.col("i") + size
    return chunks.select(
        "page_id", "chunk", F.get("rows", F.col("i")).alias("top"),
        F.coalesce(F.get("rows", end), F.least(last(F.col("rows")) + F.col("h"), bottom)).alias("bottom"),
        F.size(F.slice("rows", F.col("i") + 1, F.lit(size))).alias("n_rows"))


def grid_cells(items: DataFrame, pages: DataFrame) -> DataFrame:
    """First prefixed text of each grid cell. ``pages``: page_id, rows, strikes and the cell height h.

    An item belongs to the first row line at most one cell height above its centre."""
    # a step of its own, as the test for a prefix names the text several times
    read = items.select("page_id", "seq", ((F.col("y1") + F.col("y2")) / 2).alias("cy"), strip(no_spaces(F.col("text"))).alias("_text"))
    read = read.select("page_id", "seq", "cy", found(led_cell(F.col("_text"))).alias("cell_text"))
    # whether a row is struck is settled once per page, not per item
    marked = F.transform("rows", lambda y: F.struct(y.alias("top"), F.exists("strikes", lambda s: (s > y) & (s < y + F.col("h"))).alias("struck")))
    grid = pages.select("page_id", "h", marked.alias("marked"))
    rows = F.filter("marked", lambda r: (r["top"] <= F.col("cy")) & (F.col("cy") < r["top"] + F.col("h")))
    placed = read.join(grid, "page_id").select("page_id", "h", "seq", "cell_text", F.explode(F.slice(rows, 1, 1)).alias("row"))
    placed = placed.select("page_id", F.col("row.top").alias("cell_top"), "seq", "cell_text", (F.col("row.top") + F.col("h")).alias("cell_bottom"),
                           F.col("row.struck").alias("struck"))
    return first_per(placed, ["page_id", "cell_top"], [F.col("seq")], ["cell_bottom", "cell_text", "struck"])


def enclosing_cells(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Cell around each item's box from the nearest lines; the item's own edge where there is none."""
    joined = items.join(pages, "page_id", "left")
    box = Box.corners()
    no_lines = F.expr("CAST(array() AS array<int>)")
    hs, vs = F.coalesce("hs", no_lines), F.coalesce("vs", no_lines)
    margin = box.w * 0.1
    left = nearest_to(F.filter(vs, lambda x: (x <= box.cx) & (x >= box.x1 - margin) & (x <= box.x1 + margin)), box.x1)
    sides = Box(F.least(left, box.x1), F.least(nearest_below(hs, box.cy), box.y1),
                F.greatest(nearest_above(vs, box.cx), box.x2), F.greatest(nearest_above(hs, box.cy), box.y2))
    return joined.select(*items.columns, *sides.columns("cell_"))


def strict_cells(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Cell from the nearest lines whose extent covers the item's centre, searched within twice the
    item's size; the page's edge where there is none. ``pages``: page_id, img_w, img_h, h_spans, v_spans."""
    box = Box.corners()
    joined = items.join(pages, "page_id")

    def side(spans: str, centre: Column, cross: Column, lo: Column, hi: Column, below: bool) -> Column:
        def fits(s: Column) -> Column:
            place = (s["pos"] < centre) if below else (s["pos"] > centre)
            return place & (s["pos"] >= lo) & (s["pos"] <= hi) & (s["lo"] <= cross) & (cross <= s["hi"])
        found = F.transform(F.filter(F.col(spans), fits), lambda s: s["pos"])
        return F.array_max(found) if below else F.array_min(found)

    x_lo, x_hi = F.greatest(F.lit(0), box.x1 - box.w * 2), F.least(F.col("img_w"), box.x2 + box.w * 2)
    y_lo, y_hi = F.greatest(F.lit(0), box.y1 - box.h * 2), F.least(F.col("img_h"), box.y2 + box.h * 2)
    cell = Box(F.coalesce(side("v_spans", box.cx, box.cy, x_lo, x_hi, True), F.lit(0)),
               F.coalesce(side("h_spans", box.cy, box.cx, y_lo, y_hi, True), F.lit(0)),
               F.coalesce(side("v_spans", box.cx, box.cy, x_lo, x_hi, False), F.col("img_w")),
               F.coalesce(side("h_spans", box.cy, box.cx, y_lo, y_hi, False), F.col("img_h")))
    return joined.select(*items.columns, *cell.columns("cell_"))


def row_of(centre: Column, rows: Column) -> tuple[Column, Column]:
    """Row around a centre; extrapolated by the neighbouring gap outside the rows, +-8 px without rows."""
    n = F.size(rows)
    top = nearest_below(rows, centre)
    first, final = F.get(rows, F.lit(0)), last(rows)
    # a centre on an inner line belongs to the row that ends there
    inner = F.get(F.filter(F.transform(rows, lambda y, i: F.struct(F.get(rows, i - 1).alias("a"), y.alias("b"))),
                           lambda r: r["a"].isNotNull() & (r["a"] <= centre) & (centre <= r["b"])), F.lit(0))
    low, high = F.greatest(centre - 8, F.lit(0)), centre + 8
    a = (F.when(n < 2, low).when(inner.isNotNull(), inner["a"]).when(centre > final, final)
         .when(centre < first, first - (F.get(rows, F.lit(1)) - first)).otherwise(low))
    b = (F.when(n < 2, high).when(inner.isNotNull(), inner["b"]).when(centre > final, final + (final - F.get(rows, n - 2)))
         .when(centre < first, first).otherwise(high))
    return a, b


def column_interval(lines: Column, centre: Column, def_cx: Column, group_cx: Column, coarse: Column, max_width: int = 600) -> Column:
    """Column (x1, x2) around a keyword between neighbouring vertical lines.

    Anchors of the neighbouring columns pull the edges in; without an interval around the keyword the one
    with the nearest middle is taken; a column wider than ``max_width`` is looked up in the coarse lines."""
    def intervals(vs: Column) -> Column:
        return F.transform(F.slice(vs, F.lit(2), F.greatest(F.size(vs) - 1, F.lit(0))),
                           lambda b, i: F.struct(F.get(vs, i).alias("a"), b.alias("b")))

    def around(vs: Column) -> Column:
        return F.get(F.filter(intervals(vs), lambda r: (r["a"] <= centre) & (centre <= r["b"])), F.lit(0))

    def nearest(vs: Column) -> Column:
        ranked = F.transform(intervals(vs), lambda r, i: F.struct(
            F.abs((r["a"] + r["b"]) / 2 - centre).alias("d"), i.alias("i"), r["a"].alias("a"), r["b"].alias("b")))
        return bind(F.array_min(ranked), lambda r: F.when(r.isNotNull(), F.struct(r["a"].alias("a"), r["b"].alias("b"))))

    def pulled(r: Column) -> Column:
        left = F.get(F.filter(lines, lambda x: (def_cx < x) & (x < centre)), F.lit(0))
        right = F.get(F.filter(lines, lambda x: (centre < x) & (x < group_cx)), F.lit(0))
        return F.struct(
            F.when((r["a"] <= def_cx) & (def_cx <= r["b"]) & left.isNotNull(), left).otherwise(r["a"]).alias("a"),
            F.when((F.when((r["a"] <= def_cx) & (def_cx <= r["b"]) & left.isNotNull(), left).otherwise(r["a"]) <= group_cx)
                   & (group_cx <= r["b"]) & right.isNotNull(), right).otherwise(r["b"]).alias("b"))

    found = bind(around(lines), lambda r: F.when(r.isNotNull(), pulled(r)).otherwise(nearest(lines)))
    return bind(found, lambda r: F.when(r["b"] - r["a"] <= max_width, r).otherwise(
        bind(around(coarse), lambda c: F.when(c["b"] - c["a"] <= max_width, c))))


def right_lines(items: DataFrame, profile: DataFrame, pages: DataFrame, tile: int = 256) -> DataFrame:
    """Strongest vertical line near each item's right edge: ink over half of the item's height, the
    first one on a tie. ``profile``: page_id, pos, value (ink at that column).

    The profile is cut into tiles of ``tile`` columns with one row each; an item looks at the tiles its
    search range touches, which are two at most for ranges narrower than a tile."""
    box = Box.corners()
    char_w = F.greatest(F.floor(box.w / 9).cast("int"), F.lit(10))
    ranged = (items.join(pages.select("page_id", "img_w"), "page_id")
              .withColumn("from_x", F.greatest(F.lit(0), box.x2 - char_w))
              .withColumn("to_x", F.least(F.col("img_w"), box.x2 + F.floor(char_w / 2).cast("int")))
              .filter("to_x > from_x")
              .withColumn("tile", F.explode(F.sequence(F.floor(F.col("from_x") / tile), F.floor((F.col("to_x") - 1) / tile)))))
    tiles = (profile.groupBy("page_id", F.floor(F.col("pos") / tile).alias("tile"))
             .agg(F.array_sort(F.collect_set(F.struct("pos", "value"))).alias("columns")))
    strong = F.filter("columns", lambda c: (c["pos"] >= F.col("from_x")) & (c["pos"] < F.col("to_x")) & (c["value"] > box.h * 0.5))
    best = F.array_max(F.transform(strong, lambda c: F.struct(c["value"].alias("v"), (-c["pos"]).alias("p"))))
    found = (ranged.join(tiles, ["page_id", "tile"]).withColumn("best", best).filter("best IS NOT NULL"))
    return (found.groupBy("page_id", "seq").agg(F.max("best").alias("best"))
            .select("page_id", "seq", (-F.col("best")["p"]).cast("int").alias("line_x")))


def one_right_line(items: DataFrame, profile: DataFrame) -> DataFrame:
    """``right_lines`` where a page has one item: ``items`` (with the page's img_w) and line_x, null without a line. The item
    meets the page's columns as they are, without tiles."""
    box = Box.corners()
    char_w = F.greatest(F.floor(box.w / 9).cast("int"), F.lit(10))
    from_x, to_x = F.greatest(F.lit(0), box.x2 - char_w), F.least(F.col("img_w"), box.x2 + F.floor(char_w / 2).cast("int"))
    ink = profile.select(F.col("page_id").alias("_page"), "pos", "value")
    near = (F.col("page_id") == F.col("_page")) & (F.col("pos") >= from_x) & (F.col("pos") < to_x) & (F.col("value") > box.h * 0.5)
    best = F.max(F.struct(F.col("value").alias("v"), (-F.col("pos")).alias("p")))
    met = items.join(ink, near, "left").groupBy(*items.columns).agg(best.alias("_best"))
    return met.select(*items.columns, (-F.col("_best.p")).cast("int").alias("line_x"))


def column_lines(facts: DataFrame, reach: int = 200) -> DataFrame:
    """Vertical lines to locate a column with: near the keyword, else further down, else ink peaks; lines
    further than ``reach`` from the keyword do not count. Without lines the column follows the keyword box.

    ``facts``: one row per page with v_spans, peaks, the keyword's kx1, kx2, kw_cx, kw_cy, def_cx and the
    searched area's roi_w and roi_h."""
    cx, cy, w, h = (F.col(c) for c in ("kw_cx", "kw_cy", "roi_w", "roi_h"))
    side = F.greatest(F.lit(400), (w * 0.15).cast("int"))
    x_lo, x_hi = F.greatest(F.lit(0), (cx - side).cast("int")), F.least(w, (cx + side).cast("int"))

    def found(top: Column, bottom: Column, share: float, least_px: int) -> Column:
        need = F.greatest(((bottom - top) * share).cast("int"), F.lit(least_px))
        return F.transform(F.filter("v_spans", lambda s: (s["pos"] >= x_lo) & (s["pos"] < x_hi)
                                    & (F.least(s["hi"], bottom) - F.greatest(s["lo"], top) >= need)), lambda s: s["pos"])

    band = F.greatest(F.lit(100), (h * 0.05).cast("int"))
    near = found(F.greatest(F.lit(0), (cy - band).cast("int")), F.least(h, (cy + band).cast("int")), 0.3, 15)
    far_top, far_bottom = F.greatest(F.lit(0), (cy - 50).cast("int")), F.least(h, (cy + (h * 0.3).cast("int")).cast("int"))
    staged = (facts.withColumn("_near", near).withColumn("_far", found(far_top, far_bottom, 0.1, 20))
              .withColumn("_first", F.when(F.size("_near") >= 2, F.col("_near")).otherwise(F.col("_far")))
              .withColumn("_peaks", F.filter("peaks", lambda p: (p >= x_lo) & (p < x_hi))))

    def usable(lines: Column) -> Column:
        return (F.size(lines) >= 2) & (cx >= F.get(lines, F.lit(0)) - reach) & (cx <= last(lines) + reach)

    first, third = F.col("_first"), F.col("_peaks")
    level = (F.when(usable(first), F.when(F.size("_near") >= 2, 1).otherwise(2)).when(usable(third), 3).otherwise(4))
    margin = F.greatest(((F.col("kx2") - F.col("kx1")) * 0.05).cast("int"), F.lit(5))
    left = (F.col("kx1") - margin).cast("int")
    middle = F.when(F.col("def_cx") < F.col("kx1"), ((F.col("def_cx") + F.col("kx1")) / 2).cast("int"))
    return (staged.withColumn("level", level)
            .withColumn("lines", F.when(F.col("level") <= 2, first).when(F.col("level") == 3, third))
            .withColumn("own_left", F.greatest(left, middle)).withColumn("own_right", (F.col("kx2") + margin).cast("int"))
            .drop("_near", "_far", "_first", "_peaks"))
