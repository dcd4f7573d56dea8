"""Operators on the three number regions of a page, its search areas and its components.

A page has three region boxes at most, so they travel as columns of one row per page."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawmark.functions import names
from drawmark.functions.boxes import Box, whole

REGIONS = {"red": "material_code_column", "green": "bottom_right_number", "orange": "top_left_number"}


def region_box(name: str) -> Box:
    return Box.sized(*[F.col(f"{name}_{c}") for c in "xywh"])


def landscape(pages: DataFrame) -> DataFrame:
    """Upright pages are turned, so width and height change places."""
    return pages.select("page_id", (F.col("img_h") > F.col("img_w")).alias("rotated"),
                        F.greatest("img_w", "img_h").alias("img_w"), F.least("img_w", "img_h").alias("img_h"))


def search_areas(w: Column, h: Column, frame: Box, red: Box) -> dict[str, Box]:
    """Areas in which the regions are searched; the top-left one depends on the number column found."""
    return {
        "red": Box(whole(w * 0.08), F.lit(0), frame.x1 + whole(frame.w * (2.8 / 8.0)), whole(h * 0.95)),
        "green": Box(whole(w * (5.0 / 8.0)), whole(h * (5.0 / 6.0)), w, h),
        "orange": Box(F.lit(0), F.lit(0), F.coalesce(red.x1, whole(w * (2.0 / 8.0))),
                      F.coalesce(red.y1, whole(h * (2.0 / 12.0)))),
    }


def dependent_areas(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Areas that follow from regions found before, with the page's own measures where one is missing."""
    joined = pages.join(regions, "page_id", "left")
    orange = search_areas(F.col("img_w"), F.col("img_h"), Box(*[F.lit(0)] * 4), region_box("red"))["orange"]
    return joined.select("page_id", orange.x2.alias("orange_right"), orange.y2.alias("orange_bottom"),
                         F.coalesce("green_y", "img_h").alias("note_bottom"), F.coalesce("orange_x", F.lit(0)).alias("note_left"))


def suppressed(regions: DataFrame) -> DataFrame:
    """Null the regions that the file's first letter keeps out of the output."""
    lettered = regions.withColumn("_letter", names.first_letter(F.col("file_name")))
    kept = {f"{name}_{c}": F.when(~names.suppresses(F.col("_letter"), region), F.col(f"{name}_{c}"))
            for name, region in REGIONS.items() for c in "xywh"}
    return lettered.withColumns(kept).drop("_letter")


def outside(items: DataFrame, regions: DataFrame, which: tuple[str, ...]) -> DataFrame:
    """Items that do not lie wholly in one of the regions."""
    inside = F.lit(False)
    for name in which:
        inside = inside | F.coalesce(region_box(name).has(Box.corners()), F.lit(False))
    return items.join(regions, "page_id", "left").filter(~inside).select(*items.columns)


def mostly_in_regions(box: Box, share: float) -> Column:
    """More than ``share`` of the box lies in one of the regions."""
    out = F.lit(False)
    for name in REGIONS:
        out = out | F.coalesce(box.covered_by(region_box(name)) > share, F.lit(False))
    return out


def centre_outside_zone(boxes: DataFrame, zones: DataFrame) -> DataFrame:
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inside = (cx >= 0) & (cx <= F.col("zone_right")) & (cy >= 0) & (cy <= F.col("zone_bottom"))
    return boxes.join(zones, "page_id", "left").filter(~F.coalesce(inside, F.lit(False))).select(*boxes.columns)


def inside_zone(boxes: DataFrame, zones: DataFrame) -> DataFrame:
    zone = Box(F.lit(0), F.lit(0), F.col("zone_right"), F.col("zone_bottom"))
    return boxes.join(zones, "page_id").filter(zone.has(Box.corners())).select(*boxes.columns)


def note_areas(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Area searched for note codes, with the region boxes moved into it (null where nothing is left)."""
    area = regions.join(pages, "page_id").select(
        "*", F.lit(0).alias("fn_top"), F.coalesce("green_y", "img_h").alias("fn_bottom"),
        F.coalesce("orange_x", F.lit(0)).alias("fn_left"), F.col("img_w").alias("fn_right"))
    area = area.filter("fn_bottom > fn_top AND fn_right > fn_left")
    for name in REGIONS:
        box = region_box(name)
        moved = Box(F.greatest(box.x1 - F.col("fn_left"), F.lit(0)), F.greatest(box.y1 - F.col("fn_top"), F.lit(0)),
                    F.least(box.x2 - F.col("fn_left"), F.col("fn_right") - F.col("fn_left")),
                    F.least(box.y2 - F.col("fn_top"), F.col("fn_bottom") - F.col("fn_top")))
        # least and greatest skip nulls, so a missing region has to stay missing by hand
        ok = F.col(f"{name}_x").isNotNull() & (moved.x2 > moved.x1) & (moved.y2 > moved.y1)
        area = area.select("*", *[F.when(ok, v).alias(f"{name}_{n}") for v, n in
                                  ((moved.x1, "x1"), (moved.y1, "y1"), (moved.x2, "x2"), (moved.y2, "y2"))])
    return area


def classified(components: DataFrame, pages: DataFrame) -> DataFrame:
    """Components with their class: huge, noise, line, block or text."""
    w, h, area = F.col("w"), F.col("h"), F.col("area")
    long_side, short_side = F.greatest(w, h), F.least(w, h)
    thin = (long_side / F.greatest(short_side, F.lit(1)) > 8) & (area / F.greatest(w * h, F.lit(1)) < 0.15)
    cls = (F.when((w > F.col("img_w") * 0.7) | (h > F.col("img_h") * 0.7), "huge").when(area < 8, "noise")
           .when(thin, "line").when((area > 5000) & (long_side > 100), "block").otherwise("text"))
    return components.join(pages, "page_id").withColumn("class", cls)


def usable_component() -> Column:
    """Text of 200 px or more, any block, and lines up to 30% of the page's short side."""
    return (((F.col("class") == "text") & (F.col("area") >= 200)) | (F.col("class") == "block")
            | ((F.col("class") == "line") & (F.greatest("w", "h") <= F.least("img_w", "img_h") * 0.3)))


def small_at_edge(box: Box, w: Column, h: Column, margin: int = 100, max_area: int = 500) -> Column:
    near = (box.cx < margin) | (box.cx > w - margin) | (box.cy < margin) | (box.cy > h - margin)
    return near & (box.area < max_area)


def large_enough(box: Box) -> Column:
    """Both sides 30 px or more and 2000 px of area."""
    return (F.least(box.w, box.h) >= 30) & (box.area >= 2000)


def text_gaps(components: DataFrame, h_factor: float = 8, v_factor: float = 1.5) -> DataFrame:
    """Median text height of a page (20 without text) and the gaps derived from it."""
    median = components.groupBy("page_id").agg(
        F.percentile(F.when(F.col("class") == "text", F.col("h")), F.lit(0.5)).alias("m"))
    m = F.coalesce(whole(F.col("m")), F.lit(20))
    return median.select("page_id", m.alias("median_h"), F.greatest(whole(m * h_factor), F.lit(12)).alias("h_gap"),
                         F.greatest(whole(m * v_factor), F.lit(8)).alias("v_gap"))


def border_segments(segments: DataFrame, pages: DataFrame, share: float = 0.95, band: float = 0.05) -> DataFrame:
    """Lines that span a side of the page and lie in its outer band."""
    is_h = F.col("axis") == "h"
    side = F.when(is_h, F.col("img_w")).otherwise(F.col("img_h"))
    depth = F.when(is_h, F.col("img_h")).otherwise(F.col("img_w"))
    spans = F.col("end_px") - F.col("start_px") >= whole(side * share)
    outer = (F.col("pos") < depth * band) | (F.col("pos") > depth * (1 - band))
    return segments.join(pages, "page_id").filter(spans & outer)


def strike_candidates(marks: DataFrame, pages: DataFrame, cell_width: int) -> DataFrame:
    """Marks that may strike a cell's text: in its middle 70%, four pixels thick at most and long enough."""
    h = F.col("h")
    hit_rows = F.filter("rows", lambda y: (F.col("pos") - y >= whole(h * 0.15)) & (F.col("pos") - y <= whole(h * 0.85)))
    fits = (F.col("thick") <= 4) & (F.col("len") >= max(int(cell_width * 0.4), 15)) & (h >= 10) & F.lit(cell_width >= 10)
    return (marks.join(pages, "page_id").filter(fits)
            .select("page_id", F.explode(hit_rows).alias("cell_top"), "pos", "len", "thick"))


def both_sides(l_top: str, l_bottom: str, r_top: str, r_bottom: str, top: Column, bottom: Column) -> dict[str, Column]:
    """Hull of the extents of a column's two sides; one side, or the page, where the other is missing."""
    return {"table_top": F.coalesce(F.least(l_top, r_top), top), "table_bottom": F.coalesce(F.greatest(l_bottom, r_bottom), bottom)}
