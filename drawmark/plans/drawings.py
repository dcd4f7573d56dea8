"""Whole runs put together from the operators: from recognised items and lines to numbers, rewrites and logs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drawmark.functions import boxes, names, text
from drawmark.functions.boxes import Box
from drawmark.functions.readings import trim_at_line, widened
from drawmark.operators import cells, jobs, keywords, lines, overlap, regions, reports, tables, votes
from drawmark.operators import items as item_ops
from drawmark.operators.profiles import peaks as ink_peaks
from drawmark.operators.regions import suppressed
from drawmark.session import by_page, dealt, is_by_page, settled
from drawmark.sources import box_csv, logs
from drawmark.streaming import watch

CORNERS = ("x1", "y1", "x2", "y2")
_TABLES_FROM = 9_000_000_000_000_000_000
MIN_COLUMN_HEIGHT = 500
UNREADABLE = "page could not be read"


def red_grid(segments: DataFrame) -> DataFrame:
    """Row grid of the number column: page_id, h (cell height), rows and strikes."""
    found = segments.groupBy("page_id").agg(F.array_sort(F.collect_set("pos")).alias("raw"))
    return lines.row_grid(found.select("page_id", lines.cluster_means(F.col("raw")).alias("ps")))


def red_cells(items: DataFrame, segments: DataFrame) -> DataFrame:
    """Numbered cells of the number column, with a flag for struck ones."""
    return cells.grid_cells(items, red_grid(segments))


def merged_lines(segments: DataFrame) -> DataFrame:
    p = lines.page_spans(segments)
    return p.select("page_id", lines.merge_spans(F.col("h_spans"), 10).alias("h_spans"), lines.merge_spans(F.col("v_spans"), 10).alias("v_spans"))


def joined_headers(items: DataFrame) -> DataFrame:
    """Words joined from short header texts of each language, which come after the items, in their own order."""
    o = "order."
    last = (F.lit(1 << 62) + F.when(F.col(o + "axis") == "h", 0).otherwise(1).cast("bigint") * (1 << 60) + F.col(o + "band").cast("bigint") * (1 << 40)
            + F.col(o + "group").cast("bigint") * (1 << 18) + F.col(o + "width").cast("bigint") * (1 << 16) + F.col(o + "start"))
    joined = overlap.joined_short_texts(items.filter(F.col("lang").isin("en", "ch")), by_lang=True)
    return joined.select("page_id", "lang", last.alias("seq"), "text", *CORNERS)


def column_extents(segments: DataFrame, columns: DataFrame) -> DataFrame:
    """Pieces of the vertical lines within 5 px of each column side: page_id, left_pieces and right_pieces, sorted
    (lo, hi). ``columns``: page_id, a, b. Pieces stay apart, as holes between them decide how far a side reaches."""
    near = segments.filter("axis = 'v'").join(columns, "page_id")
    piece = F.struct(F.col("start_px").alias("lo"), F.col("end_px").alias("hi"))
    sides = {side: F.abs(F.col("pos") - F.col(at)) <= 5 for side, at in (("left", "a"), ("right", "b"))}
    return near.filter(sides["left"] | sides["right"]).groupBy("page_id").agg(
        *[F.array_sort(F.collect_set(F.when(close, piece))).alias(f"{side}_pieces") for side, close in sides.items()])


def locate_columns(items: DataFrame, segments: DataFrame, profile: DataFrame, pages: DataFrame) -> DataFrame:
    """Number column of each page: header keyword, neighbours, lines, extent, rows, content check, label fix."""
    items, segments, pages = by_page(items, order=["lang"]), by_page(segments, order=lines.LINE_ORDER), by_page(pages)
    joined = by_page(joined_headers(items))
    # the rules on texts see each text once; what they choose is stored by text, so its size is known and rows meet it where they are
    texts = by_page(items.select("text").unionByName(joined.select("text")).groupBy("text").agg(F.count("*").alias("n")), "text", placed=True)
    known = by_page(keywords.header_texts(texts), "text", placed=True)
    useful, marks = (by_page(of(texts), "text", placed=True) for of in (keywords.column_texts, keywords.neighbour_texts))
    matches = by_page(keywords.better_matches(*[keywords.header_matches(df, known) for df in (items, joined)]), placed=True)
    anchors = keywords.neighbour_anchors(items, matches, marks)
    spikes = ink_peaks(profile, 1, 10).groupBy("page_id").agg(F.array_sort(F.collect_set("centre")).alias("peaks"))
    empty = F.expr("CAST(array() AS array<struct<pos:int,lo:int,hi:int,len:int>>)")
    facts = (matches.select("page_id", F.col("x1").alias("kx1"), F.col("x2").alias("kx2"), ((F.col("y1") + F.col("y2")) / 2).alias("kw_cy"))
             .join(anchors, "page_id").withColumnRenamed("mat_cx", "kw_cx")
             .join(pages.select("page_id", F.col("img_w").alias("roi_w"), F.col("img_h").alias("roi_h")), "page_id")
             .join(merged_lines(segments), "page_id", "left").join(spikes, "page_id", "left")
             .withColumn("h_spans", F.coalesce("h_spans", empty)).withColumn("v_spans", F.coalesce("v_spans", empty))
             .withColumn("peaks", F.coalesce("peaks", lines.ints())))
    interval = F.when(F.col("level") < 4, cells.column_interval(F.col("lines"), F.col("kw_cx"), F.col("def_cx"), F.col("group_cx"), F.col("lines"))
                      ).otherwise(F.struct(F.col("own_left").alias("a"), F.col("own_right").alias("b")))
    placed = by_page(cells.column_lines(facts).select("page_id", "level", "kw_cy", "roi_h", "h_spans", text.found(interval).alias("col")), placed=True)

    pieces = column_extents(segments, placed.select("page_id", "col.a", "col.b"))
    none = F.expr("CAST(array() AS array<struct<lo:int,hi:int>>)")
    placed = (placed.join(pieces, "page_id", "left").withColumn("left_pieces", F.coalesce("left_pieces", none))
              .withColumn("right_pieces", F.coalesce("right_pieces", none)))

    def extent(side: str, gap: int) -> Column:
        return lines.linked_extent(F.col(f"{side}_pieces"), F.col("kw_cy"), gap)

    sided = placed.withColumn("_l", extent("left", 80)).withColumn("_r", extent("right", 80))
    sides = regions.both_sides("_l.lo", "_l.hi", "_r.lo", "_r.hi", F.lit(0), F.col("roi_h"))
    own = F.col("level") == 4
    sided = (sided.withColumn("table_top", F.when(own, F.greatest(F.lit(0), F.col("kw_cy").cast("int") - 20)).otherwise(sides["table_top"]))
             .withColumn("table_bottom", F.when(own, F.col("roi_h")).otherwise(sides["table_bottom"])))
    need = F.greatest(((F.col("col.b") - F.col("col.a")) * 0.3).cast("int"), F.lit(10))
    crossing = F.transform(F.filter("h_spans", lambda s: F.least(s["hi"], F.col("col.b") + 5) - F.greatest(s["lo"], F.col("col.a") - 5) >= need), lambda s: s["pos"])
    sided = sided.withColumn("_all", lines.keep_spaced(crossing, 8))

    def rows_between(top: str, bottom: str) -> Column:
        return F.filter("_all", lambda y: (y >= F.col(top)) & (y < F.col(bottom)))

    sided = sided.withColumn("_rows", rows_between("table_top", "table_bottom"))
    sided = sided.withColumn("_rows", lines.extended_rows(F.col("_rows"), F.col("_all"), F.col("table_bottom"), F.col("roi_h")))
    top, bottom = lines.data_rows(F.col("_rows"), F.col("kw_cy"), F.col("table_top"), F.col("table_bottom"))
    sided = sided.withColumn("_top", top).withColumn("_bottom", bottom)
    # a column lower than 500 px is looked at again, over larger holes
    again = sided.withColumn("_l", extent("left", 120)).withColumn("_r", extent("right", 120))
    for name, pick, default in (("lo", F.least, F.lit(0)), ("hi", F.greatest, F.col("roi_h"))):
        left, right = (F.nullif(F.col(f"{c}.{name}"), F.lit(0)) for c in ("_l", "_r"))  # zero counts as not found
        again = again.withColumn(f"_{name}", F.when(left.isNotNull() & right.isNotNull(), pick(left, right)).otherwise(F.coalesce(left, right, default)))
    again = again.withColumn("_rows", rows_between("_lo", "_hi"))
    top, bottom = lines.data_rows(F.col("_rows"), F.col("kw_cy"), F.col("_lo"), F.col("_hi"))
    low = F.col("_bottom") - F.col("_top") < MIN_COLUMN_HEIGHT
    columns = by_page(again.select("page_id", F.col("col.a").alias("x1"), F.when(low, top).otherwise(F.col("_top")).alias("y1"),
                                   F.col("col.b").alias("x2"), F.when(low, bottom).otherwise(F.col("_bottom")).alias("y2")), placed=True)
    valid = keywords.checked_columns(columns, items, matches, useful).filter("valid").drop("valid")
    return item_ops.shift_left_edge(valid, items)


def search_bottom_right(items: DataFrame, segments: DataFrame, profile: DataFrame, pages: DataFrame,
                        prefixes: Sequence[str] | None = None) -> DataFrame:
    """Bottom-right number in stages: whole area (0: trimmed at a line, 1: as read, 2: read again with more room), then the
    crops by the third (3, again: 4) and by the second long line (5, again: 6)."""
    return staged_search(stored_hits(items, prefixes), line_frames(segments, pages), by_page(profile))


def stored_hits(items: DataFrame, prefixes: Sequence[str] | None = None, placed: bool = False) -> DataFrame:
    """Numbers of the items with their tight boxes and the items' corners, stored by page. ``placed``: as in ``by_page``."""
    hits = item_ops.number_hits(items, prefixes).select("page_id", "seq", "number", "area", "tight", *CORNERS)
    return by_page(hits, placed=placed or is_by_page(items))


def line_frames(segments: DataFrame, pages: DataFrame, placed: bool = False) -> DataFrame:
    """Size and lines of each page in one row, stored by page: img_w, img_h, merged h_spans and v_spans, positions hs and vs.
    ``placed``: as in ``by_page``."""
    if not placed:
        segments, pages = dealt(segments), dealt(pages)
    found = lines.page_spans(segments).select(
        "page_id", *[lines.merge_spans(F.col(f"{a}_spans"), 10).alias(f"{a}_spans") for a in "hv"],
        *[F.array_compact(lines.positions(F.col(f"{a}_spans"))).alias(f"{a}s") for a in "hv"])
    return by_page(pages.select("page_id", "img_w", "img_h").join(found, "page_id", "left"), placed=True)


def staged_search(hits: DataFrame, frames: DataFrame, profile: DataFrame) -> DataFrame:
    """``search_bottom_right`` on the numbers (``stored_hits``) and lines (``line_frames``) of the pages, all stored by page or
    derived from what is.

    The first stage with an acceptable number counts, so only pages without one in stages 0 and 1 are searched further."""
    box = Box.corners()
    ranked = F.struct((-F.col("area")).alias("a"), "seq", "number", "tight")
    room, wide = widened(F.col("number"), box, F.col("img_w"), F.col("img_h"))

    def taken(stage: int, number: Column, tight: Column) -> Column:
        return F.when(text.accepted(number), F.struct(F.lit(stage).alias("stage"), number.alias("number"), tight.alias("tight")))

    def best(areas: dict[int, str]) -> list[Column]:
        """Largest hit of each stage, whose area is a column of corners."""
        return [F.min(F.when(Box.struct(F.col(area)).has_point(box.cx, box.cy), ranked)).alias(f"best{n}") for n, area in areas.items()]

    def repaired(stage: int) -> Column:
        return taken(stage, text.repair_digits(F.col(f"best{stage}.number")), F.col(f"best{stage}.tight"))

    whole = item_ops.first_per(hits, ["page_id"], [-F.col("area"), F.col("seq")], ["number", "tight"])
    boxed = whole.select("page_id", "number", "tight.*").join(frames.select("page_id", "img_w", "img_h"), "page_id")
    cut, cut_box = trim_at_line(F.col("number"), box, F.col("line_x"))
    trimmed = F.when((F.col("line_x") < box.x2 - 5) & (box.x2 > box.x1), taken(0, cut, cut_box.pack()))
    lined = cells.one_right_line(boxed, profile)
    tried = by_page(lined.withColumn("found", F.coalesce(trimmed, taken(1, F.col("number"), box.pack()))), placed=True)
    done = tried.select("page_id", "found")
    rest = tried.filter("found IS NULL")
    if not rest.isEmpty():
        wider = F.when((F.length("number") >= 7) & (room > 0), wide.pack())
        long = frames.join(rest.select("page_id", wider.alias("wide")), "page_id").select(
            "page_id", "img_w", "img_h", "wide", *[F.coalesce(lines.long_lines(F.coalesce(f"{a}_spans", lines.spans()), a == "v"), lines.ints()).alias(f"{a}_long") for a in "hv"])
        crops = long.select("page_id", F.struct("img_w", "img_h").alias("size"), "wide", *[
            lines.nth_crop(F.col("v_long"), F.col("h_long"), r, r, F.col("img_w"), F.col("img_h")).alias(f"crop{r}") for r in (3, 2)])
        seen = hits.join(crops, "page_id").groupBy("page_id", "size").agg(*best({2: "wide", 3: "crop3", 5: "crop2"}))
        # a crop's best number that is long enough but not acceptable is read again with more room, too: stages 4 and 6
        seen = seen.select("page_id", "size", *[repaired(n).alias(f"found{n}") for n in (2, 3, 5)], *[F.struct(
            text.repair_digits(F.col(f"best{n}.number")).alias("number"), F.col(f"best{n}.tight").alias("tight")).alias(f"short{n}") for n in (3, 5)])

        def again(n: int) -> Column:
            short = F.col(f"short{n}")
            more, area = widened(short["number"], Box.struct(short["tight"]), F.col("size.img_w"), F.col("size.img_h"))
            return F.when(F.col(f"found{n}").isNull() & (F.length(text.strip(short["number"])) >= 7) & (more > 0), area.pack())

        seen = by_page(seen.select("page_id", "found2", "found3", "found5", again(3).alias("wide3"), again(5).alias("wide5")), placed=True)
        reread = hits.join(seen.filter("found2 IS NULL AND found3 IS NULL AND (wide3 IS NOT NULL OR wide5 IS NOT NULL)").select("page_id", "wide3", "wide5"), "page_id")
        reread = reread.groupBy("page_id").agg(*best({4: "wide3", 6: "wide5"})).select("page_id", *[repaired(n).alias(f"found{n}") for n in (4, 6)])
        late = seen.join(reread, "page_id", "left").select("page_id", F.coalesce(*[f"found{n}" for n in (2, 3, 4, 5, 6)]).alias("late"))
        done = done.join(late, "page_id", "left").select("page_id", F.coalesce("found", "late").alias("found"))
    return done.filter("found IS NOT NULL").select("page_id", "found.stage", "found.number", "found.tight.*")


def bottom_right_numbers(items: DataFrame, segments: DataFrame, profile: DataFrame, pages: DataFrame,
                         prefixes: Sequence[str] | None = None) -> DataFrame:
    """Bottom-right number with its box: a first search, a crop around its cell, a second search, the merge
    with the cell found there. Where the second search fails the first result is clipped to its cell."""
    return framed_numbers(stored_hits(items, prefixes), line_frames(segments, pages), by_page(profile))


def framed_numbers(hits: DataFrame, frames: DataFrame, profile: DataFrame) -> DataFrame:
    """``bottom_right_numbers`` on the numbers (``stored_hits``) and lines (``line_frames``) of the pages."""
    first = staged_search(hits, frames, profile)
    # both searches look at the same numbers and lines
    cell = by_page(cells.strict_cells(first, frames), placed=True)
    box, c = Box.corners(), Box.corners("cell_")
    crop = cell.select("page_id", F.greatest(F.lit(0), c.x1 - boxes.whole(c.w * 0.25)).alias("crop_x"),
                       F.greatest(F.lit(0), c.y1 - boxes.whole(c.h * 0.25)).alias("crop_y"))
    inside = hits.join(crop, "page_id").filter((box.x1 >= F.col("crop_x")) & (box.y1 >= F.col("crop_y"))).select(*hits.columns)
    second = staged_search(inside, frames, profile)
    drawn = cells.enclosing_cells(second, frames.select("page_id", "hs", "vs"))

    def merged(prefix: str, corners: Sequence[Column]) -> list[Column]:
        return [F.col("number").alias(f"{prefix}number"), F.col("stage").alias(f"{prefix}stage"), *corners]

    merge = boxes.merge_with_cell(box, c, clip_right=True)
    better = drawn.select("page_id", F.struct(*merged("", merge.columns())).alias("better"))
    plain = cell.select("page_id", F.struct(*merged("", merge.columns())).alias("plain"))
    return plain.join(better, "page_id", "left").select("page_id", F.coalesce("better", "plain").alias("r")).select("page_id", "r.*")


def top_left_numbers(items: DataFrame, segments: DataFrame, areas: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """Top-left number: independent text, else after a label, else any match, else estimated from the label.

    ``areas``: page_id, red_x.. of the number column, whose items do not count in the first and third search."""
    inside = F.coalesce(regions.region_box("red").has(Box.corners()), F.lit(False))
    first = item_ops.ranked_numbers(items.join(areas, "page_id", "left"), ~inside, prefixes)
    celled = cells.enclosing_cells(first, lines.page_lines(segments))
    merged = boxes.merge_with_cell(Box.corners(), Box.corners("cell_"), clip_right=False)
    return celled.select("page_id", "strategy", "number", *merged.columns())


def note_crops(components: DataFrame, pages: DataFrame, table_boxes: DataFrame) -> DataFrame:
    """Text crops of a page: components by class, merged, grown by their lines, without tables, edge dust
    and nested boxes."""
    classed = regions.classified(components, pages)
    kept = classed.filter(regions.usable_component())
    corners = Box.sized(*[F.col(c) for c in "xywh"]).columns()
    found = kept.select("page_id", F.col("cc_id").alias("seq"), "class", *corners)
    merged = by_page(overlap.merged_boxes(found.filter(F.col("class").isin("text", "block"))))
    median = regions.text_gaps(classed).select("page_id", F.greatest(F.col("median_h") * 2, F.lit(30)).alias("reach"))
    grown = overlap.absorbed_lines(merged, found.filter("class = 'line'"), median)
    box = Box.corners()
    # accepted tables are apart from each other and 30 px or more on a side, so a page holds few of them
    tabled = table_boxes.groupBy("page_id").agg(F.collect_set(F.struct(*CORNERS)).alias("tables"))
    in_table = F.coalesce(F.exists("tables", lambda t: box.covered_by(Box.struct(t)) > 0.5), F.lit(False))
    free = by_page(grown.join(tabled, "page_id", "left").filter(~in_table).join(pages, "page_id")
            .filter(~regions.small_at_edge(box, F.col("img_w"), F.col("img_h"))).select("page_id", "seq", *CORNERS))
    return overlap.without_nested(free).filter(regions.large_enough(box))


def hits_in_crops(items: DataFrame, crops: DataFrame, tile: int = 512) -> DataFrame:
    """Tokens of the items whose centre lies in a crop, once per crop. Crops and items meet on tiles of the
    page, so only neighbours are compared."""
    read = (items.withColumn("token", text.find_token(F.col("text"))).filter("token IS NOT NULL")
            .select("page_id", "seq", "token", *CORNERS, Box.corners().cx.alias("cx"), Box.corners().cy.alias("cy"))
            .withColumn("tx", F.floor(F.col("cx") / tile)).withColumn("ty", F.floor(F.col("cy") / tile)))
    tiled = (crops.select("page_id", F.col("seq").alias("crop_seq"), *[F.col(c).alias(f"c{c}") for c in CORNERS])
             .withColumn("tx", F.explode(F.sequence(F.floor(F.col("cx1") / tile), F.floor(F.col("cx2") / tile))))
             .withColumn("ty", F.explode(F.sequence(F.floor(F.col("cy1") / tile), F.floor(F.col("cy2") / tile)))))
    crop = Box.corners("c")
    met = read.join(tiled, ["page_id", "tx", "ty"]).filter(crop.has_point(F.col("cx"), F.col("cy")))
    return met.select("page_id", "crop_seq", "seq", "token", *CORNERS)


def note_codes(items: DataFrame, components: DataFrame, pages: DataFrame, table_boxes: DataFrame, zones: DataFrame) -> DataFrame:
    """Codes of the note area: text crops and tables outside the zone, read, less what earlier crops gave."""
    crops = note_crops(components, pages, table_boxes).select("page_id", "seq", *CORNERS)
    # tables come after all text crops, from top to bottom
    place = F.lit(_TABLES_FROM) + F.col("y1").cast("bigint") * 100_000 + F.col("x1")
    outer = regions.centre_outside_zone(table_boxes, zones).select("page_id", place.alias("seq"), *CORNERS)
    both = crops.unionByName(outer).filter((F.col("x2") - F.col("x1") >= 6) & (F.col("y2") - F.col("y1") >= 6))
    hits = hits_in_crops(items, both).withColumnRenamed("crop_seq", "crop")
    # a crop with one new hit is kept and gives all its hits
    kept = overlap.crop_hits(hits).filter("kept").select("page_id", "crop")
    return hits.join(kept, ["page_id", "crop"], "left_semi").select("page_id", "token", *CORNERS)


def cut_segments(segments: DataFrame, areas: DataFrame) -> DataFrame:
    """Lines within one area of each page (page_id, area), in the area's own pixels."""
    a, is_h = Box.struct(F.col("area")), F.col("axis") == "h"
    pos = F.col("pos") - F.when(is_h, a.y1).otherwise(a.x1)
    depth, low = F.when(is_h, a.h).otherwise(a.w), F.when(is_h, a.x1).otherwise(a.y1)
    side = F.when(is_h, a.w).otherwise(a.h)
    rest = [c for c in segments.columns if c not in ("page_id", "axis", "pos", "start_px", "end_px")]
    cut = segments.join(areas, "page_id").select(
        "page_id", "axis", pos.alias("pos"), F.greatest(F.lit(0), F.col("start_px") - low).alias("start_px"),
        F.least(side, F.col("end_px") - low).alias("end_px"), depth.alias("_depth"), *rest)
    return cut.filter((F.col("pos") >= 0) & (F.col("pos") < F.col("_depth")) & (F.col("end_px") > F.col("start_px"))).drop("_depth")


def cut_profile(profile: DataFrame, areas: DataFrame) -> DataFrame:
    """Ink per column within one area of each page."""
    a = Box.struct(F.col("area"))
    return (profile.join(areas, "page_id").filter((F.col("pos") >= a.x1) & (F.col("pos") < a.x2))
            .select("page_id", (F.col("pos") - a.x1).alias("pos"), "value"))


def cut_items(items: DataFrame, areas: DataFrame) -> DataFrame:
    """Items whose centre lies in one area of each page, in the area's own pixels."""
    a, box = Box.struct(F.col("area")), Box.corners()
    moved = {c: (F.col(c) - (a.x1 if c in ("x1", "x2") else a.y1)).cast("int") for c in CORNERS}
    return items.join(areas, "page_id").filter(a.has_point(box.cx, box.cy)).withColumns(moved).select(*items.columns)


def area_sizes(areas: DataFrame) -> DataFrame:
    a = Box.struct(F.col("area"))
    return areas.select("page_id", a.w.cast("int").alias("img_w"), a.h.cast("int").alias("img_h"))


def moved_back(found: DataFrame, areas: DataFrame, name: str) -> DataFrame:
    """Corners of ``found`` in the pixels of the page, as ``{name}_x1`` and so on."""
    a = Box.struct(F.col("area"))
    rest = [c for c in found.columns if c not in CORNERS and c != "page_id"]
    return found.join(areas, "page_id").select("page_id", *rest, *[
        (F.col(c) + (a.x1 if c in ("x1", "x2") else a.y1)).cast("int").alias(f"{name}_{c}") for c in CORNERS])


def detected_regions(pages: DataFrame, items: DataFrame, headers: DataFrame, segments: DataFrame, profile: DataFrame,
                     prefixes: Sequence[str] | None = None) -> DataFrame:
    """All regions of each page in one row: number column, bottom-right number (from the line grid where none
    was read) and top-left number. Each search sees the lines, the ink and the size of its own area only."""
    pages, items, headers, segments, profile = (by_page(df) for df in (pages, items, headers, segments, profile))
    upright = regions.landscape(pages)
    sized = upright.select("page_id", "img_w", "img_h")
    frame = lines.frame_boxes(segments, sized).select("page_id", *[F.col(c).alias(f"f{c}") for c in CORNERS])
    searched = sized.join(frame, "page_id")
    no_red = Box(*[F.lit(None).cast("int")] * 4)
    first = regions.search_areas(F.col("img_w"), F.col("img_h"), Box.corners("f"), no_red)
    both = by_page(searched.select("page_id", first["red"].pack().alias("red_area"), first["green"].pack().alias("green_area")), placed=True)
    red_area, green_area = (both.select("page_id", F.col(f"{n}_area").alias("area")) for n in ("red", "green"))
    def cut(df: DataFrame) -> DataFrame:
        return by_page(df, placed=True)
    red = locate_columns(cut(cut_items(headers, red_area)), cut(cut_segments(segments, red_area)), cut(cut_profile(profile, red_area)), cut(area_sizes(red_area)))
    red = moved_back(red, red_area, "red")
    frames = line_frames(cut_segments(segments, green_area), area_sizes(green_area), placed=True)
    green = framed_numbers(stored_hits(cut_items(items, green_area), prefixes, placed=True), frames, cut(cut_profile(profile, green_area)))
    green = moved_back(green.select("page_id", F.col("number").alias("green_text"), *CORNERS), green_area, "green")
    grid = frames.withColumn("hs", F.coalesce("hs", lines.ints())).withColumn("vs", F.coalesce("vs", lines.ints()))
    spare = grid.select("page_id", *lines.fallback_cell(F.col("hs"), F.col("vs"), F.col("img_w"), F.col("img_h")).columns(""))
    spare = moved_back(spare, green_area, "spare")
    red = cut(red)
    known = searched.join(red, "page_id", "left")
    orange_area = regions.search_areas(F.col("img_w"), F.col("img_h"), Box.corners("f"), Box.corners("red_"))["orange"]
    top_left = cut(known.select("page_id", orange_area.pack().alias("area")))
    no_column = sized.select("page_id", *[F.lit(None).cast("int").alias(f"red_{c}") for c in "xywh"])
    orange = top_left_numbers(cut_items(items, top_left), cut_segments(segments, top_left), no_column, prefixes)
    orange = moved_back(orange.select("page_id", F.col("number").alias("orange_text"), *CORNERS), top_left, "orange")
    out = upright.join(red, "page_id", "left").join(green, "page_id", "left").join(spare, "page_id", "left").join(orange, "page_id", "left")
    return out.select("page_id", "rotated", F.when(F.col("red_x1").isNull(), "left_half").otherwise("keyword").alias("detected_by"),
                      *[f"red_{c}" for c in CORNERS], "green_text",
                      *[F.coalesce(f"green_{c}", f"spare_{c}").alias(f"green_{c}") for c in CORNERS],
                      "orange_text", *[f"orange_{c}" for c in CORNERS])


def detected_note_codes(found: DataFrame, pages: DataFrame, items: DataFrame, components: DataFrame, table_boxes: DataFrame,
                        segments: DataFrame) -> DataFrame:
    """Codes of the note area of each page (page_id, token, corners), after its regions are known.

    ``found``: regions as left, top, width, height (``as_regions``). The area lies above the bottom-right and right of the
    top-left number. Border lines do not count; what lies below a line across the page goes, unless the number column
    starts there; where there is a number column, the zone of the table at the top left is left out."""
    pages, items, components, table_boxes, segments = (by_page(df) for df in (pages, items, components, table_boxes, segments))
    area = regions.note_areas(found, pages)
    inner = by_page(area.select("page_id", F.col("red_y1").alias("red_top"), Box(F.col("fn_left"), F.col("fn_top"), F.col("fn_right"), F.col("fn_bottom")).pack().alias("area")))
    areas = inner.select("page_id", "area")
    sizes = area_sizes(areas)

    def parts(df: DataFrame, limit: DataFrame) -> DataFrame:
        """Components inside the area."""
        a = Box.struct(F.col("within"))
        centre = Box.sized(*[F.col(c) for c in "xywh"])
        return (df.join(limit.withColumnRenamed("area", "within"), "page_id").filter(a.has_point(centre.cx, centre.cy))
                .withColumns({"x": (F.col("x") - a.x1).cast("int"), "y": (F.col("y") - a.y1).cast("int")}).select(*df.columns))

    lines_in = by_page(cut_segments(segments.select("page_id", "axis", "pos", "start_px", "end_px"), areas), placed=True)
    border = regions.border_segments(lines_in, sizes).select(*lines_in.columns).distinct()
    # stored, as the zones look at these lines many times and each would repeat the search for the border
    lines_in = by_page(lines_in.join(border, lines_in.columns, "left_anti"))
    closing = tables.bottom_span(parts(components, areas), sizes).filter("y_cut > 0")
    a = Box.struct(F.col("area"))
    kept_to = F.when(F.col("y_cut").isNotNull() & ~F.coalesce(F.col("red_top") >= F.col("y_cut"), F.lit(False)), a.y1 + F.col("y_cut")).otherwise(a.y2)
    cut = by_page(inner.join(closing, "page_id", "left").select("page_id", "red_top", Box(a.x1, a.y1, a.x2, kept_to).pack().alias("area")), placed=True)
    areas = cut.select("page_id", "area")
    sizes = area_sizes(areas)
    zones = tables.table_zones(lines_in.join(sizes, "page_id").filter((F.col("axis") == "v") | (F.col("pos") < F.col("img_h"))).select(*lines_in.columns), sizes)
    zones = by_page(zones.join(cut.filter("red_top IS NOT NULL").select("page_id"), "page_id", "left_semi").select("page_id", "zone_right", "zone_bottom"), placed=True)
    boxes_in = cut_items(table_boxes.select("page_id", *CORNERS), areas)
    inside = parts(components, areas)
    padded = zones.select("page_id", (F.col("zone_right") + 3).alias("zone_right"), (F.col("zone_bottom") + 3).alias("zone_bottom"))
    centre = Box.sized(*[F.col(c) for c in "xywh"])
    erased = (centre.cx <= F.col("zone_right")) & (centre.cy <= F.col("zone_bottom"))
    inside = by_page(inside.join(padded, "page_id", "left").filter(~F.coalesce(erased, F.lit(False))).select(*components.columns), placed=True)
    codes = note_codes(cut_items(items, areas), inside, sizes, boxes_in, zones)
    return moved_back(codes, areas, "at").select("page_id", "token", *[F.col(f"at_{c}").alias(c) for c in CORNERS])


def vector_rewrites(files: DataFrame, spans: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """Rewrites in drawings that carry their text; everything else is left to recognition."""
    vector = files.filter("method = 'vector'").select(F.col("file_id").alias("page_id"), "file_name")
    return item_ops.span_codes(spans.join(vector, "page_id", "left_semi"), prefixes).join(vector, "page_id")


def batch_results(files: DataFrame, spans: DataFrame, replacements: DataFrame, pages: DataFrame) -> DataFrame:
    """Result row of each supported file: status, error, method, number of rewrites, where the output goes.

    ``files``: routed files; ``replacements``: rewrites of recognised pages; ``pages``: the pages that could be read. A file
    whose page could not is an error row, without method, total and output; it does not stop the others."""
    vector = vector_rewrites(files, spans).groupBy("page_id").agg(F.count("*").alias("n_vector"))
    read = replacements.groupBy("page_id").agg(F.count("*").alias("n_read"))
    known = pages.select("page_id", F.lit(True).alias("opened")).distinct()
    joined = (files.withColumn("page_id", F.col("file_id")).join(known, "page_id", "left")
              .join(vector, "page_id", "left").join(read, "page_id", "left"))
    ok = F.coalesce("opened", F.lit(False))
    total = F.coalesce(F.when(F.col("method") == "vector", F.col("n_vector")).otherwise(F.col("n_read")), F.lit(0))
    folder = F.concat(F.lit("output/"), F.col("subdir"))
    return joined.select("file_id", "file_name", F.when(ok, "success").otherwise("error").alias("status"), F.when(~ok, UNREADABLE).alias("error"),
                         F.when(ok, F.col("method")).alias("method"), F.when(ok, total.cast("bigint")).alias("total"),
                         F.when(ok, names.output_path(F.col("file_name"), folder, F.col("out_ext"))).alias("output_path"))


def as_regions(detected: DataFrame, files: DataFrame) -> DataFrame:
    """Detected regions (corners, one row per page) as the vote and the cells take them: left, top, width, height and text."""
    sides = []
    for r in ("red", "green", "orange"):
        x1, y1, x2, y2 = (F.col(f"{r}_{c}") for c in CORNERS)
        sides += [x1.alias(f"{r}_x"), y1.alias(f"{r}_y"), (x2 - x1).alias(f"{r}_w"), (y2 - y1).alias(f"{r}_h")]
    named = files.select(F.col("file_id").alias("page_id"), "file_name")
    return detected.join(named, "page_id").select("page_id", "file_name", *sides, "green_text", "orange_text")


def batch_run(files: DataFrame, spans: DataFrame, pages: DataFrame, items: DataFrame, segments: DataFrame, regions_found: DataFrame,
              codes: DataFrame, read_back: DataFrame) -> dict[str, DataFrame]:
    """A batch from routed files to its reports: results, replacements, verification, summary, box rows, report lines.

    Only readable pages that go through recognition are rewritten by region; suppressed regions take no part. ``codes``:
    note codes (page_id, seq, code, corners); ``read_back``: items recognised in the outputs."""
    open_pages = settled(pages.select("page_id").distinct())
    scanned = files.filter("method = 'ocr'").select(F.col("file_id").alias("page_id")).join(open_pages, "page_id", "left_semi")
    mine = regions_found.join(scanned, "page_id", "left_semi")
    rewrites = settled(votes.all_replacements(red_cells(items, segments), mine, codes.join(scanned, "page_id", "left_semi")))
    results = settled(batch_results(files, spans, rewrites, open_pages))
    expected = results.filter("status = 'success' AND method = 'ocr'").select(F.col("file_id").alias("page_id"), F.col("total").alias("expected"))
    boxes_out = rewrites.select(F.col("file_name").alias("source_file"), F.col("old_text").alias("token"), F.col("x1").alias("x"), F.col("y1").alias("y"),
                                (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    vector = vector_rewrites(files, spans).join(open_pages, "page_id", "left_semi")
    pairs = rewrites.select("page_id", "rank", "seq", "old_text", "new_text").unionByName(
        vector.select("page_id", F.lit(0).alias("rank"), F.col("seq").cast("bigint").alias("seq"), "old_text", "new_text"))
    in_order = F.row_number().over(Window.partitionBy("page_id").orderBy("rank", "seq", "old_text")).cast("bigint")
    listed = pairs.select(F.col("page_id").alias("job_id"), in_order.alias("seq"), "old_text", "new_text")
    return {"results": results, "replacements": rewrites, "summary": reports.batch_summary(results),
            "verification": votes.verified(read_back, suppressed(mine), expected), "boxes": box_csv.box_records(boxes_out),
            "report": reports.report_lines(results.withColumn("job_id", F.col("file_id")), listed)}


def write_batch(run: dict[str, DataFrame], folder: str) -> None:
    """Box file and text report of a batch."""
    box_csv.write_boxes(run["boxes"], folder)
    reports.write_report(run["report"], f"{folder}/report")


def watched_log(observations: DataFrame, events: DataFrame, job_of: Column) -> DataFrame:
    """From a watched folder to the log: stable files are queued, their jobs run, and what is over is logged."""
    queued = watch.promoted(watch.stable_runs(observations)).groupBy("source_file").agg(F.min("created_at").alias("created_at"))
    mine = queued.select(job_of.alias("job_id"), "source_file")
    state = jobs.current_jobs(events.join(mine.select("job_id"), "job_id", "left_semi"))
    files = mine.select("job_id", F.col("source_file").alias("file_name"), F.lit("ocr").alias("method"))
    return logs.log_rows(jobs.terminal_rows(state, files))


def single_result(file: DataFrame, replacements: DataFrame) -> DataFrame:
    """Result of one uploaded file (a routed one): its pairs of old and new text in order, their number and the method.

    For a single file only; the pairs of many files stay rows."""
    pair = F.struct("rank", "seq", "old_text", "new_text")
    one = replacements.groupBy("page_id").agg(F.array_sort(F.collect_list(pair)).alias("pairs"), F.count("*").alias("n"))
    found = file.select(F.col("file_id").alias("page_id"), "file_name", "method").join(one, "page_id", "left")
    pairs = F.coalesce("pairs", F.array().cast("array<struct<rank:int,seq:bigint,old_text:string,new_text:string>>"))
    return found.select("file_name", "method", F.coalesce("n", F.lit(0)).cast("bigint").alias("total"),
                        F.transform(pairs, lambda p: F.struct(p["old_text"].alias("old_text"), p["new_text"].alias("new_text"))).alias("replacements"))
