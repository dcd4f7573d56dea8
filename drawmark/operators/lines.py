"""Operators on detected lines.

A page's lines become one row: sorted arrays of the distinct pixel positions at which it has a line. A
position is a pixel of the page, so the arrays are bounded by the page's side length however many
segments a page has, and the sets are reduced before the shuffle. Everything that follows is done
inside the row, and items meet their page's lines in an equi join with one row per page.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawmark.functions.boxes import Box, whole
from drawmark.functions.text import bind, found

LINE_ORDER = ("pos", "axis")  # of stored segments: lines and ink by position follow it
_NO_INTS = "CAST(array() AS array<int>)"


def ints() -> Column:
    return F.expr(_NO_INTS)


def spans() -> Column:
    return F.expr("CAST(array() AS array<struct<pos:int,lo:int,hi:int,len:int>>)")


def last(arr: Column) -> Column:
    return F.get(arr, F.size(arr) - 1)


def page_lines(segments: DataFrame, h_when: Column | None = None, v_when: Column | None = None) -> DataFrame:
    """One row per page: ``hs`` and ``vs``, the sorted distinct positions of its lines."""
    is_h, is_v = F.col("axis") == "h", F.col("axis") == "v"
    if h_when is not None:
        is_h = is_h & h_when
    if v_when is not None:
        is_v = is_v & v_when
    return segments.groupBy("page_id").agg(
        F.array_sort(F.collect_set(F.when(is_h, F.col("pos")))).alias("hs"),
        F.array_sort(F.collect_set(F.when(is_v, F.col("pos")))).alias("vs"))


def page_spans(segments: DataFrame) -> DataFrame:
    """One row per page: lines with the hull of their extents at each position, sorted by position."""
    at = (segments.groupBy("page_id", "pos", "axis")  # in the order of ``LINE_ORDER``
          .agg(F.min("start_px").alias("lo"), F.max("end_px").alias("hi"),
               F.max(F.col("end_px") - F.col("start_px")).alias("len")))
    line = F.struct("pos", "lo", "hi", "len")
    return at.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("axis") == "h", line))).alias("h_spans"),
        F.array_sort(F.collect_list(F.when(F.col("axis") == "v", line))).alias("v_spans"))


# ---- folds over one page's positions -------------------------------------------------------------

def keep_spaced(arr: Column, gap: Column | int | float, inclusive: bool = False) -> Column:
    """Keep a value if it is more than ``gap`` (or at least ``gap``) after the last one kept."""
    gap = gap if isinstance(gap, Column) else F.lit(gap)

    def step(kept: Column, x: Column) -> Column:
        far = (x - last(kept) >= gap) if inclusive else (x - last(kept) > gap)
        return F.when(F.coalesce(far, F.lit(True)), F.array_append(kept, x)).otherwise(kept)

    return F.aggregate(arr, ints(), step)


def merge_spans(spans: Column, gap: int) -> Column:
    """Merge lines within ``gap`` of a cluster's first line; the extents are united."""
    empty = F.expr("CAST(array() AS array<struct<pos:int,lo:int,hi:int,len:int>>)")

    def step(acc: Column, s: Column) -> Column:
        top = last(acc)
        lo, hi = F.least(top["lo"], s["lo"]), F.greatest(top["hi"], s["hi"])
        merged = F.struct(top["pos"].alias("pos"), lo.alias("lo"), hi.alias("hi"),
                          F.greatest(top["len"], s["len"]).alias("len"))
        joined = F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), merged)
        return F.when((F.size(acc) > 0) & (s["pos"] - top["pos"] <= gap), joined).otherwise(F.array_append(acc, s))

    return F.when(F.size(spans) < 2, spans).otherwise(F.aggregate(spans, empty, step))


def positions(spans: Column) -> Column:
    return F.transform(spans, lambda s: s["pos"])


def tall_extent(merged: Column) -> tuple[Column, Column]:
    """Extent of the merged lines that are longer than half of the longest."""
    def length(s: Column) -> Column:
        return s["hi"] - s["lo"]
    longest = F.array_max(F.transform(merged, length))
    tall = F.filter(merged, lambda s: length(s) > longest * 0.5)
    return F.array_min(F.transform(tall, lambda s: s["lo"])), F.array_max(F.transform(tall, lambda s: s["hi"]))


def cluster_means(arr: Column, gap: int = 10) -> Column:
    """Chains of values less than ``gap`` apart, each as its truncated mean."""
    empty = F.expr("CAST(array() AS array<struct<total:bigint,n:int,top:int>>)")

    def step(acc: Column, x: Column) -> Column:
        cur = last(acc)
        grown = F.struct((cur["total"] + x).alias("total"), (cur["n"] + 1).alias("n"), x.alias("top"))
        fresh = F.struct(x.cast("bigint").alias("total"), F.lit(1).alias("n"), x.alias("top"))
        chained = (F.size(acc) > 0) & (x - cur["top"] < gap)
        return (F.when(chained, F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), grown))
                .otherwise(F.array_append(acc, fresh)))

    return F.transform(F.aggregate(arr, empty, step), lambda c: (c["total"] / c["n"]).cast("int"))


def gaps(arr: Column) -> Column:
    """Differences of neighbours."""
    return bind(arr, lambda a: F.zip_with(
        F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))),
        F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), lambda hi, lo: hi - lo))


def common_gap(arr: Column, above: int = 50, to: int = 5) -> Column:
    """Most frequent gap over ``above``, rounded to ``to``; the first seen wins a tie. Null for none."""
    def pick(rounded: Column) -> Column:
        ranked = F.transform(F.array_distinct(rounded), lambda v, i: F.struct(
            F.size(F.filter(rounded, lambda r: r == v)).alias("n"), (-i).alias("i"), v.alias("v")))
        return F.array_max(ranked)["v"]

    return bind(F.transform(F.filter(gaps(arr), lambda g: g > above), lambda g: (F.bround(g / to) * to).cast("int")), pick)


def voted_gap(arr: Column) -> Column:
    """Truncated mean of the largest group (within 10 of its first member) of the first five gaps of 30 or more."""
    sample = F.filter(F.slice(gaps(arr), F.lit(1), F.lit(5)), lambda g: g >= 30)
    empty = F.expr("CAST(array() AS array<array<int>>)")

    def step(groups: Column, g: Column) -> Column:
        near = F.filter(F.transform(groups, lambda m, i: F.when(F.abs(F.get(m, F.lit(0)) - g) <= 10, i)), lambda i: i.isNotNull())
        at = F.get(near, F.lit(0))
        placed = F.transform(groups, lambda m, i: F.when(i == at, F.array_append(m, g)).otherwise(m))
        return F.when(F.size(near) > 0, placed).otherwise(F.array_append(groups, F.array(g)))

    def best(groups: Column) -> Column:
        ranked = F.transform(groups, lambda m, i: F.struct(F.size(m).alias("n"), (-i).alias("i"), m.alias("m")))
        members = F.array_max(ranked)["m"]
        return bind(members, lambda m: (F.aggregate(m, F.lit(0), lambda a, x: a + x) / F.size(m)).cast("int"))

    return F.when(F.size(sample) > 0, bind(F.aggregate(sample, empty, step), best))


def without_false_rows(arr: Column) -> Column:
    """Drop rows closer than 0.7 cell heights to the last one kept; short lists are left alone."""
    def fold(a: Column) -> Column:
        height = voted_gap(a)
        return F.when((F.size(a) < 4) | height.isNull() | (height < 10), a).otherwise(
            bind(height * 0.7, lambda g: keep_spaced(a, g, inclusive=True)))
    return bind(arr, fold)


def uniform_grid(arr: Column) -> Column:
    """Regular grid with the mean of the largest gap cluster (gaps of 8 or more, chained within 3)."""
    empty = F.expr("CAST(array() AS array<array<int>>)")

    def chain(groups: Column, g: Column) -> Column:
        cur = last(groups)
        return F.when((F.size(groups) > 0) & (g - last(cur) <= 3),
                      F.array_append(F.slice(groups, F.lit(1), F.greatest(F.size(groups) - 1, F.lit(0))), F.array_append(cur, g))
                      ).otherwise(F.array_append(groups, F.array(g)))

    def mean_of_largest(groups: Column) -> Column:
        ranked = F.transform(groups, lambda m, i: F.struct(F.size(m).alias("n"), (-i).alias("i"), m.alias("m")))
        return bind(F.array_max(ranked)["m"], lambda m: (F.aggregate(m, F.lit(0), lambda a, x: a + x) / F.size(m)).cast("int"))

    def grid(a: Column) -> Column:
        valid = F.array_sort(F.filter(gaps(a), lambda g: g >= 8))
        height = bind(F.aggregate(valid, empty, chain), mean_of_largest)
        return bind(height, lambda h: F.when((F.size(a) < 3) | h.isNull() | (h < 5), a).otherwise(
            F.sequence(F.array_min(a), F.array_max(a) + h, h)))
    return bind(arr, grid)


def grid_rows(arr: Column, height: Column, tolerance: int = 3) -> Column:
    """Row lines: from the first line, the line nearest to one cell height further, until none is in reach."""
    def step(rows: Column, _: Column) -> Column:
        goal = last(rows) + height
        near = F.array_min(F.transform(
            F.filter(arr, lambda y: (y > last(rows)) & (F.abs(y - goal) <= tolerance)),
            lambda y: F.struct(F.abs(y - goal).alias("d"), y.alias("y"))))["y"]
        return F.when(near.isNotNull(), F.array_append(rows, near)).otherwise(rows)

    return F.when(F.size(arr) > 0, F.aggregate(arr, F.slice(arr, F.lit(1), F.lit(1)), step)).otherwise(ints())


def row_grid(pages: DataFrame) -> DataFrame:
    """Cell height h, rows and strikes (the other lines) of pages that have a common gap. ``pages``: page_id, ps."""
    high = pages.select("page_id", "ps", found(common_gap(F.col("ps"))).alias("h"))
    grid = high.withColumn("rows", grid_rows(F.col("ps"), F.col("h")))
    return grid.select("page_id", "h", "rows", F.array_except("ps", "rows").alias("strikes"))


def filled_rows(arr: Column, height: Column, bottom: Column) -> Column:
    """Rows put into gaps of more than 1.8 cell heights (the last gap ends at ``bottom``)."""
    def fill(y: Column, i: Column) -> Column:
        gap = F.coalesce(F.get(arr, i + 1), bottom) - y
        n = (F.bround(gap / height) - 1).cast("int")
        extra = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (y + gap / (n + 1) * k).cast("int"))
        return F.when((gap > height * 1.8) & (n > 0), F.concat(F.array(y), extra)).otherwise(F.array(y))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(arr, fill))))


def linked_extent(segs: Column, centre: Column, gap: int = 80) -> Column:
    """Extent around ``centre`` grown over segments no further than ``gap`` away. ``segs``: sorted (lo, hi)."""
    around = F.get(F.filter(segs, lambda s: (s["lo"] <= centre + 10) & (s["hi"] >= centre - 10)), F.lit(0))

    def step(acc: Column, s: Column) -> Column:
        below = (s["lo"] > acc["hi"]) & (s["lo"] - acc["hi"] <= gap)
        hi = F.when(below, s["hi"]).otherwise(acc["hi"])
        above = (s["hi"] < acc["lo"]) & (acc["lo"] - s["hi"] <= gap)
        return F.struct(F.when(above, s["lo"]).otherwise(acc["lo"]).alias("lo"), hi.alias("hi"))

    def sweep(acc: Column) -> Column:
        begin = F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi"))
        return F.aggregate(segs, begin, step, lambda x: F.struct(
            x["lo"].alias("lo"), x["hi"].alias("hi"), ((x["lo"] == acc["lo"]) & (x["hi"] == acc["hi"])).alias("done")))

    # a sweep that changes nothing is the last; every other one takes in a segment
    def grown(seed: Column) -> Column:
        begin = F.struct(seed["lo"].alias("lo"), seed["hi"].alias("hi"), F.lit(False).alias("done"))
        return F.aggregate(segs, begin, lambda acc, _: F.when(acc["done"], acc).otherwise(sweep(acc)),
                           lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))

    return bind(around, lambda seed: F.when(seed.isNotNull(), grown(seed)))


def extended_rows(rows: Column, candidates: Column, table_bottom: Column, page_bottom: Column) -> Column:
    """Rows below the table found in bands of three row heights, until a band is empty (nine rows at most)."""
    def extend(rs: Column) -> Column:
        mean_gap = (last(rs) - F.get(rs, F.lit(0))) / (F.size(rs) - 1)
        return bind(F.greatest(whole(mean_gap * 3), F.lit(100)), lambda reach: walk(rs, reach))

    def walk(rs: Column, reach: Column) -> Column:
        limit = F.least(page_bottom, table_bottom + reach * 3)
        start = F.struct(ints().alias("found"), table_bottom.alias("top"),
                         F.least(page_bottom, table_bottom + reach).alias("bot"),
                         (table_bottom < limit).alias("open"), F.lit(False).alias("hit"))

        def step(acc: Column, y: Column) -> Column:
            in_band = acc["open"] & (y < acc["bot"])
            top = last(acc["found"]) + 1
            bot = F.least(page_bottom, top + reach)
            in_next = acc["open"] & acc["hit"] & (top < limit) & (y < bot)
            take = in_band | in_next
            return F.struct(
                F.when(take, F.array_append(acc["found"], y)).otherwise(acc["found"]).alias("found"),
                F.when(in_band, acc["top"]).when(in_next, top).otherwise(acc["top"]).alias("top"),
                F.when(in_band, acc["bot"]).when(in_next, bot).otherwise(acc["bot"]).alias("bot"),
                take.alias("open"), take.alias("hit"))

        below = F.filter(candidates, lambda y: y >= table_bottom)
        return F.concat(rs, F.aggregate(below, start, step, lambda acc: acc["found"]))

    return F.when(F.size(rows) >= 2, bind(rows, extend)).otherwise(rows)


def data_rows(rows: Column, centre: Column, top: Column, bottom: Column) -> tuple[Column, Column]:
    """Top and bottom of the data rows; the table's own edges where there are no rows."""
    first_below = F.get(F.filter(rows, lambda y: y >= centre - 5), F.lit(0))
    return F.coalesce(first_below, F.get(rows, F.lit(0)), top), F.coalesce(last(rows), bottom)


def chosen_rows(wide: Column, narrow: Column) -> Column:
    """Rows of the narrow search, of both together or of the wide one, depending on how many each found."""
    both = bind(F.array_sort(F.array_distinct(F.concat(wide, narrow))), lambda a: keep_spaced(a, 8))
    n_wide, n_narrow = F.size(wide), F.size(narrow)
    use_narrow = (n_narrow > n_wide * 1.5) & (n_narrow >= 6)

    def choose(merged: Column) -> Column:
        return (F.when(use_narrow, narrow)
                .when((n_wide > 0) & (n_narrow > 0) & (F.size(merged) > n_wide * 1.2), merged)
                .when(n_wide > 0, wide).otherwise(narrow))
    return without_false_rows(bind(both, choose))


def long_lines(lengths: Column, keep_all_without_cut: bool) -> Column:
    """Positions of the long lines. ``lengths``: (pos, len) pairs. The cut is the first gap between sorted
    distinct lengths that is over three times the upper median gap (30 px at least)."""
    def cut(sizes: Column) -> Column:
        steps = gaps(sizes)
        return bind(steps, lambda gs: bind(
            F.get(F.array_sort(gs), F.floor(F.size(gs) / 2).cast("int")), lambda mid: F.get(F.filter(
                F.transform(gs, lambda g, i: F.when(g > F.greatest(mid * 3, F.lit(30)), F.get(sizes, i))),
                lambda v: v.isNotNull()), F.lit(0))))

    sizes = F.array_sort(F.array_distinct(F.transform(lengths, lambda s: s["len"])))
    everything = F.transform(lengths, lambda s: s["pos"])

    def split(sz: Column) -> Column:
        return bind(cut(sz), lambda c: F.when(F.size(sz) < 2, everything)
                    .when(c.isNotNull(), F.transform(F.filter(lengths, lambda s: s["len"] > c), lambda s: s["pos"]))
                    .otherwise(everything if keep_all_without_cut else ints()))
    return F.array_sort(bind(sizes, split))


def nth_crop(v_long: Column, h_long: Column, v_rank: int, h_rank: int, w: Column, h: Column) -> Column:
    """Crop right of the n-th long vertical line from the right and below the n-th long horizontal line
    from the bottom; a missing line leaves that side alone; null if less than 20 px remain."""
    x = F.coalesce(F.get(v_long, F.size(v_long) - v_rank), F.lit(0))
    y = F.coalesce(F.get(h_long, F.size(h_long) - h_rank), F.lit(0))
    box = F.struct(x.alias("x1"), y.alias("y1"), w.alias("x2"), h.alias("y2"))
    return F.when((w - x >= 20) & (h - y >= 20), box)


def fallback_cell(hs: Column, vs: Column, w: Column, h: Column) -> Box:
    """Cell of the line grid with the best score of depth and width; the bottom 30% where there is none.

    The score is a sum of a row part and a column part, so the best row and the best column are picked
    separately instead of pairing all rows with all columns."""
    rows = F.transform(F.slice(hs, F.lit(2), F.greatest(F.size(hs) - 1, F.lit(0))),
                       lambda b, i: F.struct(b.alias("bot"), F.get(hs, i).alias("top")))
    row = F.array_max(F.filter(rows, lambda r: (r["bot"] > h * 0.4) & (r["bot"] - r["top"] > 8)
                               & (r["bot"] - r["top"] < h * 0.5)))
    cols = F.transform(F.slice(vs, F.lit(2), F.greatest(F.size(vs) - 1, F.lit(0))),
                       lambda r, i: F.struct((r - F.get(vs, i)).alias("w"), F.get(vs, i).alias("left")))
    col = F.array_max(F.filter(cols, lambda c: (c["w"] > w * 0.15) & (c["w"] >= 10)))
    ok = row.isNotNull() & col.isNotNull()
    margin = 4
    x1, y1 = col["left"] + margin, row["top"] + margin
    low = whole(h * 0.7)
    return Box(F.when(ok, x1).otherwise(F.lit(0)), F.when(ok, y1).otherwise(low),
               F.when(ok, x1 + F.greatest(col["w"] - 2 * margin, F.lit(1))).otherwise(w),
               F.when(ok, y1 + F.greatest(row["bot"] - row["top"] - 2 * margin, F.lit(1))).otherwise(h))


def ladder_rows(spans: Column, width: Column, band_top: Column, band_bottom: Column, wanted: int = 6) -> Column:
    """Rows at the strictest of three width shares that puts ``wanted`` rows in the band, else the last."""
    def level(share: float) -> Column:
        return keep_spaced(positions(F.filter(spans, lambda s: s["len"] >= whole(width * share))), 8)

    levels = [level(share) for share in (0.30, 0.20, 0.15)]

    def enough(rows: Column) -> Column:
        return F.size(F.filter(rows, lambda y: (band_top <= y) & (y <= band_bottom))) >= wanted

    return bind(levels[0], lambda a: F.when(enough(a), a).otherwise(
        bind(levels[1], lambda b: F.when(enough(b), b).otherwise(levels[2]))))


def frame_boxes(segments: DataFrame, pages: DataFrame) -> DataFrame:
    """Frame of each page: outermost lines of half the page's side, tried level by level; then of 40%
    where the frame is plausible; else the page less 5%."""
    joined = pages.join(segments, "page_id", "left")
    w, h, length = F.col("img_w"), F.col("img_h"), F.col("end_px") - F.col("start_px")
    aggs = []
    for share in (50, 40):
        for level in (0, 1, 2):
            for axis, side in (("h", w), ("v", h)):
                fits = (F.col("axis") == axis) & (F.col("level") == level) & (
                    length >= F.greatest(whole(side * (share / 100)), F.lit(100)))
                pos = F.when(fits, F.col("pos"))
                aggs += [F.min(pos).alias(f"{axis}_lo_{share}_{level}"), F.max(pos).alias(f"{axis}_hi_{share}_{level}")]
    found = joined.groupBy("page_id", "img_w", "img_h").agg(*aggs)
    picks = []
    for share in (50, 40):
        for level in (0, 1, 2):
            x1, x2, y1, y2 = (F.col(f"{c}_{share}_{level}") for c in ("v_lo", "v_hi", "h_lo", "h_hi"))
            ok = (x1 < x2) & (y1 < y2)
            if share == 40:
                ok = ok & (x1 < w * 0.15) & (y1 < h * 0.15) & (x2 - x1 > w * 0.7) & (y2 - y1 > h * 0.7)
            picks.append(F.when(ok, Box(x1, y1, x2, y2).pack()))
    mx, my = whole(w * 0.05), whole(h * 0.05)
    picks.append(Box(mx, my, w - mx, h - my).pack())
    return found.withColumn("frame", F.coalesce(*picks)).select("page_id", "img_w", "img_h", "frame.*")


def _weighted(members: Column, rank: Column) -> Column:
    """First field at a 0-based rank of sorted (value, n) pairs, each value counting n times."""
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("v"))
    return F.aggregate(members, start, lambda a, m: F.struct(
        (a["seen"] + m["n"]).alias("seen"), F.when(a["v"].isNull() & (a["seen"] + m["n"] > rank), m["v"]).otherwise(a["v"]).alias("v")), lambda a: a["v"])


def aligned_sets(segments: DataFrame, axis: str, tol: int) -> DataFrame:
    """Largest aligned set of a page: segments whose both ends lie within ``tol`` of an anchor's, for the
    anchor with the greatest upper-median length (two members at least, the first anchor wins a tie).

    Equal extents are one row with the number of their lines. An anchor meets the extents of its cells of a grid over
    (start, end), so the rows joined grow with the extents nearby, which (2 tol + 1)^2 bounds, and not with the square
    of a page's extents. Only the winner's members are looked up again."""
    cell = 4 * max(tol, 1)
    lines = segments.filter(F.col("axis") == axis).groupBy("page_id", "start_px", "end_px", "pos").agg(F.lit(1).alias("one"))
    extents = lines.groupBy("page_id", F.col("start_px").alias("lo"), F.col("end_px").alias("hi")).agg(
        F.count("one").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("deepest"))

    def at(value: Column) -> Column:
        return F.floor(value / cell)

    members = extents.select("page_id", F.col("lo").alias("m_lo"), F.col("hi").alias("m_hi"), "n", at(F.col("lo")).alias("cx"), at(F.col("hi")).alias("cy"))
    anchors = (extents.select("page_id", "lo", "hi", "first")
               .withColumn("cx", F.explode(F.sequence(at(F.col("lo") - tol), at(F.col("lo") + tol))))
               .withColumn("cy", F.explode(F.sequence(at(F.col("hi") - tol), at(F.col("hi") + tol)))))
    near = (F.abs(F.col("m_lo") - F.col("lo")) <= tol) & (F.abs(F.col("m_hi") - F.col("hi")) <= tol)
    by_length = (anchors.join(members, ["page_id", "cx", "cy"]).filter(near)
                 .groupBy("page_id", "lo", "hi", "first", (F.col("m_hi") - F.col("m_lo")).alias("v")).agg(F.sum("n").alias("n")))
    scored = (by_length.groupBy("page_id", "lo", "hi", "first").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("v", "n"))).alias("lens"))
              .filter("n >= 2").withColumn("med_len", _weighted(F.col("lens"), F.floor(F.col("n") / 2))))
    best = scored.groupBy("page_id").agg(F.max(F.struct(
        "med_len", (-F.col("first")).alias("f"), (-F.col("lo")).alias("l"), (-F.col("hi")).alias("h"), "n")).alias("b"))
    best = best.select("page_id", F.col("b.med_len").alias("med_len"), F.col("b.n").cast("int").alias("n"), (-F.col("b.f")).alias("anchor_pos"),
                       (-F.col("b.l")).alias("anchor_lo"), (-F.col("b.h")).alias("anchor_hi"))
    inside = (F.abs(F.col("lo") - F.col("anchor_lo")) <= tol) & (F.abs(F.col("hi") - F.col("anchor_hi")) <= tol)
    ends = (extents.select("page_id", "lo", "hi", F.col("n").alias("m"), "deepest").join(best, "page_id").filter(inside)
            .groupBy("page_id", F.col("hi").alias("v")).agg(F.sum("m").alias("n"), F.max("deepest").alias("deepest")))
    ends = ends.groupBy("page_id").agg(F.max("deepest").alias("deepest"), F.array_sort(F.collect_list(F.struct("v", "n"))).alias("his"))
    out = best.join(ends, "page_id")
    mid_hi = whole((_weighted(F.col("his"), F.floor((F.col("n") - 1) / 2)) + _weighted(F.col("his"), F.floor(F.col("n") / 2))) / 2)
    return out.select("page_id", "med_len", "n", "anchor_pos", "anchor_lo", "anchor_hi", "deepest", mid_hi.alias("median_hi"))
