"""Box algebra on columns. A box is two corners; widths and heights follow from them."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawmark.settings import MAX_EDGE, MAX_SCALED_EDGE


def whole(value: Column) -> Column:
    """Truncate toward zero."""
    return value.cast("int")


def half(value: Column) -> Column:
    """Floor of half of an integer."""
    return F.floor(value / 2).cast("int")


@dataclass(frozen=True)
class Box:
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def corners(cls, prefix: str = "") -> "Box":
        return cls(*[F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")])

    @classmethod
    def sized(cls, x: Column, y: Column, w: Column, h: Column) -> "Box":
        return cls(x, y, x + w, y + h)

    @classmethod
    def struct(cls, col: Column) -> "Box":
        return cls(col["x1"], col["y1"], col["x2"], col["y2"])

    @property
    def w(self) -> Column:
        return self.x2 - self.x1

    @property
    def h(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def cx(self) -> Column:
        return half(self.x1 + self.x2)

    @property
    def cy(self) -> Column:
        return half(self.y1 + self.y2)

    def pack(self) -> Column:
        return F.struct(self.x1.alias("x1"), self.y1.alias("y1"), self.x2.alias("x2"), self.y2.alias("y2"))

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.cast("int").alias(f"{prefix}{n}")
                for c, n in ((self.x1, "x1"), (self.y1, "y1"), (self.x2, "x2"), (self.y2, "y2"))]

    def has_point(self, px: Column, py: Column) -> Column:
        return (self.x1 <= px) & (px <= self.x2) & (self.y1 <= py) & (py <= self.y2)

    def has(self, other: "Box") -> Column:
        return ((self.x1 <= other.x1) & (self.y1 <= other.y1)
                & (self.x2 >= other.x2) & (self.y2 >= other.y2))

    def shared(self, other: "Box") -> Column:
        """Area of the intersection, 0 where the boxes are apart."""
        w = F.least(self.x2, other.x2) - F.greatest(self.x1, other.x1)
        h = F.least(self.y2, other.y2) - F.greatest(self.y1, other.y1)
        return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))

    def covered_by(self, other: "Box") -> Column:
        """Share of this box that lies in the other."""
        return self.shared(other) / F.greatest(self.area, F.lit(1))

    def iou(self, other: "Box") -> Column:
        inter = self.shared(other)
        union = self.area + other.area - inter
        return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))

    def clip(self, other: "Box") -> "Box":
        return Box(F.greatest(self.x1, other.x1), F.greatest(self.y1, other.y1),
                   F.least(self.x2, other.x2), F.least(self.y2, other.y2))

    def char_box(self, start: Column, length: Column, total: Column) -> "Box":
        """Part of the box taken by ``length`` characters from ``start`` when all are equally wide."""
        x1 = whole(self.x1 + start * (self.w / total))
        x2 = whole(self.x1 + (start + length) * (self.w / total))
        return Box(x1, self.y1, x2, self.y2)


def hull_of_points(poly: Column) -> Box:
    """Integer hull of an array of [x, y] points."""
    xs = F.transform(poly, lambda p: whole(p[0]))
    ys = F.transform(poly, lambda p: whole(p[1]))
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def percent_box(region: tuple[float, float, float, float], w: Column, h: Column) -> Box:
    x_min, x_max, y_min, y_max = region
    return Box.sized(whole(F.lit(x_min) * w), whole(F.lit(y_min) * h),
                     whole(F.lit(x_max - x_min) * w), whole(F.lit(y_max - y_min) * h))


def shrink_factor(w: Column, h: Column, limit: int = MAX_EDGE) -> Column:
    edge = F.greatest(w, h)
    return F.when(edge > limit, F.lit(limit) / edge).otherwise(F.lit(1.0))


def map_back(x: Column, y: Column, w: Column, h: Column, scale: Column, ox: Column, oy: Column) -> Box:
    return Box.sized(whole(x / scale) + ox, whole(y / scale) + oy, whole(w / scale), whole(h / scale))


def reading_scale(w: Column, h: Column, shrink: bool = True) -> Column:
    """Scale at which a region is read. ``shrink=False`` is the variant that never goes below 1."""
    low, high = F.least(w, h), F.greatest(w, h)
    scale = F.when(low < 80, F.lit(5.0)).when(low < 200, F.lit(3.0))
    if shrink:
        scale = scale.when(high > MAX_EDGE, F.lit(MAX_EDGE) / high)
    scale = scale.otherwise(F.lit(1.0))
    cap = F.lit(float(MAX_SCALED_EDGE)) / high
    if not shrink:
        cap = F.greatest(cap, F.lit(1.0))
    return F.when(high * scale > MAX_SCALED_EDGE, cap).otherwise(scale)


def reading_pad(w: Column, h: Column, scale: Column) -> Column:
    """White border put around a small region before it is read."""
    scaled = F.least(whole(w * scale), whole(h * scale))
    return F.when((h < 100) & (w < 400), F.greatest(whole(scaled * 0.35), F.lit(40))).otherwise(F.lit(0))


def merge_with_cell(item: Box, cell: Box, clip_right: bool) -> Box:
    """Cell where the item is the larger one (its right edge kept if inside), else the clipped item."""
    larger = item.area > cell.area
    right_in_cell = F.when(item.x2 < cell.x2, item.x2).otherwise(cell.x2)
    right_of_item = F.least(item.x2, cell.x2) if clip_right else item.x2
    return Box(
        F.when(larger, cell.x1).otherwise(F.greatest(item.x1, cell.x1)),
        F.when(larger, cell.y1).otherwise(F.greatest(item.y1, cell.y1)),
        F.when(larger, right_in_cell).otherwise(right_of_item),
        F.when(larger, cell.y2).otherwise(F.least(item.y2, cell.y2)),
    )
