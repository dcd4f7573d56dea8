"""Column functions on a recognised text together with its box."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawmark.functions.boxes import Box, whole
from drawmark.functions.text import hit, no_spaces, position, prefix_class
from drawmark.settings import LABEL_PREFIXES, LABEL_STARTS


def tight_box(box: Box, start: Column, length: Column, total: Column) -> Box:
    """Box around a number inside a longer text, with a small margin."""
    char_w = box.w / total
    x = box.x1 + whole(start * char_w)
    pad = F.greatest(whole(char_w * 0.3), F.lit(3))
    inner = (total > length) & (box.w > 0)
    width = F.least(whole(length * char_w) + pad * 2, box.x1 + box.w - x + pad)
    left = F.greatest(F.lit(0), x - pad)
    return Box(F.when(inner, left).otherwise(box.x1), box.y1,
               F.when(inner, left + width).otherwise(box.x2), box.y2)


def trim_at_line(text: Column, box: Box, line_x: Column) -> tuple[Column, Box]:
    """Text and box left of a vertical line."""
    char_w = box.w / F.length(text)
    keep = F.greatest(F.lit(1), F.least(whole((line_x - box.x1) / char_w), F.length(text)))
    width = F.greatest(line_x - box.x1 - 2, F.lit(1))
    return F.substring(text, F.lit(1), keep), Box(box.x1, box.y1, box.x1 + width, box.y2)


def widened(text: Column, box: Box, img_w: Column, img_h: Column) -> tuple[Column, Box]:
    """Room to the right of a cut-off number and the box to read again (right +2.5 chars, +-50% height)."""
    char_w = box.w / F.greatest(F.length(text), F.lit(1))
    right = F.least(whole(char_w * 2.5), img_w - box.x2)
    rise = whole(box.h * 0.5)
    top = F.greatest(F.lit(0), box.y1 - rise)
    return right, Box(box.x1, top, F.least(box.x2 + right, img_w), F.least(top + box.h + rise * 2, img_h))


def cropped_from(box: Box, start: Column, total: Column) -> Box:
    """Right part of the box from the given character on."""
    left = box.x1 + box.w * (start / F.greatest(total, F.lit(1)))
    x = whole(left)
    return Box(x, box.y1, x + F.greatest(whole(box.x2 - left), F.lit(1)),
               box.y1 + F.greatest(box.h, F.lit(1)))


def has_label(upper: Column) -> Column:
    """Upper-cased text that a drawing label leads."""
    led = upper.startswith(LABEL_STARTS[0])
    for start in LABEL_STARTS[1:]:
        led = led | upper.startswith(start)
    return led


def label_length(text: Column) -> Column:
    """Characters taken by a drawing label and the blanks and dots after it; 0 without a label."""
    labels = "|".join(label.replace(".", "[.]") for label in LABEL_PREFIXES)
    return F.length(F.regexp_extract(F.upper(text), f"^(?:{labels})[ .]*", 0))


def estimated_number_box(text: Column, box: Box) -> Box:
    """Where a nine-character number right of a bare label would lie."""
    char_w = F.greatest(box.w, F.lit(1)) / F.greatest(F.length(no_spaces(text)), F.lit(1))
    x = whole(box.x2 + whole(char_w * 0.5))
    return Box(x, box.y1, x + whole(char_w * 9), box.y1 + F.greatest(box.h, F.lit(1)))


def note_code(text: Column, box: Box, prefixes: Sequence[str] | None = None) -> tuple[Column, Column, Box]:
    """Loose code in a note block, its confidence and its box."""
    loose = prefix_class(prefixes) + r"[A-Z][0-9][A-Z0-9]{3,}"
    strict = "^" + prefix_class(prefixes) + r"[A-Z][0-9]{2,3}[A-Z][0-9]{2,4}"
    upper = no_spaces(F.upper(text))
    code = hit(upper, loose)
    confidence = F.when(code.isNull(), F.lit(None).cast("double")).when(code.rlike(strict), 1.0).otherwise(0.7)
    wide = Box(box.x1, box.y1, box.x1 + F.greatest(box.w, F.lit(1)), box.y2)
    return code, confidence, wide.char_box(position(upper, loose), F.length(code),
                                           F.greatest(F.length(upper), F.lit(1)))


def first_char_box(text: Column, box: Box) -> Box:
    """Box of the first character; null for an empty text."""
    width = F.when(F.length(text) > 0, whole(box.w / F.length(text)))
    return Box(box.x1, box.y1, box.x1 + width, box.y2)
