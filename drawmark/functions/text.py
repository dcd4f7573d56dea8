"""Column functions over recognised text: extraction, repair and tests of part numbers."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawmark.settings import (
    MARKUP,
    CONFUSABLE_DIGITS, DEFAULT_PREFIXES, LETTER_DIGITS, NEW_PREFIX, SYMBOL_DIGITS,
)

# white space, separators of any kind, and the control characters that count as blanks
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def prefix_class(prefixes: Sequence[str] | None = None) -> str:
    letters = "".join(p.upper() for p in (prefixes or DEFAULT_PREFIXES))
    return letters if len(letters) == 1 else f"[{letters}]"


def number_pattern(prefixes: Sequence[str] | None = None) -> str:
    """Prefix, then six or more capitals/digits of which one is a digit; no word boundary."""
    return prefix_class(prefixes) + r"(?=[A-Z0-9]*\p{Nd})[A-Z0-9]{6,}"


def hit(col: Column, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern`` or null (``regexp_extract`` gives '' for no match)."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def found(col: Column) -> Column:
    """``col`` where it is not null, as a column of its own: rows without it go. A filter would move below the steps that lead
    to ``col`` and repeat them."""
    return F.explode(F.filter(F.array(col), lambda x: x.isNotNull()))


def bind(col: Column, use) -> Column:
    """``use`` applied to ``col``, which is evaluated once however often ``use`` mentions it."""
    return F.get(F.transform(F.array(col), use), F.lit(0))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(_BLANKS))


def no_spaces(col: Column) -> Column:
    return F.replace(col, F.lit(" "), F.lit(""))


def swap(col: Column, mapping: dict[str, str]) -> Column:
    return F.translate(col, "".join(mapping), "".join(mapping.values()))


def first_number(col: Column, prefixes: Sequence[str] | None = None) -> Column:
    return hit(col, number_pattern(prefixes))


def find_token(col: Column) -> Column:
    """First number in the upper-cased text; a V-led one is read as Y-led."""
    upper = F.upper(col)
    v_led = hit(upper, number_pattern(["V"]))
    return F.coalesce(first_number(upper), F.concat(F.lit("Y"), F.substring(v_led, 2, 1 << 30)))


def backfill_symbols(col: Column, prefixes: Sequence[str] | None = None) -> Column:
    """Symbols that look like digits become digits; null unless the result starts with a number."""
    start = "^" + number_pattern(prefixes)

    def check(fixed: Column) -> Column:
        usable = fixed.rlike("^[A-Z0-9]{5,}$")
        y_led = F.concat(F.lit("Y"), F.substring(fixed, 2, 1 << 30))
        return (F.when(usable & fixed.rlike(start), fixed)
                .when(usable & fixed.startswith("T") & y_led.rlike(start), y_led))

    return bind(swap(no_spaces(col), SYMBOL_DIGITS), check)


def repair_digits(col: Column) -> Column:
    """Letters at digit positions (2-4 and from 6 on) become digits."""
    fixed = F.concat(
        F.substring(col, 1, 2), swap(F.substring(col, 3, 3), LETTER_DIGITS),
        F.substring(col, 6, 1), swap(F.substring(col, 7, 1 << 30), LETTER_DIGITS),
    )
    return F.when((F.length(col) >= 6) & col.rlike(r"^\p{L}"), fixed).otherwise(col)


def accepted(col: Column) -> Column:
    """Nine or more characters and the last one a letter or digit."""
    text = strip(col)
    return (F.length(text) >= 9) & text.rlike(r"[\p{L}\p{N}]$")


def compare_form(col: Column) -> Column:
    return swap(no_spaces(F.upper(col)), CONFUSABLE_DIGITS)


def v_alternative(token: Column) -> Column:
    """The V-led spelling of a Y-led token, else null."""
    return F.when(token.startswith("Y"), F.concat(F.lit("V"), F.substring(token, 2, 1 << 30)))


def reads_as(text: Column, token: Column) -> Column:
    """Text equals the token, or its V-led spelling, once confusable characters are folded."""
    norm, upper = compare_form(text), F.upper(token)
    alt = v_alternative(upper)
    return (norm == compare_form(upper)) | (alt.isNotNull() & (norm == compare_form(alt)))


def reads_within(text: Column, token: Column) -> Column:
    norm, upper = compare_form(text), F.upper(token)
    alt = v_alternative(upper)
    return (norm != "") & (norm.contains(compare_form(upper))
                           | (alt.isNotNull() & norm.contains(compare_form(alt))))


def token_candidates(token: Column) -> Column:
    """The token and, where it still is a whole number, the token without its last character."""
    upper = F.upper(token)
    short = F.substring(upper, F.lit(1), F.length(upper) - 1)
    ok = (F.length(short) >= 7) & short.rlike("^" + number_pattern() + "$")
    return F.when(ok, F.array(upper, short)).otherwise(F.array(upper))


def clean_markup(col: Column) -> Column:
    """Drop math markup; text without a backslash is returned as it is."""
    out = col
    for pattern, kept in MARKUP:
        out = F.regexp_replace(out, pattern, kept)
    out = strip(out)
    return F.when(F.instr(col, "\\") > 0, out).otherwise(col)


def printable_share(col: Column) -> Column:
    kept = F.regexp_replace(col, r"[^\x20-\x7E\n\r\t]", "")
    return F.length(kept) / F.nullif(F.length(col), F.lit(0))


def has_vector_text(col: Column, min_chars: int = 50, ratio: float | None = 0.3) -> Column:
    """Enough text that is mostly printable. ``ratio=None`` is the plain test of more than min_chars."""
    text = strip(col)
    if ratio is None:
        return F.length(text) > min_chars
    return (F.length(text) >= min_chars) & (printable_share(text) >= ratio)


def prefixed_cell(col: Column, prefixes: Sequence[str] | None = None) -> Column:
    """Cell text led by a wanted prefix (T is read as Y), else null."""
    return led_cell(strip(no_spaces(col)), prefixes)


def led_cell(text: Column, prefixes: Sequence[str] | None = None) -> Column:
    """``prefixed_cell`` of a text without blanks."""
    allowed = [p.upper() for p in (prefixes or DEFAULT_PREFIXES)]
    first = F.upper(F.substring(text, 1, 1))
    out = F.when(first.isin(allowed), text)
    if "Y" in allowed:
        out = out.when((first == "T") & (F.length(text) >= 5),
                       F.concat(F.lit("Y"), F.substring(text, 2, 1 << 30)))
    return out


def ballot(col: Column, prefixes: Sequence[str] | None = None) -> Column:
    """Text that may take part in the vote, else null."""
    text = no_spaces(F.upper(col))
    return F.when(text.rlike(f"^{prefix_class(prefixes)}[A-Z0-9]{{4,}}$"), text)


def rewritten(col: Column) -> Column:
    return F.concat(F.lit(NEW_PREFIX), col)


def is_output_token(col: Column) -> Column:
    return col.rlike(r"H[A-Z][A-Z0-9][A-Z0-9\-]{2,}")


def position(col: Column, pattern: str) -> Column:
    """0-based start of the first match, null for no match."""
    at = F.regexp_instr(col, F.lit(pattern))
    return F.when(at > 0, at - 1)
