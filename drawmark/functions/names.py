"""Column functions over file names and paths."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawmark.functions.text import hit, number_pattern, strip
from drawmark.settings import OUTPUT_FOLDERS, REVISION_PATTERNS, SUPPORTED_EXTENSIONS, SUPPRESSED_REGIONS


def base_name(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*/", "")


def suffix(path: Column) -> Column:
    """The extension with its dot; leading dots do not start one."""
    return F.regexp_extract(path, r"(?:^|/)\.*[^./][^/]*?(\.[^./]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"^(\.*[^.].*)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    return F.lower(suffix(path))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*SUPPORTED_EXTENSIONS)


def file_number(path: Column, prefixes: Sequence[str] | None = None) -> Column:
    return hit(F.upper(stem(path)), number_pattern(prefixes))


def revision(path: Column) -> Column:
    name = stem(path)
    return F.coalesce(*[hit(name, p, 1) for p in REVISION_PATTERNS], F.lit("N/A"))


def parsed_name(path: Column, prefixes: Sequence[str] | None = None) -> dict[str, Column]:
    """Drawing number (the stem where none is found), revision and whether a number was found."""
    number = file_number(path, prefixes)
    return {
        "drawing_no": F.coalesce(number, stem(path)),
        "revision": revision(path),
        "matched": number.isNotNull(),
    }


def file_format(path: Column) -> Column:
    """Format label; null for an unsupported file."""
    ext = extension(path)
    return (F.when(ext == ".pdf", "pdf").when(ext.isin(".tif", ".tiff"), "tiff")
            .when(ext.isin(".jpg", ".jpeg", ".png"), F.substring(ext, 2, 10)))


def method_for(path: Column, has_vector: Column) -> Column:
    return F.when((extension(path) == ".pdf") & has_vector, "vector").otherwise("ocr")


def output_extension(path: Column, method: Column) -> Column:
    ext = extension(path)
    return (F.when(method == "vector", ".pdf").when(ext.isin(".tif", ".tiff", ".pdf"), ".tif").otherwise(ext))


def output_path(path: Column, out_dir: Column, ext: Column) -> Column:
    """Keep the stem; mark it where output and input folder are the same."""
    in_dir = F.regexp_replace(path, r"/[^/]*$", "")
    name = F.when(out_dir == in_dir, F.concat(stem(path), F.lit("_replaced"))).otherwise(stem(path))
    return F.concat(out_dir, F.lit("/"), name, ext)


def output_folder(method: Column) -> Column:
    return F.when(method == "vector", OUTPUT_FOLDERS["vector"]).otherwise(OUTPUT_FOLDERS["ocr"])


def ocr_flag(method: Column) -> Column:
    return F.when(method == "ocr", "O").otherwise("N")


def method_label(method: Column) -> Column:
    return F.when(method == "vector", "PDF Replacement").otherwise("VLMOCR")


def first_letter(path: Column) -> Column:
    return F.upper(F.substring(stem(path), 1, 1))


def suppresses(letter: Column, region: str) -> Column:
    """Whether a file's first letter keeps ``region`` out of the output."""
    showing = [known for known, hidden in SUPPRESSED_REGIONS.items() if region not in hidden]
    return ~letter.isin(*showing)


def replaced_stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(stem(name), "^H", ""), "-R$", "")


def original_name(name: Column) -> Column:
    ext = suffix(name)
    return F.concat(replaced_stem(name),
                    F.when(F.lower(ext).isin(".tif", ".tiff"), ext).otherwise(".tif"))


def is_replaced_name(name: Column) -> Column:
    return (F.lower(suffix(name)).isin(".tif", ".tiff")
            & stem(name).startswith("H") & stem(name).endswith("-R"))


def safe_tag(col: Column, max_len: int = 32) -> Column:
    cut = F.substring(F.regexp_replace(strip(F.coalesce(col, F.lit(""))), r"[^A-Za-z0-9._-]+", "_"), 1, max_len)
    return F.coalesce(F.nullif(F.regexp_replace(cut, r"^[_.]+|[_.]+$", ""), F.lit("")), F.lit("hit"))


def parent_folder(path: Column) -> Column:
    """Folder part of a / or \\ separated path; '' where there is none."""
    slashed = F.instr(path, "/") > 0

    def parent(sep: str, split_at: str) -> Column:
        parts = F.filter(F.split(path, split_at), lambda p: p != "")
        return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), sep)

    return F.when(slashed, parent("/", "/")).otherwise(parent("\\", r"\\"))
