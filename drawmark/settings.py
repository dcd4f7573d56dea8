"""Dictionaries, thresholds and names that results depend on."""

# Number prefixes and the prefix put in front of a rewritten number.
DEFAULT_PREFIXES = ("Y", "X", "B", "H")
NEW_PREFIX = "H"

# Supported file extensions.
SUPPORTED_EXTENSIONS = (".pdf", ".tif", ".tiff", ".jpg", ".jpeg", ".png")

# Symbols that recognisers return in place of a digit.
SYMBOL_DIGITS = {"/": "1", "!": "1", "|": "1", "\\": "1", "(": "0", ")": "0"}

# Letters that stand for a digit in digit positions.
LETTER_DIGITS = {"I": "1", "O": "0", "S": "5", "B": "8", "Z": "2", "G": "6", "T": "7", "Q": "0", "D": "0"}

# Letters folded to digits when two readings are compared.
CONFUSABLE_DIGITS = {"O": "0", "I": "1", "S": "5", "Z": "2", "B": "8"}

# Revision patterns in order of priority (group 1 is the revision).
REVISION_PATTERNS = (
    r"[_\-](?:Rev|REV|rev)([0-9A-Za-z]{1,4})",
    r"[_\-]R([0-9]{1,3})(?![A-Za-z])",
    r"(?i)[_\-]v([0-9]{1,3})(?![A-Za-z])",
    r"-([A-Z])(?=[._]|$)",
)

# Header keywords of the number column and their match threshold.
MATERIAL_KEYWORDS = (
    "MATERIAL CODE", "MATERIALCODE", "MATERIAL", "材料代号", "零部件图号", "PARTS LIST", "代号",
)
MATERIAL_THRESHOLD = 0.70
# Keywords and exact terms that confirm the number column.
COLUMN_CHECK_KEYWORDS = ("MATERIAL CODE", "MATERUL CODE", "零部件图号", "DEF", "代号")
COLUMN_CHECK_THRESHOLD = 0.60
# Labels in front of the drawing number, in the order in which they are stripped.
LABEL_PREFIXES = ("DWG NO.", "DWG NO", "DWGNO", "DWG", "図面番号", "図番", "图号")
LABEL_STARTS = ("DWG", "OWG", "図", "图")

# Percent regions used when detection fails (x_min, x_max, y_min, y_max).
DEFAULT_REGIONS = {
    "left_table": (0.0, 0.18, 0.0, 1.0),
    "bottom_right_title": (0.75, 1.0, 0.85, 1.0),
    "top_left_number": (0.0, 0.20, 0.0, 0.08),
}

# What a file's first letter suppresses.
SUPPRESSED_REGIONS = {
    "Y": (),
    "B": ("material_code_column",),
    "P": ("bottom_right_number", "top_left_number"),
    "G": ("bottom_right_number", "top_left_number"),
    "O": ("bottom_right_number", "top_left_number"),
    "J": ("bottom_right_number", "top_left_number"),
}

# Output folders, file names and log columns.
OUTPUT_FOLDERS = {"vector": "PDF_Replacement", "ocr": "VLMOCR"}
BOX_CSV_NAME = "y_boxes.csv"
BOX_CSV_COLUMNS = ("source_file", "token", "x1", "y1", "x2", "y2")
LOG_CSV_HEADER = ("处理日期", "图号", "版本", "文件名", "处理方式(O/N)", "状态", "文件ID", "批次号")

# Queue and watch settings.
JOB_STATUSES = ("pending", "running", "done", "failed")
MAX_RETRY = 1
STABLE_SECONDS = 3.0
LOG_TAIL = 200
PAGE_SIZE = 10

# Pixel limits of image scaling.
MAX_EDGE = 2100
MAX_SCALED_EDGE = 3500
UPSCALE_BELOW = 1500

# Math markup and what replaces it, in order.
MARKUP = (
    (r"\\[()\[\]]", ""),
    (r"_\{([^}]*)\}", "$1"),
    (r"\^\{([^}]*)\}", "$1"),
    (r"\\[a-zA-Z]+", ""),
    (r"[{}]", ""),
)
# Number of the last search, and what stands around the first letter of a span code.
RELAXED_NUMBER = r"Y[A-Z0-9][A-Z0-9\-]{2,}"
SPAN_CODE_BEFORE, SPAN_CODE_AFTER, SPAN_CODE_REST = "(?<![A-Z0-9])", "(?=[A-Z0-9-])", "[A-Za-z0-9-]*"
