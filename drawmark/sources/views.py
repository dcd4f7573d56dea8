"""Engine inputs derived from the benchmark tables.

Each view is a projection of one table, written in expressions that Spark and standard SQL share, so
the same text builds the DataFrame and the checking SQL. No view needs a shuffle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_NUMBER = (
    "substr('YXBHPGOJK', CAST(o_orderkey % 9 AS INT) + 1, 1) || 'A' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0')"
    " || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(o_custkey % 26 AS INT) + 1, 1)"
    " || lpad(CAST(o_custkey % 1000 AS STRING), 3, '0')"
)
_FILE_NAME = (
    _NUMBER + " || CASE o_orderkey % 5 WHEN 0 THEN '_Rev2' WHEN 1 THEN '-R03' WHEN 2 THEN '_v4' WHEN 3 THEN '-A' ELSE '' END"
    " || CASE o_orderkey % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.tif' WHEN 2 THEN '.TIFF' WHEN 3 THEN '.jpg'"
    " WHEN 4 THEN '.jpeg' WHEN 5 THEN '.png' ELSE '.txt' END"
)
_ITEM_CODE = (
    "substr('YXBHK', CAST(l_partkey % 5 AS INT) + 1, 1) || 'A' || lpad(CAST(l_partkey % 1000 AS STRING), 3, '0')"
    " || CASE WHEN l_suppkey % 4 = 0 THEN ' ' WHEN l_suppkey % 4 = 1 THEN '/' ELSE '' END"
    " || 'C' || lpad(CAST(l_suppkey % 1000 AS STRING), 3, '0')"
)
_SEQ = ("l_linenumber * CAST(100000000000000000 AS BIGINT) + (l_partkey % 10000000) * CAST(10000000000 AS BIGINT)"
        " + (l_suppkey % 100000000) * 100 + CAST(floor(l_quantity) AS BIGINT)")
_X1 = "CAST(l_partkey % 900 AS INT)"
_Y1 = "CAST(l_linenumber * 65 + l_suppkey % 20 AS INT)"
_X2 = "CAST(l_partkey % 900 + 90 + l_partkey % 40 AS INT)"
_Y2 = "CAST(l_linenumber * 65 + l_suppkey % 20 + 24 + l_suppkey % 8 AS INT)"
_LOC = "'<|LOC_' || CAST({0} AS STRING) || '|><|LOC_10|><|LOC_' || CAST({0} + 100 AS STRING) || '|><|LOC_10|><|LOC_' || CAST({0} + 100 AS STRING) || '|><|LOC_40|><|LOC_' || CAST({0} AS STRING) || '|><|LOC_40|>'"
_SEG_A = "p_name || " + _LOC.format("p_size")
_SEG_B = "' ' || p_type || ' ' || " + _LOC.format("(p_size + 5)")

VIEWS: dict[str, tuple[str, list[str]]] = {
    "drawing_files": ("orders", [
        "o_orderkey AS file_id", f"{_FILE_NAME} AS file_name",
        "CAST(floor(o_totalprice) AS BIGINT) AS size_bytes", "o_orderdate AS mtime",
        "CASE o_custkey % 6 WHEN 0 THEN '.cache' WHEN 1 THEN 'inbox' WHEN 2 THEN 'batch_a' WHEN 3 THEN 'batch_b'"
        " WHEN 4 THEN '.tmp' ELSE 'archive' END AS folder",
        "o_orderpriority AS priority",
        "CASE o_orderkey % 3 WHEN 0 THEN 'a short label' WHEN 1 THEN '  NOTES 1. ALL DIMENSIONS ARE IN MM UNLESS OTHERWISE STATED. 2. DEBURR  '"
        " ELSE '图纸技术要求未注公差按标准执行图纸技术要求未注公差按标准执行图纸技术要求未注公差按标准执行图纸技术要求 A1' END AS page_text",
    ]),
    "ocr_items": ("lineitem", [
        "l_orderkey AS page_id", f"{_SEQ} AS seq",
        "CASE l_partkey % 6 WHEN 0 THEN 'DWG NO ' WHEN 1 THEN '01.021' WHEN 2 THEN '' WHEN 3 THEN 'T' WHEN 4 THEN 'V' ELSE 'MATERIAL ' END"
        f" || {_ITEM_CODE} AS text",
        "1.0 - l_discount AS conf", f"{_X1} AS x1", f"{_Y1} AS y1", f"{_X2} AS x2", f"{_Y2} AS y2",
    ]),
    "header_items": ("lineitem", [
        "l_orderkey AS page_id", f"{_SEQ} AS seq",
        "CASE WHEN l_partkey % 2 = 0 THEN 'en' ELSE 'ch' END AS lang",
        "CASE l_partkey % 11 WHEN 0 THEN 'MATERlAL CODE' WHEN 1 THEN 'DEF' WHEN 2 THEN 'DFF.' WHEN 3 THEN '品群' WHEN 4 THEN '零部件图号'"
        " WHEN 5 THEN 'MATERIAL  CODE' WHEN 6 THEN 'PARTS LST' WHEN 7 THEN 'NAME' WHEN 8 THEN '代 号' WHEN 9 THEN 'QTY'"
        " ELSE 'DEF.' END AS text",
        "1.0 - l_discount AS conf", f"{_X1} AS x1", f"{_Y1} AS y1", f"{_X2} AS x2", f"{_Y2} AS y2",
    ]),
    "short_items": ("lineitem", [
        "l_orderkey AS page_id", f"{_SEQ} AS seq",
        "CASE l_partkey % 7 WHEN 0 THEN '零' WHEN 1 THEN '部' WHEN 2 THEN '件' WHEN 3 THEN '图' WHEN 4 THEN '号' WHEN 5 THEN 'DE' ELSE 'LONG' END AS text",
        "1.0 - l_discount AS conf",
        "CAST((l_partkey % 8) * 60 AS INT) AS x1", "CAST((l_suppkey % 5) * 40 AS INT) AS y1",
        "CAST((l_partkey % 8) * 60 + 30 AS INT) AS x2", "CAST((l_suppkey % 5) * 40 + 20 + l_partkey % 9 AS INT) AS y2",
    ]),
    "line_segments": ("lineitem", [
        "l_orderkey AS page_id", "CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS axis",
        "CAST(l_linenumber * 65 + l_partkey % 12 AS INT) AS pos", "CAST(l_suppkey % 50 AS INT) AS start_px",
        "CAST(l_suppkey % 50 + 200 + floor(l_quantity) * 10 AS INT) AS end_px",
        "CAST(l_suppkey % 3 AS INT) AS level",
    ]),
    "page_sizes": ("orders", [
        "o_orderkey AS page_id", "CAST(1000 + (o_orderkey % 5) * 400 AS INT) AS img_w",
        "CAST(600 + (o_custkey % 7) * 250 AS INT) AS img_h",
    ]),
    "page_regions": ("orders", [
        "o_orderkey AS page_id", f"{_FILE_NAME} AS file_name",
        "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(80 + o_custkey % 120 AS INT) END AS red_x",
        "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(60 + o_orderkey % 90 AS INT) END AS red_y",
        "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(250 + o_custkey % 60 AS INT) END AS red_w",
        "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(300 + o_orderkey % 100 AS INT) END AS red_h",
        "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(600 + o_custkey % 200 AS INT) END AS green_x",
        "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(350 + o_orderkey % 80 AS INT) END AS green_y",
        "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(180 + o_custkey % 40 AS INT) END AS green_w",
        "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(40 + o_orderkey % 20 AS INT) END AS green_h",
        "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(10 + o_custkey % 30 AS INT) END AS orange_x",
        "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(5 + o_orderkey % 25 AS INT) END AS orange_y",
        "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(120 + o_custkey % 50 AS INT) END AS orange_w",
        "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(30 + o_orderkey % 15 AS INT) END AS orange_h",
        f"CASE o_custkey % 4 WHEN 0 THEN {_NUMBER} WHEN 1 THEN 'YA 00' || CAST(o_orderkey % 50 AS STRING) WHEN 2 THEN NULL ELSE 'ZZ-1' END AS green_text",
        f"CASE o_orderkey % 4 WHEN 0 THEN lower({_NUMBER}) WHEN 1 THEN 'YA00' || CAST(o_orderkey % 50 AS STRING) WHEN 2 THEN 'B99' ELSE NULL END AS orange_text",
    ]),
    "components": ("lineitem", [
        "l_orderkey AS page_id", f"{_SEQ} AS cc_id",
        "CAST(l_partkey % 700 AS INT) AS x", "CAST((l_suppkey * 37 + l_partkey) % 500 AS INT) AS y",
        "CAST(CASE l_partkey % 5 WHEN 0 THEN 4 + l_suppkey % 6 WHEN 1 THEN 120 + l_suppkey % 150 WHEN 2 THEN 900 ELSE 20 + l_partkey % 60 END AS INT) AS w",
        "CAST(CASE l_partkey % 7 WHEN 0 THEN 2 WHEN 1 THEN 90 + l_partkey % 50 ELSE 10 + l_suppkey % 30 END AS INT) AS h",
        "CAST(CASE l_suppkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 30 ELSE 150 + floor(l_quantity) * 140 END AS INT) AS area",
    ]),
    "crop_hits": ("lineitem", [
        "l_orderkey AS page_id", "CAST(l_linenumber AS INT) AS crop", f"{_SEQ} AS seq",
        "'YA' || lpad(CAST(l_partkey % 3 AS STRING), 3, '0') || 'C100' AS token",
        "CAST((l_suppkey % 4) * 12 AS INT) AS x1", "CAST((l_partkey % 3) * 6 AS INT) AS y1",
        "CAST((l_suppkey % 4) * 12 + 80 AS INT) AS x2", "CAST((l_partkey % 3) * 6 + 24 AS INT) AS y2",
    ]),
    "job_events": ("events", [
        "user_id AS job_id", "event_id AS event_seq", "ts AS event_time",
        "CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'done'"
        " WHEN 'error' THEN 'fail' ELSE 'reset' END AS op", "value AS value",
    ]),
    "file_observations": ("events", [
        "'inbox/YA' || lpad(CAST(user_id % 1000000 AS STRING), 6, '0') || '_R1.tif' AS path", "ts AS seen_at",
        "event_id AS obs_seq", "CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(floor(value / 20) AS BIGINT) END AS size_bytes",
        "CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(floor(value / 45) AS BIGINT) * 1000000 END AS mtime_us",
    ]),
    "edit_events": ("events", [
        "user_id AS box_id", "event_id AS event_seq",
        "CASE event_type WHEN 'signup' THEN 'unlock' WHEN 'view' THEN 'confirm' WHEN 'purchase' THEN 'commit'"
        " WHEN 'error' THEN 'commit' ELSE 'reset' END AS action",
        "CASE WHEN event_id % 3 = 0 THEN '   ' ELSE ' YA' || CAST(event_id % 500 AS STRING) || ' ' END AS text",
        "value * 3.0 AS x", "value / 2.0 AS y", "value - 5.0 AS w", "CAST(40.5 AS DOUBLE) + floor(value) AS h",
    ]),
    "job_log": ("orders", [
        "o_orderkey AS job_id", f"{_FILE_NAME} AS file_name",
        "CASE WHEN o_orderstatus = 'F' THEN 'success' ELSE 'error' END AS status",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'vector' ELSE 'ocr' END AS method",
        "CAST(o_orderkey % 8 AS INT) AS total", "o_orderdate AS process_date",
        "CAST(o_orderkey % 40 AS BIGINT) AS batch_id", "o_totalprice / 100 AS seconds",
    ]),
    "spotting_raw": ("part", [
        "p_partkey AS page_id",
        f"CASE p_partkey % 3 WHEN 0 THEN {_SEG_A} WHEN 1 THEN {_SEG_A} || {_SEG_B} || {_SEG_A} || {_SEG_B}"
        f" ELSE {_SEG_A} || {_SEG_A} || {_SEG_A} || {_SEG_A} || {_SEG_B} END AS raw",
        "CAST(2000 - (p_partkey % 4) * 400 AS INT) AS img_w", "CAST(1400 - (p_partkey % 2) * 200 AS INT) AS img_h",
    ]),
    "markup_text": ("part", [
        "p_partkey AS text_id",
        "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN chr(92) || '( ' || p_name || '_{' || CAST(p_size AS STRING) || '} ' || chr(92) || ')'"
        " WHEN 2 THEN ' ' || chr(92) || 'frac{' || p_name || '}^{2} ' || chr(92) || 'alpha1 ' ELSE chr(92) || '[x^{a}' || chr(92) || '] {' || p_brand || '}' END AS text",
    ]),
    "telemetry": ("events", [
        "event_id AS line_id",
        "CASE WHEN event_id % 11 = 0 THEN 'short, 1, 2' ELSE 'card ' || CAST(user_id % 4 AS STRING) || ', ' || CAST(user_id % 8 AS STRING)"
        " || ', ' || CAST(event_id % 100 AS STRING) || ', ' || CASE event_id % 5 WHEN 0 THEN '[N/A]' WHEN 1 THEN '' ELSE CAST(event_id % 101 AS STRING) END"
        " || ', ' || CAST(event_id % 24576 AS STRING) || ', 24576, ' || CASE event_id % 7 WHEN 0 THEN 'bad' ELSE '35' END"
        " || ', 1410, 120.5, 350.0' END AS line",
    ]),
    "box_rows": ("lineitem", [
        "CASE l_partkey % 9 WHEN 0 THEN '  ' WHEN 1 THEN 'dir/D' || CAST(l_orderkey AS STRING) || '.tif' WHEN 2 THEN 'D' || CAST(l_orderkey AS STRING) || '.TIFF'"
        " ELSE ' D' || CAST(l_orderkey AS STRING) || ' ' END AS source_file",
        f"{_ITEM_CODE} AS token",
        "CASE l_suppkey % 6 WHEN 0 THEN 'abc' WHEN 1 THEN ' ' || CAST(l_partkey % 900 AS STRING) WHEN 2 THEN '12.5' ELSE CAST(l_partkey % 900 AS STRING) END AS x1",
        "CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE CAST(l_suppkey AS STRING) END AS y1",
        "CAST(l_partkey % 900 + 50 AS STRING) AS x2", "CAST(l_suppkey + 20 AS STRING) AS y2",
    ]),
    "replaced_files": ("orders", [
        "'HYA' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || '_' || CAST(o_orderkey AS STRING)"
        " || CASE o_orderkey % 3 WHEN 0 THEN '-R.tif' WHEN 1 THEN '-R.TIFF' ELSE '-R.png' END AS name",
    ]),
    "original_files": ("orders", [
        "'YA' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') || '_' || CAST(o_orderkey AS STRING)"
        " || CASE o_custkey % 3 WHEN 0 THEN '.tif' WHEN 1 THEN '.tiff' ELSE '.TIFF' END AS name",
    ]),
    "box_stems": ("lineitem", [
        "'YA' || lpad(CAST(l_orderkey % 1000 AS STRING), 3, '0') || '_' || CAST(l_orderkey AS STRING) AS stem", f"{_ITEM_CODE} AS token",
    ]),
    "tasks": ("orders", [
        "o_orderkey AS docnumber", f"{_NUMBER} AS th", "CAST(o_orderkey % 5 AS STRING) AS bbh", f"{_FILE_NAME} AS filename",
        "CAST(o_custkey % 12 AS STRING) AS work_seq",
        "CASE WHEN o_orderstatus = 'O' THEN '0' ELSE '1' END AS isprocess", "o_orderdate AS upd_timestamp",
    ]),
    "locations": ("orders", [
        "o_orderkey AS docnumber", f"{_NUMBER} AS th", "CAST(o_orderkey % 5 AS STRING) AS bbh", f"{_FILE_NAME} AS fname",
        "CAST(o_custkey % 12 AS STRING) AS work_seq",
        "CAST(o_custkey % 2 AS INT) AS del", "CAST(1 + o_orderkey % 4 AS STRING) AS wkaid",
        "'vol' || CAST(o_custkey % 9 AS STRING) AS location",
    ]),
    "inbox_names": ("part", ["'D' || CAST(p_partkey AS STRING) || '.tif' AS name"]),
    "stored_names": ("lineitem", [
        "'D' || CAST(l_partkey % 1500 AS STRING) || CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE '_' || lpad(CAST(l_suppkey % 4 AS STRING), 3, '0') END || '.tif' AS name",
    ]),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, exprs = VIEWS[name]
    return table(spark, sf_dir, base).selectExpr(*exprs)


def view_sql(name: str) -> str:
    base, exprs = VIEWS[name]
    return f"SELECT {', '.join(exprs)} FROM {base}"


def ink(segments: DataFrame) -> DataFrame:
    """Ink per pixel position: how many segments of a page lie at each position."""
    return segments.groupBy("page_id", "pos").count().selectExpr("page_id", "pos", "CAST(count AS INT) AS value")


def line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ink(view(spark, sf_dir, "line_segments"))
