"""Queries of sources, sinks, jobs, votes and reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from drawmark.checks.catalog import query
from drawmark.checks.geometry_queries import _J2, _OV, grid_pages, items
from drawmark.checks.text_queries import BALLOT, REV, RORIG, RSTEM, _VECTOR, ext, num, stem
from drawmark.functions import display, names, readings, text
from drawmark.functions.boxes import Box
from drawmark.operators import cells, jobs, reports, votes
from drawmark.settings import LOG_CSV_HEADER
from drawmark.sources import box_csv, files, logs, tasks, telemetry
from drawmark.sources.views import view
from drawmark.streaming import watch

FILES = ("drawing_files",)
SUP = f"{ext('file_name')} IN ('.pdf', '.tif', '.tiff', '.jpg', '.jpeg', '.png')"


@query("S1", f"SELECT file_name, size_bytes, {ext('file_name')} AS ext FROM drawing_files WHERE {SUP}", FILES)
def s1(spark, sf):
    return files.supported(view(spark, sf, "drawing_files")).select("file_name", "size_bytes", "ext")


@query("S1_total", f"SELECT count(*) AS total FROM drawing_files WHERE {SUP}", FILES)
def s1_total(spark, sf):
    return view(spark, sf, "drawing_files").filter(names.is_supported(F.col("file_name"))).agg(F.count("*").alias("total"))


@query("S2", f"SELECT file_id, file_name FROM drawing_files WHERE {SUP} AND file_name IN (SELECT file_name FROM drawing_files WHERE priority = '1-URGENT')", FILES)
def s2(spark, sf):
    listing = view(spark, sf, "drawing_files")
    chosen = listing.filter("priority = '1-URGENT'").select("file_name")
    return files.selected(listing.filter(names.is_supported(F.col("file_name"))), chosen).select("file_id", "file_name")


@query("S3", "SELECT DISTINCT priority AS parent, folder FROM drawing_files WHERE folder NOT LIKE '.%'", FILES)
def s3(spark, sf):
    return files.visible_folders(view(spark, sf, "drawing_files"), F.col("priority"), F.col("folder"))


@query("S4", "SELECT file_name AS source_file, coalesce(green_text, '') AS token, green_x AS x1, green_y AS y1, green_x + green_w AS x2, green_y + green_h AS y2 FROM page_regions WHERE green_x IS NOT NULL", ("page_regions",))
def s4(spark, sf):
    found = view(spark, sf, "page_regions").filter("green_x IS NOT NULL").selectExpr(
        "file_name AS source_file", "green_text AS token", "green_x AS x", "green_y AS y", "green_w AS w", "green_h AS h")
    return box_csv.box_records(found)


_INT = "regexp_matches({0}, '^\\s*[+-]?[0-9]+(_[0-9]+)*\\s*$')"


@query("S5", f"""SELECT CASE WHEN regexp_matches(lower(s), '[.]tiff?$') THEN regexp_replace(regexp_extract(s, '[^/]*$'), '[.][^.]*$', '') ELSE s END AS stem, token,
   CAST(trim(x1) AS INTEGER) AS x1, CAST(trim(y1) AS INTEGER) AS y1, CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2 FROM (SELECT *, trim(source_file) AS s FROM box_rows)
   WHERE s <> '' AND {' AND '.join(f'coalesce({_INT.format(c)}, false)' for c in ('x1', 'y1', 'x2', 'y2'))}""", ("box_rows",))
def s5(spark, sf):
    return box_csv.clean_boxes(view(spark, sf, "box_rows"))


_LOG = (f"SELECT job_id, coalesce({num('upper(st)')}, st) AS drawing_no, {REV} AS revision, file_name AS filename, CASE WHEN status = 'success' AND method = 'ocr' THEN 'O' ELSE 'N' END AS ocr_flag, "
        f"CASE WHEN status = 'success' THEN 'success' ELSE 'failed' END AS status, strftime(process_date, '%Y-%m-%dT%H:%M:%S') AS process_date FROM (SELECT *, {stem('file_name')} AS st FROM @src)")


def log(spark, sf):
    return logs.log_rows(view(spark, sf, "job_log"))


@query("S6", f"SELECT *, CAST(NULL AS VARCHAR) AS docnumber, CAST(NULL AS VARCHAR) AS work_seq FROM ({_LOG.replace('@src', 'job_log')})", ("job_log",))
def s6(spark, sf):
    return log(spark, sf)


@query("S7", f"SELECT {', '.join(f'{c} AS {chr(34)}{h}{chr(34)}' for c, h in zip(('process_date', 'drawing_no', 'revision', 'filename', 'ocr_flag', 'status', chr(39) * 2, chr(39) * 2), LOG_CSV_HEADER)).replace(chr(34) + '处理方式(O/N)' + chr(34), 'flag')} FROM ({_LOG.replace('@src', 'job_log')})", ("job_log",))
def s7(spark, sf):
    return logs.csv_mirror(log(spark, sf)).withColumnRenamed("处理方式(O/N)", "flag")


@query("S8", f""", r AS (SELECT *, CASE WHEN job_id % 2 = 0 THEN 'bad page' END AS error FROM job_log), t AS (SELECT count(*) AS n, count(*) FILTER (status = 'success') AS s, count(*) FILTER (status = 'error') AS e, coalesce(sum(total) FILTER (status = 'success'), 0) AS c FROM r)
   SELECT 0 AS section, '' AS file_name, CAST(0 AS BIGINT) AS job_id, CAST(-1 AS BIGINT) AS ord, '总计: ' || n || ' 个文件' AS line FROM t UNION ALL SELECT 1, '', 0, -1, '成功: ' || s FROM t UNION ALL SELECT 2, '', 0, -1, '失败: ' || e FROM t UNION ALL SELECT 3, '', 0, -1, '总替换数: ' || c FROM t
   UNION ALL SELECT 4, file_name, job_id, -1, '  ' || file_name || ' [' || method || '] ' || total || ' 处替换' FROM r WHERE status = 'success'
   UNION ALL SELECT 4, file_name, job_id, seq, '    ' || m || ' → H' || m FROM (SELECT page_id, seq, {num('text')} AS m FROM ocr_items) JOIN r ON job_id = page_id WHERE status = 'success' AND m IS NOT NULL
   UNION ALL SELECT 5, file_name, job_id, -1, '  ' || file_name || ': ' || coalesce(error, 'unknown') FROM r WHERE status = 'error'""", ("job_log", "ocr_items"))
def s8(spark, sf):
    results = view(spark, sf, "job_log").withColumn("error", F.expr("CASE WHEN job_id % 2 = 0 THEN 'bad page' END"))
    found = items(spark, sf).select(F.col("page_id").alias("job_id"), "seq", text.first_number(F.col("text")).alias("old_text")).filter("old_text IS NOT NULL")
    return reports.report_lines(results, found.withColumn("new_text", text.rewritten(F.col("old_text"))))


_OUT = f"CASE WHEN method = 'vector' THEN '.pdf' WHEN {ext('file_name')} IN ('.tif', '.tiff', '.pdf') THEN '.tif' ELSE {ext('file_name')} END"
_ROUTED = f"(SELECT *, CASE WHEN {ext('file_name')} = '.pdf' AND {_VECTOR} THEN 'vector' ELSE 'ocr' END AS method FROM drawing_files WHERE {SUP})"


@query("S9", f"SELECT file_id, 'out/' || {stem('file_name')} || {_OUT} AS other_dir, 'in/' || {stem('file_name')} || '_replaced' || {_OUT} AS same_dir FROM {_ROUTED}", FILES)
def s9(spark, sf):
    path = F.concat(F.lit("in/"), F.col("file_name"))
    return files.routed(view(spark, sf, "drawing_files")).select(
        "file_id", names.output_path(path, F.lit("out"), F.col("out_ext")).alias("other_dir"),
        names.output_path(path, F.lit("in"), F.col("out_ext")).alias("same_dir"))


@query("S10", f"SELECT file_id, CASE WHEN method = 'vector' THEN 'PDF_Replacement' ELSE 'VLMOCR' END AS subdir FROM {_ROUTED}", FILES)
def s10(spark, sf):
    return files.routed(view(spark, sf, "drawing_files")).select("file_id", "subdir")


@query("S11", """, tk AS (SELECT DISTINCT name FROM stored_names), nn AS (SELECT i.name, replace(i.name, '.tif', '') AS st, i.name IN (SELECT name FROM tk) AS clash FROM inbox_names i)
   SELECT name, CASE WHEN NOT clash THEN name ELSE (SELECT min(c) FROM (SELECT st || '_' || lpad(CAST(k AS VARCHAR), 3, '0') || '.tif' AS c FROM range(1, 6) r(k)) WHERE c NOT IN (SELECT name FROM tk)) END AS free_name FROM nn""", ("inbox_names", "stored_names"))
def s11(spark, sf):
    return files.free_names(view(spark, sf, "inbox_names"), view(spark, sf, "stored_names"))


_A3 = ("SELECT batch_id, count(*) FILTER (status = 'success') AS completed, count(*) AS total, CAST(sum(CAST(floor(seconds) AS BIGINT)) AS BIGINT) AS elapsed, "
       "CAST(floor(count(*) FILTER (status = 'success') * 100 / count(*)) AS INTEGER) AS progress FROM job_log GROUP BY batch_id")


def progress(spark, sf):
    return jobs.batch_progress(view(spark, sf, "job_log").withColumn("seconds_whole", F.floor("seconds").cast("bigint")), ["batch_id"])


@query("A3", _A3, ("job_log",))
def a3(spark, sf):
    return progress(spark, sf)


@query("S12", f"SELECT batch_id, CAST(to_json({{phase: 'processing', isRunning: completed < total, totalFiles: total, currentFile: completed, totalElapsed: elapsed, progress: progress}}) AS VARCHAR) AS status FROM ({_A3})", ("job_log",))
def s12(spark, sf):
    return reports.status_documents(progress(spark, sf))


@query("S13", "SELECT job_id, event_seq FROM (SELECT job_id, event_seq, row_number() OVER (PARTITION BY job_id ORDER BY event_seq DESC) AS k FROM job_events) WHERE k <= 200", ("job_events",))
def s13(spark, sf):
    return reports.log_tail(view(spark, sf, "job_events").select("job_id", "event_seq"))


_TASKS = "tasks t JOIN locations l ON t.th = l.th AND t.bbh = l.bbh AND t.filename = l.fname AND t.docnumber = l.docnumber AND t.work_seq = l.work_seq WHERE isprocess = '0' AND del = 0 AND wkaid <> '3'"


@query("S15", f"SELECT t.docnumber, 'data/' || location || '/' || fname AS source_path, 'archive/' || t.work_seq || '/' || t.th || '-' || t.bbh || '/' || fname AS archive_path FROM {_TASKS}", ("tasks", "locations"))
def s15(spark, sf):
    return tasks.with_paths(tasks.located(view(spark, sf, "tasks"), view(spark, sf, "locations")), "data", "archive")


@query("J21", f"SELECT t.th, t.bbh, fname, t.docnumber, t.work_seq, '1' AS isprocess, CASE WHEN t.docnumber % 3 = 0 THEN 'N' ELSE 'O' END AS ocr FROM {_TASKS}", ("tasks", "locations"))
def j21(spark, sf):
    flags = view(spark, sf, "job_log").select(F.col("job_id").alias("docnumber"), names.ocr_flag(F.col("method")).alias("ocr_flag"))
    return tasks.write_back(tasks.located(view(spark, sf, "tasks"), view(spark, sf, "locations")), flags)


_NUMF = "CASE WHEN trim(p[{0}]) IN ('', '[N/A]', 'N/A') THEN 0.0 ELSE coalesce(TRY_CAST(trim(p[{0}]) AS DOUBLE), 0.0) END"


@query("S16", "SELECT line_id, trim(p[1]) AS name, CAST(" + _NUMF.format(2) + " AS INTEGER) AS index, " + ", ".join(
    f"{('round(' + _NUMF.format(i) + ' / 1024, 1)') if i in (5, 6) else _NUMF.format(i)} AS {n}" for i, n in (
        (3, "temperature"), (4, "load"), (5, "memory_used"), (6, "memory_total"), (7, "fan_speed"), (8, "clock_speed"), (9, "power_draw"), (10, "power_limit")))
    + " FROM (SELECT line_id, string_split(line, ',') AS p FROM telemetry) WHERE len(p) >= 10", ("telemetry",))
def s16(spark, sf):
    return telemetry.device_rows(view(spark, sf, "telemetry"))


@query("J1", f""", m AS (SELECT name, {RORIG} AS wanted, {RSTEM} AS stem FROM replaced_files), k AS (SELECT DISTINCT name FROM original_files), b AS (SELECT stem, count(*) AS n FROM box_stems GROUP BY stem)
   SELECT m.name, coalesce(k1.name, k2.name) AS original, k1.name IS NULL AND k2.name IS NULL AS missing, coalesce(n, 0) AS n_boxes FROM m LEFT JOIN k k1 ON k1.name = wanted LEFT JOIN k k2 ON k2.name = regexp_replace(wanted, '[.][^.]*$', '.tiff') LEFT JOIN b ON b.stem = m.stem""",
       ("replaced_files", "original_files", "box_stems"))
def j1(spark, sf):
    return box_csv.replaced_with_sources(view(spark, sf, "replaced_files"), view(spark, sf, "original_files"), view(spark, sf, "box_stems"))


_STATE = """, st AS (SELECT job_id, max(event_seq) AS enq, arg_max(event_time, event_seq) AS created_at FROM job_events WHERE op = 'enqueue' GROUP BY job_id),
  lv AS (SELECT e.* FROM job_events e JOIN st USING (job_id) WHERE op <> 'enqueue' AND event_seq > enq),
  fl AS (SELECT job_id, count(*) AS nf, min(event_seq) AS rq FROM lv WHERE op = 'fail' GROUP BY job_id),
  ag AS (SELECT job_id, arg_max(op, event_seq) FILTER (op <> 'reset') AS mop, max(event_seq) FILTER (op <> 'reset') AS mseq, max(event_seq) FILTER (op = 'reset') AS rs,
    arg_max(event_time, event_seq) FILTER (op = 'claim' AND (rq IS NULL OR event_seq > rq)) AS started_at, arg_max(event_time, event_seq) FILTER (op IN ('done', 'fail') AND (rq IS NULL OR event_seq > rq)) AS finished_at,
    arg_max(op, event_seq) FILTER (op IN ('done', 'fail') AND (rq IS NULL OR event_seq > rq)) AS eop, max(event_seq) FILTER (op = 'done') AS ds, max(nf) AS nf FROM lv LEFT JOIN fl USING (job_id) GROUP BY job_id),
  jobs AS (SELECT job_id, CASE WHEN mop = 'claim' AND rs > mseq THEN 'pending' WHEN mop = 'claim' THEN 'running' WHEN mop = 'done' THEN 'done' WHEN mop = 'fail' AND nf > 1 THEN 'failed' ELSE 'pending' END AS status,
    CAST(least(coalesce(nf, 0), 1) AS INTEGER) AS retry_count, created_at, started_at, finished_at, CASE WHEN eop = 'fail' THEN 'error' END AS error_msg, ds IS NOT NULL AS has_result FROM st LEFT JOIN ag USING (job_id))"""
EV = ("job_events",)


def current(spark, sf):
    return jobs.current_jobs(view(spark, sf, "job_events"))


def iso(*cols):
    return [F.date_format(c, logs.ISO).alias(c) for c in cols]


def iso_sql(*cols):
    return ", ".join(f"strftime({c}, '%Y-%m-%dT%H:%M:%S') AS {c}" for c in cols)


@query("T3", _STATE + f" SELECT job_id, status, retry_count, {iso_sql('created_at', 'started_at', 'finished_at')}, error_msg, has_result FROM jobs", EV)
def t3(spark, sf):
    return current(spark, sf).select("job_id", "status", "retry_count", *iso("created_at", "started_at", "finished_at"), "error_msg", "has_result")


@query("T4", _STATE + " SELECT job_id, status = 'running' AS was_reset, CASE status WHEN 'running' THEN 'pending' ELSE status END AS status FROM jobs", EV)
def t4(spark, sf):
    return jobs.stale_reset(current(spark, sf)).select("job_id", "was_reset", "status")


_OVER = _STATE + ", ov AS (SELECT j.job_id, l.file_name, CASE j.status WHEN 'done' THEN 'success' ELSE 'error' END AS status, l.method, j.finished_at AS process_date FROM jobs j JOIN job_log l ON l.job_id = j.job_id WHERE j.status IN ('done', 'failed'))"


@query("T5", _OVER + " " + _LOG.replace('@src', "ov"), ("job_events", "job_log"))
def t5(spark, sf):
    over = jobs.terminal_rows(current(spark, sf), view(spark, sf, "job_log").select("job_id", "file_name", "method"))
    return logs.log_rows(over).drop("docnumber", "work_seq")


@query("T9", _OVER + f""" SELECT job_id, CASE status WHEN 'success' THEN 'output/' ELSE 'failed/' END || CASE WHEN job_id % 2 = 0 THEN {stem('file_name')} || '_' || strftime(process_date, '%Y%m%d_%H%M%S') || regexp_extract(file_name, '[.][^.]*$') ELSE file_name END AS target FROM ov""", ("job_events", "job_log"))
def t9(spark, sf):
    over = jobs.terminal_rows(current(spark, sf), view(spark, sf, "job_log").select("job_id", "file_name", "method"))
    name = files.stamped_name(F.col("file_name"), F.col("process_date"), F.col("job_id") % 2 == 0)
    folder = F.when(F.col("status") == "success", "output/").otherwise("failed/")
    return over.select("job_id", F.concat(folder, name).alias("target"))


@query("A1", _STATE + " SELECT status, count(*) AS n FROM jobs GROUP BY status", EV)
def a1(spark, sf):
    return jobs.status_counts(current(spark, sf))


@query("A2", "SELECT count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS failed, CAST(coalesce(sum(total) FILTER (status = 'success'), 0) AS BIGINT) AS replacements FROM job_log", ("job_log",))
def a2(spark, sf):
    return reports.batch_summary(view(spark, sf, "job_log"))


@query("O1", _STATE + f" SELECT job_id, {iso_sql('created_at')} FROM jobs WHERE status = 'pending' ORDER BY jobs.created_at, job_id LIMIT 1", EV)
def o1(spark, sf):
    return jobs.next_pending(current(spark, sf)).select("job_id", *iso("created_at"))


@query("O2", _STATE + f" SELECT job_id, {iso_sql('created_at')} FROM jobs WHERE status = 'failed' ORDER BY jobs.created_at, job_id LIMIT 100", EV)
def o2(spark, sf):
    return jobs.with_status(current(spark, sf), "failed", 100).select("job_id", *iso("created_at"))


@query("O3", "SELECT job_id, file_name FROM job_log ORDER BY job_id DESC LIMIT 100", ("job_log",))
def o3(spark, sf):
    return reports.recent(view(spark, sf, "job_log"), "job_id", 100).select("job_id", "file_name")


@query("O4", "SELECT file_id, file_name FROM drawing_files WHERE contains(lower(file_name), 'ya') ORDER BY file_name, file_id OFFSET 20 LIMIT 10", FILES)
def o4(spark, sf):
    found = view(spark, sf, "drawing_files").filter(display.found_in("YA", F.col("file_name")))
    return reports.page_of(found, ["file_name", "file_id"], page=3).select("file_id", "file_name")


VOTES = (f"SELECT *, CASE WHEN g = o THEN g WHEN g = f THEN g WHEN o = f THEN o ELSE coalesce(f, g, o) END AS voted FROM (SELECT *, {BALLOT.format('green_text')} AS g, {BALLOT.format('orange_text')} AS o, "
         f"{BALLOT.format('(' + num('upper(' + stem(stem('file_name')) + ')') + ')')} AS f FROM @src)")


@query("A4", f"SELECT page_id, g AS green_vote, o AS orange_vote, f AS file_vote, voted FROM ({VOTES.replace('@src', 'page_regions')})", ("page_regions",))
def a4(spark, sf):
    return votes.with_votes(view(spark, sf, "page_regions")).select("page_id", "green_vote", "orange_vote", "file_vote", "voted")


_CENTRE = "CAST(coalesce(({0}_x <= cx AND cx <= {0}_x + {0}_w AND {0}_y <= cy AND cy <= {0}_y + {0}_h), false) AS INTEGER)"


@query("A14", f"""SELECT page_id, CAST(page_id % 3 AS BIGINT) AS expected, coalesce(found, 0) AS found, coalesce(found, 0) >= page_id % 3 AS match FROM page_sizes LEFT JOIN
   (SELECT page_id, CAST(sum({' + '.join(_CENTRE.format(r) for r in ('red', 'green', 'orange'))}) AS BIGINT) AS found FROM (SELECT *, (x1 + x2) // 2 AS cx, (y1 + y2) // 2 AS cy FROM ocr_items WHERE regexp_matches('H' || text, 'H[A-Z][A-Z0-9][A-Z0-9-]{{2,}}')) JOIN page_regions USING (page_id) GROUP BY page_id) USING (page_id)""",
       ("page_sizes", "ocr_items", "page_regions"))
def a14(spark, sf):
    out = items(spark, sf).withColumn("text", text.rewritten(F.col("text")))
    expected = view(spark, sf, "page_sizes").select("page_id", (F.col("page_id") % 3).alias("expected"))
    return votes.verified(out, view(spark, sf, "page_regions"), expected)


SUPPRESSED = """(SELECT * REPLACE (""" + ", ".join(
    f"CASE WHEN f0 IN ({l}) THEN {r}_{c} END AS {r}_{c}" for r, l in (("red", "'Y', 'P', 'G', 'O', 'J'"), ("green", "'Y', 'B'"), ("orange", "'Y', 'B'")) for c in "xywh") + \
    ") FROM (SELECT *, upper(substr(file_name, 1, 1)) AS f0 FROM page_regions))"
_CODES = "(SELECT page_id, seq, nullif(regexp_extract(t, '[YXBH][A-Z][0-9][A-Z0-9]{3,}'), '') AS code, CAST(trunc(x1 + (strpos(t, nullif(regexp_extract(t, '[YXBH][A-Z][0-9][A-Z0-9]{3,}'), '')) - 1) * ((x2 - x1) / length(t))) AS INTEGER) AS x1, y1, CAST(trunc(x1 + (strpos(t, nullif(regexp_extract(t, '[YXBH][A-Z][0-9][A-Z0-9]{3,}'), '')) - 1 + length(nullif(regexp_extract(t, '[YXBH][A-Z][0-9][A-Z0-9]{3,}'), ''))) * ((x2 - x1) / length(t))) AS INTEGER) AS x2, y2 FROM (SELECT *, replace(upper(text), ' ', '') AS t FROM ocr_items))"
REPLACED = _J2 + f""", sup AS {SUPPRESSED}, vt AS ({VOTES.replace('@src', 'sup')}), rep AS (
   SELECT page_id, file_name, 1 AS rank, 'material_code_column' AS region, CAST(cell_top AS BIGINT) AS seq, cell_text AS old_text, red_x AS x1, red_y + cell_top AS y1, red_x + red_w AS x2, red_y + cell_bottom AS y2 FROM j2 JOIN sup USING (page_id) WHERE red_x IS NOT NULL
   UNION ALL SELECT page_id, file_name, 2, 'bottom_right_number', 0, voted, green_x, green_y, green_x + green_w, green_y + green_h FROM vt WHERE green_x IS NOT NULL AND voted IS NOT NULL
   UNION ALL SELECT page_id, file_name, 3, 'top_left_number', 0, voted, orange_x, orange_y, orange_x + orange_w, orange_y + orange_h FROM vt WHERE green_x IS NOT NULL AND orange_x IS NOT NULL AND voted IS NOT NULL
   UNION ALL SELECT page_id, file_name, 4, 'factory_note_codes', seq, code, x1, y1, x2, y2 FROM {_CODES} JOIN sup USING (page_id) WHERE code IS NOT NULL AND NOT ({' OR '.join(_OV.format(r=r, t=0.3) for r in ('red', 'green', 'orange'))}))"""
RV = ("line_segments", "ocr_items", "page_regions")


def note_codes(spark, sf, of=lambda df: df):
    code, confidence, box = readings.note_code(F.col("text"), Box.corners())
    return of(items(spark, sf)).select("page_id", "seq", code.alias("code"), *box.columns()).filter("code IS NOT NULL")


def replacements(spark, sf, of=lambda df: df):
    """Rewrites of all pages, or of those that ``of`` leaves of each input."""
    found = cells.grid_cells(of(items(spark, sf)), grid_pages(spark, sf, of))
    return votes.all_replacements(found, of(view(spark, sf, "page_regions")), note_codes(spark, sf, of))


@query("A17", REPLACED + " SELECT page_id, rank, seq, old_text, 'H' || old_text AS new_text FROM rep", RV)
def a17(spark, sf):
    return replacements(spark, sf).select("page_id", "rank", "seq", "old_text", "new_text")


@query("Q3", REPLACED + " SELECT file_name, region, old_text, 'H' || old_text AS new_text, x1, y1, x2, y2 FROM rep", RV)
def q3(spark, sf):
    return replacements(spark, sf).select("file_name", "region", "old_text", "new_text", "x1", "y1", "x2", "y2")


@query("A20", f"SELECT page_id, CAST((red_x IS NOT NULL)::INT + (green_x IS NOT NULL)::INT + (orange_x IS NOT NULL)::INT AS INTEGER) AS n_regions, concat_ws(',', CASE WHEN red_x IS NOT NULL THEN 'material_code_column' END, CASE WHEN green_x IS NOT NULL THEN 'bottom_right_number' END, CASE WHEN orange_x IS NOT NULL THEN 'top_left_number' END) AS regions FROM {SUPPRESSED}", ("page_regions",))
def a20(spark, sf):
    from drawmark.operators.regions import REGIONS, suppressed
    found = [F.when(F.col(f"{n}_x").isNotNull(), F.lit(r)) for n, r in REGIONS.items()]
    listed = F.array_compact(F.array(*found))
    return suppressed(view(spark, sf, "page_regions")).select("page_id", F.size(listed).alias("n_regions"), F.array_join(listed, ",").alias("regions"))


@query("A21", f"SELECT substr(process_date, 1, 10) AS day, ocr_flag, count(*) AS n FROM ({_LOG.replace('@src', 'job_log')}) GROUP BY ALL", ("job_log",))
def a21(spark, sf):
    return reports.log_slices(log(spark, sf))


_STABLE = """, g AS (SELECT *, (row_number() OVER w = 1 OR lag(size_bytes) OVER w IS DISTINCT FROM size_bytes OR lag(mtime_us) OVER w IS DISTINCT FROM mtime_us) AS chg FROM file_observations WINDOW w AS (PARTITION BY path ORDER BY seen_at, obs_seq)),
  r AS (SELECT *, max(CASE WHEN chg THEN seen_at END) OVER (PARTITION BY path ORDER BY seen_at, obs_seq ROWS UNBOUNDED PRECEDING) AS run_start FROM g),
  stable AS (SELECT path, run_start, min(seen_at) AS stable_at, min(size_bytes) AS size_bytes FROM r WHERE NOT chg AND size_bytes IS NOT NULL AND seen_at - run_start >= INTERVAL 3 SECOND GROUP BY path, run_start)"""
OB = ("file_observations",)


@query("T1", _STABLE + " SELECT path, CAST(epoch_us(run_start) AS BIGINT) AS run_start, CAST(epoch_us(stable_at) AS BIGINT) AS stable_at, size_bytes FROM stable", OB)
def t1(spark, sf):
    runs = watch.stable_runs(view(spark, sf, "file_observations"))
    return runs.select("path", *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("run_start", "stable_at")], "size_bytes")


@query("T2", _STABLE + " SELECT source_file, 'processing/' || CASE WHEN k = 1 THEN source_file ELSE replace(source_file, '.tif', '') || '_' || lpad(CAST(k - 1 AS VARCHAR), 3, '0') || '.tif' END AS file_path, substr(source_file, 1, 8) AS drawing_no, '1' AS revision, 'watch_folder' AS source, strftime(stable_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM (SELECT *, replace(path, 'inbox/', '') AS source_file, row_number() OVER (PARTITION BY path ORDER BY stable_at) AS k FROM stable)", OB)
def t2(spark, sf):
    return watch.promoted(watch.stable_runs(view(spark, sf, "file_observations"))).select(
        "source_file", "file_path", "drawing_no", "revision", "source", *iso("created_at"))


_EDITS = """, sy AS (SELECT box_id, max(event_seq) FILTER (action IN ('unlock', 'reset')) AS ss, arg_max(action, event_seq) FILTER (action IN ('unlock', 'reset')) AS sa FROM edit_events GROUP BY box_id),
  cf AS (SELECT e.box_id, min(event_seq) AS cs FROM edit_events e JOIN sy USING (box_id) WHERE sa = 'unlock' AND event_seq > ss AND action = 'confirm' GROUP BY e.box_id),
  cm AS (SELECT e.box_id, arg_max({t: trim(text), x: x, y: y, w: w, h: h}, event_seq) AS c FROM edit_events e JOIN cf USING (box_id) WHERE action = 'commit' AND trim(text) <> '' AND event_seq > cs GROUP BY e.box_id),
  ed AS (SELECT sy.box_id, CASE WHEN sa IS NULL OR sa = 'reset' THEN 'locked' WHEN cs IS NULL THEN 'unlocked' WHEN c IS NULL THEN 'box_confirmed' ELSE 'text_committed' END AS state, c FROM sy LEFT JOIN cf USING (box_id) LEFT JOIN cm USING (box_id))"""


@query("T7", _EDITS + " SELECT box_id, state, c.t AS text FROM ed", ("edit_events",))
def t7(spark, sf):
    return jobs.committed_boxes(view(spark, sf, "edit_events")).select("box_id", "state", "text")


@query("T8", _EDITS + " SELECT * FROM (SELECT box_id, c.t AS text, CAST(round_even(c.x, 0) AS INTEGER) AS x, CAST(round_even(c.y, 0) AS INTEGER) AS y, CAST(round_even(c.w, 0) AS INTEGER) AS w, CAST(round_even(c.h, 0) AS INTEGER) AS h FROM ed WHERE state = 'text_committed') WHERE w > 0 AND h > 0", ("edit_events",))
def t8(spark, sf):
    return jobs.savable_boxes(jobs.committed_boxes(view(spark, sf, "edit_events")))


@query("U5", "SELECT DISTINCT path FROM file_observations WHERE seen_at < (SELECT min(seen_at) + (max(seen_at) - min(seen_at)) * 0.02 FROM file_observations) AND path NOT IN (SELECT path FROM file_observations WHERE seen_at > (SELECT min(seen_at) + (max(seen_at) - min(seen_at)) * 0.98 FROM file_observations))".replace("* 0.02", "/ 50").replace("min(seen_at) + (max(seen_at) - min(seen_at)) * 0.98", "max(seen_at) - (max(seen_at) - min(seen_at)) / 50"), OB)
def u5(spark, sf):
    obs = view(spark, sf, "file_observations").withColumn("us", F.unix_micros(F.col("seen_at").cast("timestamp")))
    lo, hi = obs.agg(F.min("us"), F.max("us")).first()
    part = (hi - lo) / 50
    return watch.vanished(obs.filter(F.col("us") < lo + part), obs.filter(F.col("us") > hi - part))


@query("U1", "SELECT page_id, seq, text FROM header_items WHERE lang = 'en' UNION ALL SELECT page_id, seq, text FROM header_items WHERE lang = 'ch'", ("header_items",))
def u1(spark, sf):
    found = view(spark, sf, "header_items")
    return found.filter("lang = 'en'").unionByName(found.filter("lang = 'ch'")).select("page_id", "seq", "text")


@query("U2", "SELECT page_id, 'text' AS kind, x1, y1, x2, y2 FROM ocr_items UNION ALL SELECT page_id, 'table', red_x, red_y, red_x + red_w, red_y + red_h FROM page_regions WHERE red_x IS NOT NULL AND NOT ((red_x + red_x + red_w) / 2.0 <= 300 + page_id % 300 AND (red_y + red_y + red_h) / 2.0 <= 150 + page_id % 200)",
       ("ocr_items", "page_regions"))
def u2(spark, sf):
    from drawmark.checks.geometry_queries import zones
    from drawmark.operators.regions import centre_outside_zone, region_box
    tables = view(spark, sf, "page_regions").filter("red_x IS NOT NULL").select("page_id", *region_box("red").columns())
    kept = centre_outside_zone(tables, zones(spark, sf)).withColumn("kind", F.lit("table"))
    return items(spark, sf).select("page_id", F.lit("text").alias("kind"), "x1", "y1", "x2", "y2").unionByName(kept)


@query("U4", "SELECT DISTINCT page_id, pos FROM line_segments WHERE level = 0 UNION SELECT page_id, pos FROM line_segments WHERE end_px - start_px >= 350", ("line_segments",))
def u4(spark, sf):
    s = view(spark, sf, "line_segments")
    return s.filter("level = 0").select("page_id", "pos").union(s.filter("end_px - start_px >= 350").select("page_id", "pos")).distinct()


@query("Q0_routing_summary", f"""SELECT format, method, matched, regions, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM (SELECT size_bytes, CASE {ext('file_name')} WHEN '.pdf' THEN 'pdf' WHEN '.tif' THEN 'tiff' WHEN '.tiff' THEN 'tiff' ELSE substr({ext('file_name')}, 2) END AS format, method,
   {num('upper(' + stem('file_name') + ')')} IS NOT NULL AS matched, CASE WHEN file_name LIKE 'Y%' THEN 'red green orange' WHEN file_name LIKE 'B%' THEN 'green orange' WHEN substr(file_name, 1, 1) IN ('P', 'G', 'O', 'J') THEN 'red' ELSE '' END AS regions FROM {_ROUTED}) GROUP BY ALL""", FILES)
def q0(spark, sf):
    from drawmark.operators.regions import REGIONS
    name = F.col("file_name")
    kept = F.concat_ws(" ", *[F.when(~names.suppresses(names.first_letter(name), r), F.lit(n)) for n, r in REGIONS.items()])
    return (files.routed(view(spark, sf, "drawing_files"))
            .select("size_bytes", names.file_format(name).alias("format"), "method", names.parsed_name(name)["matched"].alias("matched"), kept.alias("regions"))
            .groupBy("format", "method", "matched", "regions").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("size_bytes")))


@query("Q12", REPLACED + f""", rt AS {_ROUTED}, one AS (SELECT * FROM rt WHERE file_id = (SELECT min(file_id) FROM rt WHERE method = 'ocr' AND substr(file_name, 1, 1) NOT IN ('Y', 'B')))
   SELECT any_value(one.file_name) AS file_name, any_value(one.method) AS method, count(old_text) AS total, coalesce(string_agg(old_text || '>' || 'H' || old_text, ',' ORDER BY rank, seq, old_text), '') AS pairs FROM one LEFT JOIN rep ON page_id = file_id""", (*RV, "drawing_files"))
def q12(spark, sf):
    from drawmark.plans.drawings import single_result
    routed = files.routed(view(spark, sf, "drawing_files"))
    chosen = routed.filter((F.col("method") == "ocr") & ~F.substring("file_name", 1, 1).isin("Y", "B")).agg(F.min("file_id")).scalar()
    # the choice reaches the scans of all inputs
    every = replacements(spark, sf, lambda df: df.filter(F.col("page_id") == chosen))
    out = single_result(routed.filter(F.col("file_id") == chosen), every)
    return out.select("file_name", "method", "total", F.array_join(F.transform("replacements", lambda r: F.concat(r["old_text"], F.lit(">"), r["new_text"])), ",").alias("pairs"))


@query("Q12_scanned_pdf", REPLACED + f""", rt AS {_ROUTED}, one AS (SELECT * FROM rt WHERE file_id = (SELECT min(file_id) FROM rt WHERE method = 'ocr' AND file_name LIKE '%.pdf' AND substr(file_name, 1, 1) NOT IN ('Y', 'B')))
   SELECT any_value(one.file_name) AS file_name, any_value(one.method) AS method, count(old_text) AS total FROM one LEFT JOIN rep ON page_id = file_id""", (*RV, "drawing_files"))
def q12_scanned_pdf(spark, sf):
    """A PDF without text of its own went through recognition."""
    from drawmark.plans.drawings import single_result
    routed = files.routed(view(spark, sf, "drawing_files"))
    chosen = routed.filter((F.col("method") == "ocr") & F.col("file_name").endswith(".pdf") & ~F.substring("file_name", 1, 1).isin("Y", "B")).agg(F.min("file_id")).scalar()
    every = replacements(spark, sf, lambda df: df.filter(F.col("page_id") == chosen))
    return single_result(routed.filter(F.col("file_id") == chosen), every).select("file_name", "method", "total")
