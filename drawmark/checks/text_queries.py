"""Queries of the scalar text, name and display functions."""
from __future__ import annotations

from pyspark.sql import functions as F

from drawmark.checks.catalog import query
from drawmark.functions import display, names, readings, text
from drawmark.functions.boxes import Box
from drawmark.operators import items as item_ops
from drawmark.sources import spotting
from drawmark.sources.views import table, view


def num(t: str, chars: str = "YXBH") -> str:
    return (f"list_filter(regexp_extract_all({t}, '[{chars}][A-Z]*[0-9][A-Z0-9]*'), "
            f"lambda m: length(m) >= 7)[1]")


def token(t: str) -> str:
    return f"coalesce({num(f'upper({t})')}, 'Y' || substr({num(f'upper({t})', 'V')}, 2))"


def stem(n: str) -> str:
    return f"regexp_replace({n}, '[.][^.]*$', '')"


def ext(n: str) -> str:
    return f"lower(regexp_extract({n}, '[.][^.]*$'))"


def tr(v: str) -> str:
    return f"CAST(trunc({v}) AS INTEGER)"


def backfill(t: str) -> str:
    f = f"translate(replace({t}, ' ', ''), '/!|()' || chr(92), '111001')"
    good = "regexp_matches({0}, '^[YXBH][A-Z0-9]{{6,}}') AND regexp_matches(substr({0}, 2), '[0-9]')"
    y = f"'Y' || substr({f}, 2)"
    return (f"CASE WHEN NOT regexp_matches({f}, '^[A-Z0-9]*$') OR length({f}) < 5 THEN NULL "
            f"WHEN {good.format(f)} THEN {f} WHEN {f} LIKE 'T%' AND {good.format('(' + y + ')')} THEN {y} END")


REV = ("coalesce(nullif(regexp_extract(st, '[_-](?:Rev|REV|rev)([0-9A-Za-z]{1,4})', 1), ''), "
       "nullif(regexp_extract(st, '[_-]R([0-9]{1,3})($|[^A-Za-z])', 1), ''), "
       "nullif(regexp_extract(st, '(?i)[_-]v([0-9]{1,3})($|[^A-Za-z])', 1), ''), "
       "nullif(regexp_extract(st, '-([A-Z])($|[._])', 1), ''), 'N/A')")


@query("P1", f"SELECT page_id, seq, {num('text')} AS number, {num('text', 'K')} AS k_number FROM ocr_items", ("ocr_items",))
def p1(spark, sf):
    c = F.col("text")
    return view(spark, sf, "ocr_items").select("page_id", "seq", text.first_number(c).alias("number"),
                                               text.first_number(c, ["k"]).alias("k_number"))


@query("P2", f"SELECT doc_id AS id, 'document' AS src, {token('text')} AS token FROM documents "
             f"UNION ALL SELECT seq, 'item', {token('text')} FROM ocr_items", ("ocr_items",))
def p2(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("src"), "text")
    items = view(spark, sf, "ocr_items").select(F.col("seq").alias("id"), F.lit("item").alias("src"), "text")
    return docs.unionByName(items).select("id", "src", text.find_token(F.col("text")).alias("token"))


@query("P3", f"SELECT file_id, coalesce({num('upper(st)')}, st) AS drawing_no, {REV} AS revision, "
             f"{num('upper(st)')} IS NOT NULL AS matched FROM (SELECT file_id, {stem('file_name')} AS st FROM drawing_files)",
       ("drawing_files",))
def p3(spark, sf):
    parts = names.parsed_name(F.col("file_name"))
    return view(spark, sf, "drawing_files").select("file_id", *[c.alias(n) for n, c in parts.items()])


@query("P4", f"SELECT file_id, CASE {ext('file_name')} WHEN '.pdf' THEN 'pdf' WHEN '.tif' THEN 'tiff' WHEN '.tiff' THEN 'tiff' "
             f"WHEN '.jpg' THEN 'jpg' WHEN '.jpeg' THEN 'jpeg' WHEN '.png' THEN 'png' END AS format, "
             f"CASE WHEN {ext('file_name')} = '.txt' THEN 'unsupported: .txt' END AS error FROM drawing_files", ("drawing_files",))
def p4(spark, sf):
    fmt = names.file_format(F.col("file_name"))
    error = F.when(fmt.isNull(), F.concat(F.lit("unsupported: "), names.extension(F.col("file_name"))))
    return view(spark, sf, "drawing_files").select("file_id", fmt.alias("format"), error.alias("error"))


_TRIMMED = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


@query("P5", f"SELECT id, src, length(t) >= 50 AND length(regexp_replace(t, '[^\\x20-\\x7E\\n\\r\\t]', '', 'g')) / length(t) >= 0.3 AS is_vector, "
             f"length(t) > 50 AS is_vector_plain FROM (SELECT doc_id AS id, 'document' AS src, {_TRIMMED.format('text')} AS t FROM documents "
             f"UNION ALL SELECT file_id, 'file', {_TRIMMED.format('page_text')} FROM drawing_files)", ("drawing_files",))
def p5(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("src"), F.col("text").alias("t"))
    files = view(spark, sf, "drawing_files").select(F.col("file_id").alias("id"), F.lit("file").alias("src"), F.col("page_text").alias("t"))
    return docs.unionByName(files).select("id", "src", text.has_vector_text(F.col("t")).alias("is_vector"),
                                          text.has_vector_text(F.col("t"), ratio=None).alias("is_vector_plain"))


_VECTOR = (f"length({_TRIMMED.format('page_text')}) >= 50 AND length(regexp_replace({_TRIMMED.format('page_text')}, "
           f"'[^\\x20-\\x7E\\n\\r\\t]', '', 'g')) / length({_TRIMMED.format('page_text')}) >= 0.3")


@query("P6", f"SELECT file_id, CASE WHEN {ext('file_name')} = '.pdf' AND {_VECTOR} THEN 'vector' ELSE 'ocr' END AS method FROM drawing_files",
       ("drawing_files",))
def p6(spark, sf):
    return view(spark, sf, "drawing_files").select(
        "file_id", names.method_for(F.col("file_name"), text.has_vector_text(F.col("page_text"))).alias("method"))


# A span's code starts at the first prefix that no capital or digit precedes and that one follows.
_SPAN_CODE = "regexp_extract(text, '(^|[^A-Z0-9])([YXBH][A-Z0-9-][A-Za-z0-9-]*)', 2)"
_SPAN_AT = ("CASE WHEN regexp_matches(text, '^[YXBH][A-Z0-9-]') THEN 0 "
            "ELSE CAST(length(regexp_extract(text, '^(.*?[^A-Z0-9])[YXBH][A-Z0-9-]', 1)) AS INTEGER) END")


@query("P7", f"SELECT page_id, seq, code AS old_text, 'H' || code AS new_text, x1 + 10 * st AS x1, y1, "
             f"x1 + 10 * (st + CAST(length(code) AS INTEGER)) AS x2, y2 FROM "
             f"(SELECT *, {_SPAN_CODE} AS code, {_SPAN_AT} AS st FROM ocr_items) WHERE length(code) >= 7 AND seq % 3 <> 0", ("ocr_items",))
def p7(spark, sf):
    spans = item_ops.as_spans(view(spark, sf, "ocr_items"))
    return item_ops.span_codes(spans).select("page_id", "seq", "old_text", "new_text", "x1", "y1", "x2", "y2")


@query("P8", f"SELECT page_id, seq, {backfill('upper(text)')} AS fixed FROM ocr_items", ("ocr_items",))
def p8(spark, sf):
    return view(spark, sf, "ocr_items").select("page_id", "seq", text.backfill_symbols(F.upper("text")).alias("fixed"))


_REPAIR = ("CASE WHEN length({0}) >= 6 AND regexp_matches({0}, '^\\p{{L}}') THEN substr({0}, 1, 2) || translate(substr({0}, 3, 3), 'IOSBZGTQD', '105826700') "
           "|| substr({0}, 6, 1) || translate(substr({0}, 7), 'IOSBZGTQD', '105826700') ELSE {0} END")


@query("P9", f"SELECT page_id, seq, {_REPAIR.format('t')} AS fixed FROM (SELECT page_id, seq, translate(replace(text, ' ', ''), '158', 'ISB') AS t FROM ocr_items)",
       ("ocr_items",))
def p9(spark, sf):
    noisy = F.translate(text.no_spaces(F.col("text")), "158", "ISB")
    return view(spark, sf, "ocr_items").select("page_id", "seq", text.repair_digits(noisy).alias("fixed"))


@query("P10", "SELECT page_id, seq, length(trim(text)) >= 9 AND regexp_matches(trim(text), '[\\p{L}\\p{N}]$') AS accepted FROM ocr_items", ("ocr_items",))
def p10(spark, sf):
    return view(spark, sf, "ocr_items").select("page_id", "seq", text.accepted(F.col("text")).alias("accepted"))


@query("P11", f"SELECT page_id, tok AS token, min(seq) AS first_seq FROM (SELECT page_id, seq, {token('text')} AS tok FROM ocr_items) "
              f"WHERE tok IS NOT NULL GROUP BY page_id, tok", ("ocr_items",))
def p11(spark, sf):
    return item_ops.distinct_tokens(view(spark, sf, "ocr_items"))


_NORM = "translate(replace(upper({0}), ' ', ''), 'OISZB', '01528')"


@query("P12", f"SELECT page_id, seq, {_NORM.format('text')} AS norm, coalesce({_NORM.format('text')} = {_NORM.format('tok')} OR "
              f"(tok LIKE 'Y%' AND {_NORM.format('text')} = {_NORM.format(chr(39) + 'V' + chr(39) + ' || substr(tok, 2)')}), false) AS exact, "
              f"coalesce(contains({_NORM.format('text')}, {_NORM.format('tok')}) OR (tok LIKE 'Y%' AND contains({_NORM.format('text')}, "
              f"{_NORM.format(chr(39) + 'V' + chr(39) + ' || substr(tok, 2)')})), false) AS within "
              f"FROM (SELECT *, {token('text')} AS tok FROM ocr_items)", ("ocr_items",))
def p12(spark, sf):
    items = view(spark, sf, "ocr_items").withColumn("tok", text.find_token(F.col("text")))
    t, k = F.col("text"), F.col("tok")
    return items.select("page_id", "seq", text.compare_form(t).alias("norm"),
                        F.coalesce(text.reads_as(t, k), F.lit(False)).alias("exact"),
                        F.coalesce(text.reads_within(t, k), F.lit(False)).alias("within"))


@query("P13", f"SELECT page_id, seq, unnest(CASE WHEN length(s) >= 7 AND regexp_matches(s, '^[YXBH][A-Z0-9]{{6,}}$') AND regexp_matches(substr(s, 2), '[0-9]') "
              f"THEN [tok, s] ELSE [tok] END) AS candidate FROM (SELECT *, substr(tok, 1, length(tok) - 1) AS s FROM "
              f"(SELECT page_id, seq, {token('text')} AS tok FROM ocr_items)) WHERE tok IS NOT NULL", ("ocr_items",))
def p13(spark, sf):
    items = view(spark, sf, "ocr_items").withColumn("tok", text.find_token(F.col("text"))).filter("tok IS NOT NULL")
    return items.select("page_id", "seq", F.explode(text.token_candidates(F.col("tok"))).alias("candidate"))


_BS = "chr(92)"
_CLEAN = ("CASE WHEN contains({0}, chr(92)) THEN trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, "
          "'\\\\[()\\[\\]]', '', 'g'), '_\\{{([^}}]*)\\}}', '\\1', 'g'), '\\^\\{{([^}}]*)\\}}', '\\1', 'g'), '\\\\[a-zA-Z]+', '', 'g'), '[{{}}]', '', 'g')) ELSE {0} END")


@query("P14", f"SELECT text_id, {_CLEAN.format('text')} AS cleaned FROM markup_text", ("markup_text",))
def p14(spark, sf):
    return view(spark, sf, "markup_text").select("text_id", text.clean_markup(F.col("text")).alias("cleaned"))


def _spot_sql(w: str, h: str, back: str) -> str:
    corner = "CAST(trunc({f}(x) {back}) AS INTEGER)"
    nums = "list_transform(regexp_extract_all(m, 'LOC_([0-9]+)', 1), lambda v: CAST(v AS DOUBLE) / 1000)"
    return f"""
    , hits AS (SELECT page_id, {w} AS w, {h} AS h, unnest(regexp_extract_all(raw, '[^\\n<]+?(?:<\\|LOC_[0-9]+\\|>){{8}}')) AS m,
        generate_subscripts(regexp_extract_all(raw, '[^\\n<]+?(?:<\\|LOC_[0-9]+\\|>){{8}}'), 1) AS i FROM spotting_raw),
    keyed AS (SELECT *, trim(regexp_extract(m, '^[^\\n<]+')) AS t, regexp_extract(m, '<.*$') AS locs FROM hits),
    flagged AS (SELECT *, row_number() OVER (PARTITION BY page_id, t, locs ORDER BY i) > 1 AS dup FROM keyed),
    runs AS (SELECT *, i - row_number() OVER (PARTITION BY page_id, dup ORDER BY i) AS grp FROM flagged),
    cut AS (SELECT page_id, min(i) AS stop_at FROM (SELECT page_id, i, row_number() OVER (PARTITION BY page_id, grp ORDER BY i) AS k FROM runs WHERE dup) WHERE k >= 3 GROUP BY page_id)
    SELECT page_id, CAST(i - 1 AS INTEGER) AS item, t AS text,
      CAST(trunc(CAST(trunc(least(n[1], n[3], n[5], n[7]) * w) AS INTEGER) * {back}) AS INTEGER) AS x1,
      CAST(trunc(CAST(trunc(least(n[2], n[4], n[6], n[8]) * h) AS INTEGER) * {back}) AS INTEGER) AS y1,
      CAST(trunc(CAST(trunc(greatest(n[1], n[3], n[5], n[7]) * w) AS INTEGER) * {back}) AS INTEGER) AS x2,
      CAST(trunc(CAST(trunc(greatest(n[2], n[4], n[6], n[8]) * h) AS INTEGER) * {back}) AS INTEGER) AS y2
    FROM (SELECT f.*, {nums} AS n, c.stop_at FROM runs f LEFT JOIN cut c USING (page_id)) WHERE NOT dup AND (stop_at IS NULL OR i < stop_at)"""


@query("P15", _spot_sql("img_w", "img_h", "1"), ("spotting_raw",))
def p15(spark, sf):
    return spotting.located_texts(view(spark, sf, "spotting_raw"))


_UP = "(img_w < 1500 AND img_h < 1500)"


@query("P16", _spot_sql(f"CASE WHEN {_UP} THEN 2 * img_w ELSE img_w END", f"CASE WHEN {_UP} THEN 2 * img_h ELSE img_h END",
                        "(CASE WHEN w = 2 * (SELECT any_value(s.img_w) FROM spotting_raw s WHERE s.page_id = f2.page_id) THEN 0.5 ELSE 1 END)"
                        ).replace("LEFT JOIN cut c USING (page_id))", "LEFT JOIN cut c USING (page_id)) f2"), ("spotting_raw",))
def p16(spark, sf):
    return spotting.read_pages(view(spark, sf, "spotting_raw"))


@query("P17", """SELECT page_id, CAST(i - 1 AS INTEGER) AS item, 'T' || CAST(page_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS text,
    CASE WHEN page_id % 5 = 0 THEN 1.0 ELSE i / 8 END AS conf, CAST(i * 10 AS INTEGER) AS x1, CAST(i * 7 AS INTEGER) AS y1
    FROM (SELECT page_id, unnest(range(1, CAST(least(page_id % 3 + 1, page_id % 4) AS INTEGER) + 1)) AS i FROM page_sizes WHERE page_id % 7 <> 0)""", ("page_sizes",))
def p17(spark, sf):
    raw = item_ops.sample_results(view(spark, sf, "page_sizes"))
    out = item_ops.result_rows(raw)
    return out.select("page_id", "item", "text", "conf", F.expr("CAST(poly[0][0] AS INT)").alias("x1"),
                      F.expr("CAST(poly[0][1] AS INT)").alias("y1"))


_TIGHT = f"""SELECT page_id, seq, m AS number,
  CASE WHEN length(t) > length(m) THEN lx ELSE x1 END AS x1, y1,
  CASE WHEN length(t) > length(m) THEN lx + least({tr('length(m) * cw')} + 2 * pad, x2 - tx + pad) ELSE x2 END AS x2, y2
  FROM (SELECT *, greatest(0, tx - pad) AS lx FROM (SELECT *, x1 + {tr('(strpos(t, m) - 1) * cw')} AS tx, greatest({tr('cw * 0.3')}, 3) AS pad FROM
  (SELECT *, {num('t')} AS m, (x2 - x1) / length(t) AS cw FROM (SELECT *, replace(upper(text), ' ', '') AS t FROM ocr_items)) WHERE m IS NOT NULL))"""


@query("P25", _TIGHT, ("ocr_items",))
def p25(spark, sf):
    return item_ops.tight_numbers(view(spark, sf, "ocr_items"))


@query("P26", f"SELECT page_id, seq, substr(text, 1, CAST(greatest(1, least({tr('(vx - x1) / ((x2 - x1) / length(text))')}, length(text))) AS INTEGER)) AS trimmed, "
              f"x1, y1, x1 + greatest(vx - x1 - 2, 1) AS x2, y2 FROM (SELECT *, x2 - 20 - CAST(seq % 40 AS INTEGER) AS vx FROM ocr_items)", ("ocr_items",))
def p26(spark, sf):
    items = view(spark, sf, "ocr_items").withColumn("vx", F.col("x2") - 20 - (F.col("seq") % 40).cast("int"))
    trimmed, box = readings.trim_at_line(F.col("text"), Box.corners(), F.col("vx"))
    return items.select("page_id", "seq", trimmed.alias("trimmed"), *box.columns())


@query("P27", f"""SELECT page_id, seq, room, x1, top AS y1, least(x2 + room, 1000) AS x2, least(top + (y2 - y1) + 2 * rise, 500) AS y2 FROM
    (SELECT *, least({tr('(x2 - x1) / length(text) * 2.5')}, 1000 - x2) AS room, {tr('(y2 - y1) * 0.5')} AS rise,
     greatest(0, y1 - {tr('(y2 - y1) * 0.5')}) AS top FROM ocr_items) WHERE room > 0""", ("ocr_items",))
def p27(spark, sf):
    room, box = readings.widened(F.col("text"), Box.corners(), F.lit(1000), F.lit(500))
    return (view(spark, sf, "ocr_items").select("page_id", "seq", room.alias("room"), *box.columns()).filter("room > 0"))


@query("P28", f"""SELECT page_id, CASE WHEN nx > red_x AND red_x + red_w - nx > 0 THEN nx ELSE red_x END AS x1, red_y AS y1,
    red_x + red_w AS x2, red_y + red_h AS y2 FROM page_regions LEFT JOIN
    (SELECT page_id, arg_min(CASE WHEN length(t) <= p THEN x2 ELSE {tr('x1 + (x2 - x1) * (p / length(t))')} END, seq) AS nx FROM
      (SELECT *, CASE WHEN t LIKE 'DWGNO%' THEN 5 ELSE 3 END AS p FROM (SELECT *, replace(upper(text), ' ', '') AS t FROM ocr_items) WHERE t LIKE 'DWG%')
     GROUP BY page_id) USING (page_id) WHERE red_x IS NOT NULL""", ("ocr_items", "page_regions"))
def p28(spark, sf):
    columns = view(spark, sf, "page_regions").filter("red_x IS NOT NULL").select(
        "page_id", *Box.sized(*[F.col(f"red_{c}") for c in "xywh"]).columns())
    return item_ops.shift_left_edge(columns, view(spark, sf, "ocr_items"))


_LABEL_SQL = f"""
  , lab AS (SELECT *, skip0 + length(regexp_extract(substr(up, CAST(skip0 + 1 AS INTEGER)), '^[ .]*')) AS skip FROM (SELECT *, upper(text) AS up, CASE WHEN upper(text) LIKE 'DWG NO.%' THEN 7
     WHEN upper(text) LIKE 'DWG NO%' THEN 6 WHEN upper(text) LIKE 'DWGNO%' THEN 5 WHEN upper(text) LIKE 'DWG%' THEN 3 ELSE 0 END AS skip0 FROM ocr_items WHERE upper(text) LIKE 'DWG%')),
  part1 AS (SELECT *, substr(up, CAST(skip + 1 AS INTEGER)) AS rest, replace(substr(up, CAST(skip + 1 AS INTEGER)), ' ', '') AS joined FROM lab),
  part2 AS (SELECT *, {num('joined')} AS plain, {backfill('joined')} AS fixed FROM part1),
  part3 AS (SELECT *, coalesce(plain, {num('fixed')}) AS number, CASE WHEN plain IS NOT NULL THEN strpos(joined, plain) - 1 ELSE strpos(fixed, {num('fixed')}) - 1 END AS st FROM part2),
  part4 AS (SELECT *, skip + length(regexp_extract(rest, '^(?: *[^ ]){{' || CAST(st AS VARCHAR) || '}}')) AS off FROM part3 WHERE number IS NOT NULL)
"""


@query("P29", _LABEL_SQL + f"""SELECT page_id, seq, number, CAST(off AS INTEGER) AS char_offset, {tr('nx')} AS x1, y1, {tr('nx')} + greatest({tr('x2 - nx')}, 1) AS x2, y1 + greatest(y2 - y1, 1) AS y2
   FROM (SELECT *, x1 + (x2 - x1) * (off / length(up)) AS nx FROM part4)""", ("ocr_items",))
def p29(spark, sf):
    return item_ops.labelled_numbers(view(spark, sf, "ocr_items")).select(
        "page_id", "seq", "number", "char_offset", "x1", "y1", "x2", "y2")


_CW9 = "(greatest(x2 - x1, 1) / greatest(length(replace(text, ' ', '')), 1))"


@query("P30", f"SELECT page_id, seq, x2 + {tr(_CW9 + ' * 0.5')} AS x1, y1, x2 + {tr(_CW9 + ' * 0.5')} + {tr(_CW9 + ' * 9')} AS x2, "
              f"y1 + greatest(y2 - y1, 1) AS y2 FROM ocr_items WHERE text LIKE 'DWG%'", ("ocr_items",))
def p30(spark, sf):
    box = readings.estimated_number_box(F.col("text"), Box.corners())
    return view(spark, sf, "ocr_items").filter(F.col("text").startswith("DWG")).select("page_id", "seq", *box.columns())


_INDEP = (f"CASE WHEN NOT (u LIKE 'DWG%' OR u LIKE 'OWG%' OR u LIKE '図%' OR u LIKE '图%') THEN coalesce(CASE WHEN length({num('j')}) >= length({num('u')}) "
          f"THEN {num('j')} END, {num('u')}, {num('j')}, {num('(' + backfill('j') + ')')}) END")


@query("P31", f"""SELECT page_id, arg_min(number, seq) AS number, min(seq) AS seq, arg_min(x2 - x1 > 0 AND y2 - y1 > 3 * (x2 - x1), seq) AS vertical FROM
    (SELECT *, {_INDEP} AS number FROM (SELECT *, trim(upper(text)) AS u, replace(trim(upper(text)), ' ', '') AS j FROM ocr_items)) WHERE number IS NOT NULL GROUP BY page_id""",
       ("ocr_items",))
def p31(spark, sf):
    return item_ops.first_independent(view(spark, sf, "ocr_items")).select("page_id", "number", "seq", "vertical")


@query("P32", f"""SELECT page_id, arg_min(number, seq) AS number, min(seq) AS seq, arg_min(CASE WHEN st > 0 THEN {tr('nx')} ELSE x1 END, seq) AS x1, arg_min(y1, seq) AS y1,
    arg_min(CASE WHEN st > 0 THEN {tr('nx')} + greatest({tr('x2 - nx')}, 1) ELSE x2 END, seq) AS x2, arg_min(y2, seq) AS y2 FROM
    (SELECT *, x1 + (x2 - x1) * (st / tot) AS nx FROM (SELECT *, coalesce(a, b, c) AS number,
      CASE WHEN a IS NOT NULL THEN strpos(u, a) - 1 WHEN b IS NOT NULL THEN strpos(j, b) - 1 ELSE strpos(f, c) - 1 END AS st,
      CASE WHEN a IS NOT NULL THEN length(u) ELSE length(j) END AS tot FROM
      (SELECT *, {num('u')} AS a, nullif(regexp_extract(j, 'Y[A-Z0-9][A-Z0-9-]{{2,}}'), '') AS b, {num('f')} AS c FROM
        (SELECT *, {backfill('j')} AS f FROM (SELECT *, trim(upper(text)) AS u, replace(trim(upper(text)), ' ', '') AS j FROM ocr_items)))) WHERE number IS NOT NULL) GROUP BY page_id""",
       ("ocr_items",))
def p32(spark, sf):
    return item_ops.first_fallback(view(spark, sf, "ocr_items"))


_LOOSE = "nullif(regexp_extract(t, '[YXBH][A-Z][0-9][A-Z0-9]{3,}'), '')"


@query("P33", f"""SELECT page_id, seq, code, CASE WHEN regexp_matches(code, '^[YXBH][A-Z][0-9]{{2,3}}[A-Z][0-9]{{2,4}}') THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END AS confidence,
    {tr('x1 + (strpos(t, code) - 1) * ((x2 - x1) / length(t))')} AS x1, y1, {tr('x1 + (strpos(t, code) - 1 + length(code)) * ((x2 - x1) / length(t))')} AS x2, y2
    FROM (SELECT *, {_LOOSE} AS code FROM (SELECT *, replace(upper(text), ' ', '') AS t FROM ocr_items)) WHERE code IS NOT NULL""", ("ocr_items",))
def p33(spark, sf):
    code, confidence, box = readings.note_code(F.col("text"), Box.corners())
    return view(spark, sf, "ocr_items").select("page_id", "seq", code.alias("code"), confidence.alias("confidence"),
                                               *box.columns()).filter("code IS NOT NULL")


@query("P34", f"SELECT page_id, seq, x1, y1, x1 + {tr('(x2 - x1) / length(text)')} AS x2, y2 FROM ocr_items", ("ocr_items",))
def p34(spark, sf):
    return view(spark, sf, "ocr_items").select("page_id", "seq", *readings.first_char_box(F.col("text"), Box.corners()).columns())


CELL_TEXT = ("CASE WHEN upper(substr(s, 1, 1)) IN ('Y', 'X', 'B', 'H') THEN s WHEN upper(substr(s, 1, 1)) = 'T' AND length(s) >= 5 THEN 'Y' || substr(s, 2) END")


@query("P35", f"SELECT page_id, seq, {CELL_TEXT} AS cell_text FROM (SELECT *, replace(text, ' ', '') AS s FROM ocr_items)", ("ocr_items",))
def p35(spark, sf):
    return view(spark, sf, "ocr_items").select("page_id", "seq", text.prefixed_cell(F.col("text")).alias("cell_text"))


BALLOT = ("CASE WHEN regexp_matches(replace(upper({0}), ' ', ''), '^[YXBH][A-Z0-9]{{4,}}$') THEN replace(upper({0}), ' ', '') END")


@query("P36", f"SELECT page_id, {BALLOT.format('green_text')} AS green, {BALLOT.format('orange_text')} AS orange FROM page_regions", ("page_regions",))
def p36(spark, sf):
    return view(spark, sf, "page_regions").select("page_id", text.ballot(F.col("green_text")).alias("green"),
                                                  text.ballot(F.col("orange_text")).alias("orange"))


@query("P37", f"SELECT page_id, seq, {num('text')} AS old_text, 'H' || {num('text')} AS new_text FROM ocr_items", ("ocr_items",))
def p37(spark, sf):
    number = text.first_number(F.col("text"))
    return view(spark, sf, "ocr_items").select("page_id", "seq", number.alias("old_text"), text.rewritten(number).alias("new_text"))


@query("P39", "SELECT page_id, seq, regexp_matches('H' || text, 'H[A-Z][A-Z0-9][A-Z0-9-]{2,}') AS is_output FROM ocr_items", ("ocr_items",))
def p39(spark, sf):
    return view(spark, sf, "ocr_items").select("page_id", "seq", text.is_output_token(text.rewritten(F.col("text"))).alias("is_output"))


@query("P40", "SELECT job_id, CASE WHEN method = 'ocr' THEN 'O' ELSE 'N' END AS ocr_flag, CASE WHEN method = 'vector' THEN 'PDF Replacement' ELSE 'VLMOCR' END AS label FROM job_log",
       ("job_log",))
def p40(spark, sf):
    return view(spark, sf, "job_log").select("job_id", names.ocr_flag(F.col("method")).alias("ocr_flag"),
                                             names.method_label(F.col("method")).alias("label"))


_MS = "CAST(CAST(floor(seconds) AS BIGINT) // 60 AS VARCHAR) || 'm ' || lpad(CAST(CAST(floor(seconds) AS BIGINT) % 60 AS VARCHAR), 2, '0') || 's'"


@query("P41", f"SELECT job_id, {_MS} AS duration FROM job_log", ("job_log",))
def p41(spark, sf):
    return view(spark, sf, "job_log").select("job_id", display.minutes_seconds(F.col("seconds")).alias("duration"))


RSTEM = "regexp_replace(regexp_replace(regexp_replace(name, '[.][^.]*$', ''), '^H', ''), '-R$', '')"
RORIG = f"{RSTEM} || CASE WHEN lower(regexp_extract(name, '[.][^.]*$')) IN ('.tif', '.tiff') THEN regexp_extract(name, '[.][^.]*$') ELSE '.tif' END"


@query("P42", f"SELECT name, {RSTEM} AS stem, {RORIG} AS original_name, regexp_matches(name, '^H.*-R[.](?i:tiff?)$') AS is_replaced FROM replaced_files", ("replaced_files",))
def p42(spark, sf):
    n = F.col("name")
    return view(spark, sf, "replaced_files").select("name", names.replaced_stem(n).alias("stem"),
                                                    names.original_name(n).alias("original_name"),
                                                    names.is_replaced_name(n).alias("is_replaced"))


@query("P48", "SELECT conv_id, turn, coalesce(nullif(trim(substr(regexp_replace(regexp_replace(text, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '[^A-Za-z0-9._-]+', '_', 'g'), 1, 32), '_.'), ''), 'hit') AS tag FROM conversations")
def p48(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", names.safe_tag(F.col("text")).alias("tag"))


@query("P49", "SELECT file_id, file_name FROM drawing_files WHERE contains(lower(file_name), 'ya0') OR contains(lower(folder), 'ya0')", ("drawing_files",))
def p49(spark, sf):
    return view(spark, sf, "drawing_files").filter(display.found_in("Ya0", F.col("file_name"), F.col("folder"))).select("file_id", "file_name")


@query("P51", "SELECT file_id, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN printf('%.0f', round(b / 1024, 0)) || ' KB' "
              "ELSE printf('%.1f', round(b / 1048576, 1)) || ' MB' END AS size_text FROM (SELECT file_id, size_bytes * CASE file_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 0 END + file_id % 1500 AS b FROM drawing_files)",
       ("drawing_files",))
def p51(spark, sf):
    size = F.expr("size_bytes * CASE file_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 0 END + file_id % 1500")
    return view(spark, sf, "drawing_files").select("file_id", display.byte_size(size).alias("size_text"))


@query("P52", "SELECT file_id, CASE WHEN file_id % 3 = 0 THEN '' WHEN file_id % 3 = 1 THEN 'C:' || chr(92) || 'in' || chr(92) || folder ELSE 'data/' || folder END AS parent FROM drawing_files",
       ("drawing_files",))
def p52(spark, sf):
    path = F.expr("CASE WHEN file_id % 3 = 0 THEN '/' || file_name WHEN file_id % 3 = 1 THEN concat_ws(chr(92), 'C:', 'in', folder, file_name)"
                  " ELSE concat('/data//', folder, '/', file_name) END")
    return view(spark, sf, "drawing_files").select("file_id", names.parent_folder(path).alias("parent"))


@query("P53", "SELECT event_id, CASE WHEN value < 50 THEN 'emerald' WHEN value < 80 THEN 'amber' ELSE 'rose' END AS temperature, "
              "CASE WHEN value < 30 THEN 'emerald' WHEN value < 70 THEN 'amber' ELSE 'rose' END AS load, printf('%.1f', round(event_id % 24000 / 24576 * 100, 1)) AS mem_pct FROM events")
def p53(spark, sf):
    pct = F.col("event_id") % 24000 / 24576 * 100
    return table(spark, sf, "events").select(
        "event_id", display.temperature_band(F.col("value")).alias("temperature"),
        display.load_band(F.col("value")).alias("load"), display.fixed_decimals(pct, 1).alias("mem_pct"))


@query("P54", f"SELECT job_id, CASE WHEN tot = 0 THEN 0 ELSE CAST(floor(CASE phase WHEN 'processing' THEN cur / tot WHEN 'warming_up' THEN 0.05 ELSE 0.02 END * 100 + 0.5) AS INTEGER) END AS progress, {_MS} AS elapsed "
              f"FROM (SELECT *, CASE job_id % 3 WHEN 0 THEN 'processing' WHEN 1 THEN 'warming_up' ELSE 'idle' END AS phase, total AS cur, total + CAST(job_id % 4 AS INTEGER) AS tot FROM job_log)",
       ("job_log",))
def p54(spark, sf):
    phase = F.expr("CASE job_id % 3 WHEN 0 THEN 'processing' WHEN 1 THEN 'warming_up' ELSE 'idle' END")
    total = F.expr("total + CAST(job_id % 4 AS INT)")
    return view(spark, sf, "job_log").select(
        "job_id", display.shown_progress(phase, F.col("total"), total).alias("progress"),
        display.minutes_seconds(F.col("seconds")).alias("elapsed"))
