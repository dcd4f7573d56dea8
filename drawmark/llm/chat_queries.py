"""Chat formatting of all conversations."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawmark.llm.chat import BUDGET, HISTORY, SEGMENT, chat_windows, loss_texts, read_turns
from drawmark.llm.queries import query, table

ODD = "\\### Assistant: </turn> ok"

_ESC = r"replace(regexp_replace({}, '([\\#])', '\\\1', 'g'), '</', '<\/')"
_LENGTH = r"(4 + length(replace(regexp_replace(role, '([\\#:\n])', '\\\1', 'g'), '</', '<\/')) + 2 + length(" + _ESC.format("text") + ") + 8)"

_BYTES = _LENGTH.replace("length(", "strlen(")


@query("op6_chat_format", sql=f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '{ODD}'), (-7, 1, 'assistant', '{ODD}'))),
rows AS (SELECT *, CAST(floor(turn / {SEGMENT}.0) AS BIGINT) AS segment, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
                {_BYTES} AS tokens, {_LENGTH} AS chars FROM raw),
systems AS (SELECT conv_id, tokens AS lead, chars AS lead_chars FROM rows WHERE n = 1 AND role = 'system'),
turns AS (SELECT r.*, coalesce(s.lead, 0) AS lead, coalesce(s.lead_chars, 0) AS lead_chars FROM rows r LEFT JOIN systems s USING (conv_id)
          WHERE NOT (r.n = 1 AND r.role = 'system')),
summed AS (SELECT *, sum(tokens) OVER w AS upto, sum(chars) OVER w AS chars_upto, row_number() OVER w AS i,
                  row_number() OVER (PARTITION BY conv_id, segment ORDER BY n) AS in_segment FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY n)),
-- with turn i as the first new one: tokens and characters before the window's first turn
heads AS (SELECT a.conv_id, a.i, a.segment, a.in_segment, a.upto, a.chars_upto, a.lead, a.lead_chars,
                 coalesce(min(b.upto - b.tokens), a.upto - a.tokens) AS before, coalesce(min(b.chars_upto - b.chars), a.chars_upto - a.chars) AS chars_before
          FROM summed a LEFT JOIN summed b ON b.conv_id = a.conv_id AND b.i < a.i AND b.i >= a.i - {HISTORY}
            AND (b.segment = a.segment OR b.segment = a.segment - 1 AND b.turn >= a.segment * {SEGMENT} - {HISTORY})
            AND a.upto - a.tokens - (b.upto - b.tokens) <= {BUDGET // 4} AND a.upto - (b.upto - b.tokens) + a.lead <= {BUDGET}
          GROUP BY a.conv_id, a.i, a.segment, a.in_segment, a.upto, a.chars_upto, a.lead, a.lead_chars, a.tokens, a.chars),
walk AS (
  SELECT conv_id, i, before, chars_before, true AS opens FROM heads WHERE i = 1
  UNION ALL
  SELECT h.conv_id, h.i, CASE WHEN o.opens THEN h.before ELSE w.before END, CASE WHEN o.opens THEN h.chars_before ELSE w.chars_before END, o.opens
  FROM walk w JOIN heads h ON h.conv_id = w.conv_id AND h.i = w.i + 1, LATERAL (SELECT h.in_segment = 1 OR h.upto - w.before + h.lead > {BUDGET} AS opens) o),
sizes AS (SELECT w.conv_id, w.chars_before, max(h.chars_upto) - w.chars_before + any_value(h.lead_chars) AS chars,
                 sum(CASE WHEN w.opens THEN 1 ELSE 0 END) AS n
          FROM walk w JOIN heads h USING (conv_id, i) GROUP BY w.conv_id, w.chars_before, w.before),
formatted AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM sizes GROUP BY conv_id)
SELECT r.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       coalesce(any_value(formatted_chars), any_value(lead_chars)) AS formatted_chars
FROM rows r LEFT JOIN formatted USING (conv_id) LEFT JOIN systems USING (conv_id) GROUP BY r.conv_id""")
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame([(-7, 0, "user", ODD), (-7, 1, "assistant", ODD)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    windows = chat_windows(turns)
    new = F.transform(F.slice(read_turns(F.col("text")), F.col("n_repeated") + 1, F.length("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = windows.select("conv_id", "segment", "window", F.size(new).alias("n"), F.array_join(new, "").alias("turns"),
                          F.array_join(loss_texts(F.col("text"), F.col("loss")), "").alias("loss"), F.length("text").alias("chars"))
    # the contract's digests are of whole conversations
    by_conv = back.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("segment", "window", "turns", "loss"))).alias("w"),
                                          F.sum("chars").alias("formatted_chars"))
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return by_conv.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["turns"]), ""), 256).alias("turns_sha256"),
                          F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
