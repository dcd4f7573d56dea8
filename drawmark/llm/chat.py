"""Chat formatting in budgeted windows.

A conversation's turns, in order, are cut into windows of at most ``budget`` tokens. Prefix sums of the turns' tokens
choose the spans: a window takes new turns as long as they fit. Every window starts with the conversation's system
turn (its first turn, if that has the system role), then repeats the turns before its first new one (at most
``history`` turns and a quarter of the budget, none if the first new turn would not fit then), then has its new turns.
The loss mask covers the assistant texts among the new turns, so each is a target exactly once. A turn too long for
the budget is a window by itself, marked as over the budget.

Turns are gathered by (conversation, segment of ``SEGMENT`` turn numbers), so a conversation of any length is many
groups of bounded size; windows end where segments do, and the last ``history`` turn numbers of a segment are sent on
to the next one for repeating.

Template: each turn is ``### role:``, a line feed, the text, ``</turn>`` and a line feed. Within texts and roles ``\\`` and
``#`` and the slash of ``</`` get a backslash in front (in roles also ``:`` and line feeds), so no control string is left
in them; taking away one backslash before each escaped character restores them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET, HISTORY, SEGMENT = 2048, 2, 256
ASSISTANT, SYSTEM = "assistant", "system"
TURN_TOKENS = 4  # of a turn's markers, where a column counts its text
END = "</turn>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#]|(?<=<)/)", r"\\$1")


def escaped_role(role: Column) -> Column:
    return F.regexp_replace(role, "([\\\\#:\n]|(?<=<)/)", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _header(role: Column) -> Column:
    return F.concat(F.lit("### "), escaped_role(role), F.lit(":\n"))


def most_tokens(role: Column, text: Column) -> Column:
    """Bytes of a formatted turn: no vocabulary of bytes and their merges makes more tokens of it."""
    return F.octet_length(F.concat(_header(role), escaped(text), F.lit(END))).cast("bigint")


def _segments(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, tokens_col: str | None, history: int, segment: int) -> DataFrame:
    """(conv_id, segment, first_turn, turns): sorted turns of each segment, those sent on from the one before marked old."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    tokens = F.coalesce(F.col(f"`{tokens_col}`").cast("bigint"), F.lit(0)) + TURN_TOKENS if tokens_col else most_tokens(role, text)
    turn = F.struct(F.coalesce(F.col(f"`{turn_col}`").cast("bigint"), F.lit(-1)).alias("turn"), role.alias("role"),
                    text.alias("text"), tokens.alias("tokens"))
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), turn.alias("t"))
    firsts = rows.groupBy("conv_id").agg(F.min("t").alias("first_turn")).withColumnRenamed("conv_id", "_conv")
    at = F.floor(F.col("t.turn") / segment).cast("bigint")
    own = F.struct(at.alias("segment"), F.lit(False).alias("old"))
    sent = F.struct((at + 1).alias("segment"), F.lit(True).alias("old"))
    late = F.pmod(F.col("t.turn"), F.lit(segment)) >= segment - history
    placed = rows.select("conv_id", "t", F.explode(F.when(late, F.array(own, sent)).otherwise(F.array(own))).alias("p"))
    gathered = placed.groupBy("conv_id", F.col("p.segment").alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("t.turn", "t.role", "t.text", "t.tokens", F.col("p.old").alias("old")))).alias("turns"))
    real = gathered.filter(F.exists("turns", lambda t: ~t["old"]))
    return real.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "segment", "first_turn", "turns")


def chat_windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 tokens_col: str | None = None, budget: int = BUDGET, history: int = HISTORY, segment: int = SEGMENT) -> DataFrame:
    """One row per window: conv_id, segment, window (numbered within the segment), text (formatted), n_repeated (turns
    at its head that an earlier window had as new ones), loss (spans of the text in code points: begin, end excluded),
    n_tokens, over_budget.

    Without ``tokens_col`` a turn counts as its bytes, so a window that is not marked fits the budget under any tokenizer
    of byte-level pairs.

    Turns are ordered by turn number, then role, then text; a null turn number is -1, null roles and texts are empty, null
    token counts 0. Repeated rows are turns of their own. Rows without a conversation id form one conversation. No rows
    give no windows."""
    n0 = F.lit(0).cast("bigint")
    groups = _segments(turns, conv_col, turn_col, role_col, text_col, tokens_col, history, segment)
    has_system = F.col("first_turn.role") == SYSTEM
    in_first = F.floor(F.col("first_turn.turn") / segment).cast("bigint") == F.col("segment")
    # the system turn leads every window; elsewhere it is neither a turn nor history
    is_system = lambda t: (t["turn"] == F.col("first_turn.turn")) & (t["role"] == F.col("first_turn.role")) & (t["text"] == F.col("first_turn.text"))
    fresh_first = F.slice("turns", 2, F.greatest(F.size("turns"), F.lit(1)))
    rest = F.when(has_system & in_first, fresh_first).when(has_system, F.filter("turns", lambda t: ~(t["old"] & is_system(t)))).otherwise(F.col("turns"))
    groups = groups.select("conv_id", "segment", "first_turn", (has_system & in_first).alias("starts"), has_system.alias("led"), rest.alias("turns"))
    groups = groups.withColumn("lead", F.when(F.col("led"), F.col("first_turn.tokens")).otherwise(n0))
    # sums[i]: tokens of the first i turns
    groups = groups.withColumn("sums", F.aggregate("turns", F.array(n0), lambda a, t: F.array_append(a, F.element_at(a, -1) + t["tokens"])))
    total = lambda i: F.get(F.col("sums"), i)
    # heads[i]: with turn i (from 0) as the first new one, the first turn of the window
    numbers = F.when(F.size("turns") > 0, F.sequence(F.lit(0), F.size("turns") - 1)).otherwise(F.array().cast("array<int>"))
    back = F.sequence(F.lit(1), F.lit(max(history, 1)))
    groups = groups.withColumn("heads", F.transform(numbers, lambda i: i - F.size(F.filter(back, lambda k: (k <= F.least(i, F.lit(history))) & (
        total(i) - total(i - k) <= budget // 4) & (total(i + 1) - total(i - k) + F.col("lead") <= budget)))))
    fresh = F.filter(numbers, lambda i: ~F.get(F.col("turns"), i)["old"])
    groups = groups.withColumn("starts_at", F.aggregate(fresh, F.array().cast("array<int>"), lambda a, i: F.when(
        (F.size(a) == 0) | (total(i + 1) - total(F.get(F.col("heads"), F.element_at(F.when(F.size(a) > 0, a).otherwise(F.array(F.lit(0))), -1))) + F.col("lead") > budget),
        F.array_append(a, i)).otherwise(a)))
    # a conversation of a system turn alone is a window without turns
    cuts = F.when((F.size("starts_at") == 0) & F.col("starts"), F.array(F.lit(0))).otherwise(F.col("starts_at"))
    windows = groups.select("*", F.posexplode(cuts).alias("window", "new"))
    last = F.coalesce(F.get(F.col("starts_at"), F.col("window") + 1), F.size("turns"))
    head = F.coalesce(F.get(F.col("heads"), F.col("new")), F.lit(0))
    begins = F.col("starts") & (F.col("window") == 0)
    lead = F.when(F.col("led"), F.array(F.struct(F.col("first_turn.role").alias("role"), F.col("first_turn.text").alias("text")))).otherwise(
        F.array().cast("array<struct<role:string,text:string>>"))
    shown = F.concat(lead, F.transform(F.slice("turns", head + 1, F.greatest(last - head, F.lit(0))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    windows = windows.select("conv_id", "segment", "window", (total(last) - total(head) + F.col("lead")).alias("n_tokens"),
                             (F.col("new") - head + F.when(F.col("led") & ~begins, 1).otherwise(0)).alias("n_repeated"), shown.alias("shown"))
    parts = F.transform("shown", lambda t: F.struct(_header(t["role"]).alias("header"), escaped(t["text"]).alias("body"), (t["role"] == ASSISTANT).alias("target")))
    windows = windows.select("conv_id", "segment", "window", "n_tokens", "n_repeated", parts.alias("parts"))
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def mark(acc: Column, p: Column) -> Column:
        first = acc["at"] + F.length(p["header"])
        end = first + F.length(p["body"])
        spans = F.when(p["target"] & (acc["i"] >= F.col("n_repeated")), F.array_append(acc["spans"], F.struct(first.alias("begin"), end.alias("end")))).otherwise(acc["spans"])
        return F.struct((end + len(END)).alias("at"), (acc["i"] + 1).alias("i"), spans.alias("spans"))

    return windows.select("conv_id", "segment", "window", F.array_join(F.transform("parts", lambda p: F.concat(p["header"], p["body"], F.lit(END))), "").alias("text"),
                          "n_repeated", F.aggregate("parts", begin, mark, lambda a: a["spans"]).alias("loss"), "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"))


def read_turns(text: Column) -> Column:
    """Turns (role, text) of a formatted window, restored."""
    parts = F.split(text, END)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(
        unescaped(F.regexp_extract(p, "(?s)^### (.*?):\n", 1)).alias("role"), unescaped(F.regexp_replace(p, "(?s)^### .*?:\n", "")).alias("text")))


def loss_texts(text: Column, loss: Column) -> Column:
    """Restored texts under the loss mask of a window."""
    return F.transform(loss, lambda s: unescaped(F.substring(text, s["begin"] + 1, s["end"] - s["begin"])))
