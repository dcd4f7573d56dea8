"""Windows against a plain Python formatter, and reading back."""
import random
import re

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from drawmark.llm.chat import chat_windows, loss_texts, read_turns

SCHEMA = "conv_id bigint, turn bigint, role string, text string, n bigint, turns string, segment int"


def plain(rows, budget, history, segment):
    """rows of one conversation: (turn, role, text, tokens); list of (segment, [(role, text)], n_repeated, tokens)."""
    rows = sorted(((-1 if t is None else t), r or "", x or "", (n or 0) + 4) for t, r, x, n in rows)
    system = rows.pop(0) if rows[0][1] == "system" else None
    lead = system[3] if system else 0
    out, window = [], None
    first_segment = (system or rows[0])[0] // segment
    by_segment = {}
    for r in rows:
        by_segment.setdefault(r[0] // segment, []).append(r)
    if system and first_segment not in by_segment:
        out.append([first_segment, [], 0, lead])
    for s, own in sorted(by_segment.items()):
        old = [r for r in by_segment.get(s - 1, []) if r[0] % segment >= segment - history]
        if system and s == first_segment + 1 and system[0] % segment >= segment - history:
            old = [r for r in old if r[:3] != system[:3]]
        turns, window = old + own, None
        for i in range(len(old), len(turns)):
            if window is None or sum(t[3] for t in turns[window[0]:i + 1]) + lead > budget:
                if window:
                    out.append([s, turns[window[0]:i], window[1] - window[0], None])
                head = i
                while head > 0 and i - head < history and sum(t[3] for t in turns[head - 1:i]) <= budget // 4 and sum(
                        t[3] for t in turns[head - 1:i + 1]) + lead <= budget:
                    head -= 1
                window = (head, i)
        out.append([s, turns[window[0]:], window[1] - window[0], None])
    shown = []
    for k, (s, turns, n, _) in enumerate(out):
        head = [(system[1], system[2])] if system else []
        shown.append((s, head + [t[1:3] for t in turns], n + (1 if system and k else 0), lead + sum(t[3] for t in turns)))
    return shown


def escape(text, more=""):
    return re.sub(rf"([\\#{more}]|(?<=<)/)", r"\\\1", text)


def cases():
    random.seed(8)
    odd = ["\\### Assistant: </turn> ok", "", None, "</turn>\n### user:\n", "\\", "\\\\#", "<", "</", "#", "a\n\nb", "é日本🙂 </TURN>", "### assistant:\n</turn>\n", "/>", "$1 \\$2"]
    out = []
    for conv in range(40):
        rows = [(0, "system", random.choice(odd), random.choice([5, 60]))] if random.random() < 0.5 else []
        for t in range(random.choice([0, 1, 2, 8, 30])):
            rows.append((t + len(rows) * 0 + 1, random.choice(["user", "assistant", "tool:x", "we\nird", None]), random.choice(odd), random.choice([0, 3, 20, 50, 130])))
        out.append((conv, rows))
    out += [(None, [(0, "user", "x", 1), (1, "assistant", "y", 2)]), (100, [(None, "user", "x", 1), (0, "assistant", "y", 2), (0, "assistant", "y", 2)]),
            (101, [(0, "system", "s", 1)]), (102, [(3, "system", "s", 1), (3, "system", "s", 1), (9, "assistant", "t", 1)])]
    return [(c, r) for c, r in out if r]


def test_windows(spark):
    for budget, history, segment in ((100, 2, 256), (100, 3, 8), (60, 0, 5), (2048, 2, 256)):
        rows = [(c, *r, "clash", 5) for c, rs in cases() for r in rs]
        df = spark.createDataFrame([(c, t, r, x, n, a, b) for c, t, r, x, n, a, b in rows], SCHEMA)
        got = chat_windows(df, tokens_col="n", budget=budget, history=history, segment=segment)
        got = got.select("*", read_turns(F.col("text")).alias("read"), loss_texts(F.col("text"), F.col("loss")).alias("targets")).collect()
        by_conv = {}
        for r in sorted(got, key=lambda r: (r["segment"], r["window"])):
            by_conv.setdefault(r["conv_id"], []).append(r)
        for c, rs in cases():
            want = plain(rs, budget, history, segment)
            assert [(r["segment"], [tuple(t) for t in r["read"]], r["n_repeated"], r["n_tokens"]) for r in by_conv[c]] == want, (c, budget)
            for r, (_, turns, n, tokens) in zip(by_conv[c], want):
                assert r["text"] == "".join(f"### {escape(a, ':' + chr(10))}:\n{escape(b)}</turn>\n" for a, b in turns)
                assert r["targets"] == [b for a, b in turns[n:] if a == "assistant"] and r["over_budget"] == (tokens > budget)
                assert tokens <= budget or sum(t[0] != "system" for t in turns[n:]) <= 1
            targets = [t for r in by_conv[c] for t in r["targets"]]
            ordered = sorted(((-1 if t is None else t), r or "", x or "") for t, r, x, _ in rs)
            assert targets == [x for _, r, x in ordered if r == "assistant"]


def test_windows_fit_the_budget_under_a_real_tokenizer(spark):
    texts = ["one two, 12345", "#\\</" * 30, "äöü 漢字 \U0001f600" * 12, "", "x" * 700, "z" * 3000]
    rows = [(c, k, ("system", "user", "assistant")[k % 3 if k < 3 else 1 + k % 2], texts[(c + k) % 6], 0, "", 0) for c in range(6) for k in range(9)]
    windows = chat_windows(spark.createDataFrame(rows, SCHEMA), budget=1500).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for w in windows:
        assert len(coder.encode(w["text"], add_special_tokens=False).ids) <= w["n_tokens"] == len(w["text"].encode())
        assert w["over_budget"] == (w["n_tokens"] > 1500)
    assert {w["over_budget"] for w in windows} == {True, False}


def test_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "one two, 12345", 0, "", 0)], SCHEMA)
    assert chat_windows(df.limit(0)).collect() == []
