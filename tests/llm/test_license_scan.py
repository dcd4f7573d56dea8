"""License detections against a plain scan with Python's regular expressions."""
import random
import re
from re import _constants as C
from re import _parser

from drawmark.llm.license_rules import RULES, Rule
from drawmark.llm.license_scan import CONFIDENCE, gate_pattern, license_scan

SCHEMA = "doc_id bigint, text string, LABELS int, _scan string, w string"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def plain(text, rules=RULES):
    """Matches rule by rule at every word, then suppression pair by pair."""
    words, hits = words_of(text), []
    for r in rules:
        if r.keyword in " ".join(words):
            pattern, at = re.compile(r.pattern), 0
            while at < len(words):
                rest = " ".join(words[at:])
                found = next((m for m in [pattern.match(rest)] if m), None)
                # the longest way to end at a word that the pattern prefers
                if found and found.end() < len(rest) and rest[found.end()] != " ":
                    found = re.compile(f"(?:{r.pattern})(?= |$)").match(rest)
                if found:
                    n = found.group().count(" ") + 1
                    hits.append((at, at + n - 1, r))
                    at += n
                else:
                    at += 1
    out = []
    for a, b, r in hits:
        inside = any(x <= a and y >= b and (o.priority, y - x, -o.number) > (r.priority, b - a, -r.number) for x, y, o in hits)
        out.append((a, b, r.number, r.base or not inside))
    return len(words), sorted(out)


def sample(parsed, widest, rng):
    """A text that the parsed pattern matches: with or without its optional parts."""
    out = ""
    for op, value in parsed:
        if op is C.LITERAL:
            out += chr(value)
        elif op is C.IN:
            kind, first = value[0]
            out += chr(first) if kind is C.LITERAL else "7" if first is C.CATEGORY_DIGIT else "word"
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = value
            out += "".join(sample(inner, widest, rng) for _ in range(min(high, low + 2) if widest else low))
        elif op is C.SUBPATTERN:
            out += sample(value[3], widest, rng)
        elif op is C.BRANCH:
            out += sample(rng.choice(value[1]), widest, rng)
        else:
            raise AssertionError(op)
    return out


def samples():
    rng = random.Random(5)
    return [(r, sample(_parser.parse(r.pattern), widest, rng)) for r in RULES for widest in (False, True)]


def test_rules_are_sound():
    gate = re.compile(gate_pattern(RULES).replace("(?i:", "(?i:"))
    assert len(RULES) > 200 and [r.number for r in RULES] == list(range(len(RULES)))
    assert {r.label for r in RULES if r.base} == {"cc-by", "gpl", "reserved"}
    for r, text in samples():
        assert re.compile(r.pattern).groups == 0 and re.fullmatch(r.pattern, text), (r, text)
        assert f" {r.keyword}" in f" {text}" and gate.search(text) and gate.search(f"X.{text.upper()}"), (r, text)


def test_against_plain_scan(spark):
    random.seed(8)
    pool = [t for _, t in samples()] + ["cc by", "all rights reserved", "general public license", "x", "y z", "the license", "copyright 2020"]

    def noisy(text):
        return "".join(random.choice([" ", "  ", ", ", "\n-- ", "/"]) if c == " " else c.upper() if random.random() < 0.2 else c for c in text)
    texts = [noisy(" ".join(random.choices(pool, k=random.randint(1, 6)))) for _ in range(120)]
    texts += [t for _, t in samples()] + [None, "", " ...", "nothing here", "CC-BY", "cc by cc by cc by 4.0", "cc byé", "xcc by", "Gnu General Public License, version 2.0 all rights reserved",
                                          "licensed under the MIT license. Licensed under CC BY 4.0", "All rights\x00reserved", "all rights réserved"]
    rows = [(i, t, 1, "s", "w") for i, t in enumerate(texts)] + [(0, texts[0], 1, "s", "w"), (None, "cc by", 1, "s", "w")]
    out = license_scan(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "_scan", "w", "n_words", "detections", "labels", "score"]
    found = out.collect()
    assert len(found) == len(rows)
    for r in found:
        n, hits = plain(r["text"])
        assert r["n_words"] == n
        assert sorted((d["first"], d["last"], d["rule"], d["kept"]) for d in r["detections"]) == hits, r["text"]
        kept = [RULES[h[2]] for h in hits if h[3]]
        assert r["labels"] == sorted({k.label for k in kept}) and r["score"] == max((CONFIDENCE[k.priority] for k in kept), default=0.0)


def test_suppression_and_ties(spark):
    rules = [Rule(0, True, 1, "base", "a b", "a b"), Rule(1, False, 3, "long", "a b", "a b c"), Rule(2, False, 2, "same", "a b", "a b"),
             Rule(3, False, 2, "same-later", "a b", "a b"), Rule(4, False, 4, "other", "c d", "c d")]
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b x"), (3, "c d")], "doc_id int, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan(docs, rules=rules).collect()}
    assert got == {1: (["base", "long", "other"], 1.0), 2: (["base", "same"], 0.7), 3: (["other"], 1.0)}


def test_very_long_text_and_empty_table(spark):
    n = 20_000
    docs = spark.createDataFrame([(1, "All rights reserved; " * n)], "doc_id int, text string")
    row = license_scan(docs).selectExpr("n_words", "size(detections) AS n", "labels", "detections[19999].first AS at").first()
    assert tuple(row) == (3 * n, n, ["reserved"], 3 * (n - 1))
    assert license_scan(docs.limit(0)).collect() == []
