"""Held-out accuracy, a plain convolution, and odd texts."""
import random
import zlib

import numpy as np

from drawmark.llm import langid

SCHEMA = "doc_id bigint, text string, lang string, SCORE string, lang_pred int"
SYLLABLES = {"aa": ["ka", "ti", "mo", "ru"], "bb": ["sch", "ein", "über", "ung"], "cc": ["ção", "lh", "nho", "ei"]}


def sentence(lang, n):
    return " ".join("".join(random.choices(SYLLABLES[lang], k=random.randint(1, 4))) for _ in range(n))


def labelled(n):
    random.seed(3)
    langs = random.choices(["aa", "bb", "cc"], weights=[5, 2, 1], k=n)
    return [(i, sentence(x, random.choice([4, 30, 400])), x if i % 50 else None, "s", 1) for i, x in enumerate(langs)], langs


def test_held_out_accuracy(spark):
    rows, langs = labelled(700)
    docs = spark.createDataFrame(rows, SCHEMA)
    net = langid.train_on(docs, sample=60)
    assert net.languages == ("aa", "bb", "cc")
    out = langid.languages_of(docs, net)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "lang_pred", "score"])
    got = out.select("doc_id", "lang_pred", "score", langid.held_out(out.doc_id).alias("held_out")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    tested = [r for r in got if r["held_out"]]
    assert len(tested) > 150 and sum(r["lang_pred"] == langs[r["doc_id"]] for r in tested) / len(tested) > 0.97
    # labels of documents held out, and anything but the text, make no difference
    spoilt = spark.createDataFrame([(i, t, "cc" if zlib.crc32(str(i).encode()) % 3 == 1 else x, "", 0) for i, t, x, *_ in rows], SCHEMA)
    again = langid.languages_of(spoilt, langid.train_on(spoilt, sample=60)).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in again} == {(r["doc_id"], r["lang_pred"], r["score"]) for r in got}


def plain_probabilities(net, text):
    """One window after the other, one place after the other."""
    raw = text.encode().lower()
    total = np.zeros(len(net.languages))
    for k in range(max(1, -(-(len(raw) - 6) // 250))):
        part = raw[k * 250:k * 250 + 256]
        x = net.embed[list(part.ljust(256, b"\0"))]
        pooled = [max(float((x[p:p + len(f)] * f[:, :, j]).sum()) for p in range(256 - len(f) + 1)) + b[j]
                  for f, b in zip(net.filters, net.bias) for j in range(f.shape[2])]
        z = np.maximum(pooled, 0) @ net.dense + net.offset
        total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * max(1, len(part))
    return total / total.sum()


def test_tables_are_the_convolution():
    rows, _ = labelled(60)
    net = langid.train([r[1].encode().lower() for r in rows], [r[2] or "aa" for r in rows], epochs=1)
    texts = [rows[0][1], "", "é", sentence("bb", 120), "x" * 256, "y" * 257]
    got = langid.classify(net, langid._tables(net), texts)
    for g, t in zip(got, texts):
        np.testing.assert_allclose(g, plain_probabilities(net, t), atol=2e-4)


def test_odd_texts_and_tables(spark):
    rows, _ = labelled(80)
    odd = [(900, None, "aa", "", 0), (901, "", "aa", "", 0), (902, "12 + 34!", "aa", "", 0), (None, "kati moru", None, "", 0), (903, "é", "aa", "", 0), (904, "日本語" * 40_000, "aa", "", 0)]
    docs = spark.createDataFrame(rows + odd + odd[:1], SCHEMA)
    net = langid.train_on(docs)
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.languages_of(docs, net).collect()]
    assert [g[1:] for g in got if g[0] in (900, 901, 902)] == [("und", 0.0)] * 4
    assert all(g[1] != "und" for g in got if g[0] not in (900, 901, 902))
    kept = langid.accepted(docs, net, above_chance=-1.0)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 3
    assert langid.accepted(docs, net, languages=("none",)).count() == 0
    nothing = langid.train_on(docs.limit(0))
    assert nothing is None and {r["lang_pred"] for r in langid.languages_of(docs, nothing).collect()} == {"und"}
    assert langid.languages_of(docs.limit(0), net).collect() == []


def test_texts_of_no_one_language_are_rejected(spark):
    """A text that is evenly of all languages goes, whatever their number; those of one language stay."""
    rows, _ = labelled(300)
    for known in (("aa", "bb"), ("aa", "bb", "cc")):
        clean = [(*r[:2], r[2] or "aa", *r[3:]) for r in rows if r[2] in known]
        mixed = [(1000 + k, " ".join(sentence(x, 3000).encode()[:9000].decode(errors="ignore") for x in known), None, "s", 1) for k in range(4)]
        docs = spark.createDataFrame(clean + mixed, SCHEMA)
        net = langid.train_on(docs, sample=80)
        left = {r["doc_id"] for r in langid.accepted(docs, net).collect()}
        assert left == {r[0] for r in clean}
        assert langid.accepted(spark.createDataFrame(clean[:5], SCHEMA), langid.train_on(spark.createDataFrame([r for r in clean if r[2] == "aa"], SCHEMA))).count() == 5
