"""The pipeline against plain Python stages on a small corpus."""
import random

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_langid import sentence
from tests.llm.test_near_copies import plain_components


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    random.seed(12)
    items = [(i, sentence("aa", 25)) for i in range(4)]
    texts = [(sentence(x, 60), x) for x in random.choices(["aa", "bb"], k=120)]
    rows = [(i, t, x, "src0", 1) for i, (t, x) in enumerate(texts)]
    rows += [(200 + k, rows[k][1], rows[k][2], "src1", 1) for k in range(0, 40, 2)]  # exact copies
    # near copies: one word of 60 changed leaves 51 of 61 runs of five words; three changed words leave too few
    for k in range(1, 40, 4):
        words = rows[k][1].split()
        rows.append((300 + k, " ".join([*words[:30], words[30] + words[31], *words[31:]]), rows[k][2], "src2", 1))
        rows.append((360 + k, " ".join(w + w if i in (10, 30, 50) else w for i, w in enumerate(words)), rows[k][2], "src2", 1))
    rows += [(400 + k, f"{sentence('aa', 10)} {items[k % 4][1]} {sentence('aa', 10)}", "aa", "src3", 1) for k in range(6)]  # passages
    rows += [(500, None, "aa", "s", 0), (501, "", None, "s", 0), (502, "12 34", None, None, None), (503, "...", "aa", "s", 1)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def test_stages(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, left = docs.columns, {r[0]: r for r in rows}
    for (name, stage), step in zip(corpus_pipeline.STAGES, ("language", "exact", "near", "clean", "pieces")):
        out = stage(spark, docs, folder)
        if step == "language":
            left = {i: r for i, r in left.items() if i < 500}
        if step == "exact":
            best = {}
            for i, r in left.items():
                best[r[1]] = max(i, best.get(r[1], -1))
            left = {i: left[i] for i in best.values()}
        if step == "near":
            of = plain_components({i: r[1] for i, r in left.items()})
            assert sum(of[i] != i for i in left) == 10
            left = {i: r for i, r in left.items() if of[i] == i}
        if step == "clean":
            left = {i: r for i, r in left.items() if not plain_hits(r[1], items)[1]}
        if step == "pieces":
            reference = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECES))
            assert {r["doc_id"]: r["piece_ids"] for r in out.collect()} == {i: reference.encode(r[1]) for i, r in left.items()}
            break
        assert out.columns == columns
        assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in left.values()), name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == set(left) and 60 < len(left) <= 130


def test_stages_of_an_empty_table(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == []
