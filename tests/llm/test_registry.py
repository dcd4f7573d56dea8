"""All training-data queries run on the smallest data, and match their SQL where they have any."""
from pathlib import Path

import pytest

import __spark_entry__ as entry

SMALL = Path("/root/testdata/sf0.001")
OPS = ("op1_url_filter", "op2_warc_revisit", "op3_exact_dedup", "op4_simhash", "op5_token_counts", "op6_chat_format", "op7_token_files",
       "op8_decontamination", "op9_sentencepiece", "op10_language_id", "op11_periodic_runs", "op12_license_scan", "op13_merkle_manifest")


def test_all_are_registered():
    assert {*OPS, "pipeline"} <= set(entry.queries())


@pytest.mark.skipif(not SMALL.exists(), reason="needs the benchmark tables")
@pytest.mark.parametrize("name", [n for n in OPS if n in entry.oracle_sql()])
def test_queries_match_their_sql(spark, name):
    from tests.oracle_check import compare, connect
    assert compare(spark, connect(str(SMALL)), name, entry.queries()[name], entry.oracle_sql()[name], str(SMALL)) == []


@pytest.mark.skipif(not SMALL.exists(), reason="needs the benchmark tables")
@pytest.mark.parametrize("name", [n for n in OPS if n not in entry.oracle_sql()])
def test_every_document_has_a_row(spark, name):
    found, docs = entry.queries()[name](spark, str(SMALL)), spark.read.parquet(f"{SMALL}/documents.parquet")
    assert sorted(r[0] for r in found.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())
