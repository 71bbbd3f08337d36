"""Every registered query of the operators: columns of its contract, and equality with its SQL."""

import os

import __spark_entry__ as entry
import duckdb
import pytest
from corpusforge.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op2_html": {"page_id", "url", "text", "n_chars"},
    "op3_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op4_decontaminate": {"doc_id", "item_id", "coverage"},
    "op5_order_minhash": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op6_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op7_langid": {"doc_id", "held_out", "lang_pred", "score"},
    "op8_simhash": {"doc_id", "fingerprint", "component_id"},
    "op9_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op10_quality": {"doc_id", "held_out", "score", "predicted"},
    "op11_conversation_repair": {"conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"},
    "op12_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op13_whitening": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SMALL)
    assert COLUMNS[name] <= set(got.columns)
    rows = got.toPandas()
    if name != "op4_decontaminate":
        table, times = {"op2_html": ("pages", 1), "op11_conversation_repair": ("conversations", 1), "op13_whitening": ("embeddings", 8)}.get(name, ("documents", 1))
        of = spark.read.parquet(f"{SMALL}/{table}.parquet")
        assert len(rows) == times * (of.select("conv_id").distinct() if table == "conversations" else of).count()
    if name in ORACLE:
        con = duckdb.connect()
        for f in os.listdir(SMALL):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SMALL}/{f}')")
        want = con.execute(ORACLE[name]).df()
        columns = sorted(rows.columns)
        assert columns == sorted(want.columns)
        a, b = (x[columns].sort_values(columns, ignore_index=True) for x in (rows, want))
        assert a.astype(str).equals(b.astype(str))


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
