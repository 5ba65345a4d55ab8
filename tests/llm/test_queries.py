"""The registered queries: the columns their contracts name, and the SQL that checks them, over small tables."""

import duckdb
import pytest

from talkloom.llm import queries

pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op2_tokens": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op3_chat": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op4_token_counts": {"doc_id": "bigint", "section": "int", "n_tokens": "bigint", "crossing": "bigint"},
    "op5_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "kept_chars": "bigint", "kept_sha256": "string"},
    "op6_near_duplicates": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op9_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op10_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op11_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op12_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op13_manifest": {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"},
}


def test_every_operator_has_a_query():
    assert set(queries.QUERIES) == set(COLUMNS) and set(queries.ORACLES) <= set(COLUMNS)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_rows_and_sql(spark, name):
    found = queries.QUERIES[name](spark, SF)
    types = dict(found.dtypes)
    assert {c: types[c] for c in COLUMNS[name]} == COLUMNS[name]
    rows = [tuple(r) for r in found.select(*sorted(found.columns)).collect()]
    if "doc_id" in types and name != "op4_token_counts":
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    if name in queries.ORACLES:
        con = duckdb.connect()
        for table in ("documents", "benchmark", "conversations", "embeddings"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        got = con.sql(queries.ORACLES[name])
        order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
        assert [got.columns[i] for i in order] == sorted(found.columns)
        key = lambda r: tuple(str(round(x, 6) if isinstance(x, float) else x) for x in r)
        assert sorted(map(key, rows)) == sorted(key([r[i] for i in order]) for r in got.fetchall())
