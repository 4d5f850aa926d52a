"""The llm queries with SQL against DuckDB on the smallest tables, and the columns of all."""

import duckdb
import pytest

from weftline.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_secrets": "doc_id n_assign n_access n_hex base_sha256 spans", "op3_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op4_jaccard": "doc_id n_shingles component_id",
    "op11_conversations": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256", "op12_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated", "op13_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op5_html": "page_id url text n_chars", "op6_embeddings": "vec_id n_links component_id kept", "op7_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op8_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op9_toxicity": "doc_id held_out score predicted",
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert got and got == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert queries.QUERIES[name](spark, SF).columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
