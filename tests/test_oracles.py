"""A quick part of the registered queries against DuckDB on the smallest driver tables; `python check.py` runs them all."""

import os

import pytest

import __spark_entry__ as entry
from check import TABLES, canonical

FOLDER = "/root/testdata/sf0.001"
QUICK = ["F2_tag_prefix", "F5_html_visible_text", "F18_sentence_spans", "R2_bm25_rank", "R6_coverage_rescoring", "U1_sum_rrf", "U4_combsum",
         "M4_metric_slices", "K9_consensus_rerank", "K25_evaluate_grid", "J8_utility_reward", "J14_admissible_slate", "B3_quota_allocation", "B17_paired_bootstrap",
         "P1_tolerant_parse", "P8_verdict_parse", "P10_ranked_selection", "S5_split_sink", "S8_whole_files", "S15_verdict_load", "S10_label_linkbase", "J3_memory_retrieval",
         "J6_hierarchy_walk", "J16_posterior_means", "Q7_window_mismatch", "C6_relocation_materialise", "Q2_reusable_calls", "ST1_call_log_ingest"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
@pytest.mark.parametrize("name", QUICK)
def test_matches_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
