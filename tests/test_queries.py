"""Spark against SQL on the smallest tables, for one query of every area."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from studyloom import catalog
from check_oracle import compare

SF = "/root/testdata/sf0.001"
NAMES = [
    "history_asof", "history_nested", "past_reports_last2", "report_status", "second_clean", "findings_impression_merge", "views_array",
    "auroc", "best_threshold", "bleu_corpus", "cider", "rouge_l", "knn_topk", "cooccurrence", "patient_relations", "graph_text",
    "ensemble_prompts", "best_of_n", "json_lines_scan", "stream_clean", "stream_session", "mmr_k3_blocks", "clinical_text", "pair_edges",
    "kb_build_entities", "kb_build_relations", "prediction_append", "stream_dedup", "graph_f1_complete", "report_graph_scan", "nested_csv",
    "deletion_log", "build_counters_observed", "similarity_summary", "evaluation_row",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, SF)
    found = con.execute(entry.oracle_sql()[name])
    theirs = ([d[0] for d in found.description], found.fetchall())
    assert compare((df.columns, [tuple(r) for r in df.collect()]), theirs) == "ok"


def test_every_query_has_sql():
    assert set(catalog.load()[0]) <= set(entry.oracle_sql())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
