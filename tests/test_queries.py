"""Named queries against their SQL on the smallest tables; tools/check_queries.py runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from opsloom.plans.bindings import TABLES
from tools.check_queries import rows_of

CHOSEN = ["log_service_health", "log_parse_extended_layouts", "wiki_chunk_rows", "request_classes", "sensitive_matches", "bm25_top",
          "hybrid_by_id", "related_three_hops", "critical_paths", "entities_in_questions", "solution_ranking", "root_causes",
          "counter_rate", "incident_log_search", "knowledge_search", "rate_quantiles", "model_monitors", "held_rules", "increase_by_labels",
          "lineage_downstream", "service_timeline", "entity_rows", "relation_rows", "question_services", "alert_spans", "message_order", "task_progress", "stream_first_texts",
          "question_entities", "keyword_filtered", "search_tables_written", "log_file_lines", "stream_search_tables"]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    got = rows_of(df.columns, df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in cur.description) and got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
