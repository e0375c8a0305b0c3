"""Registered queries next to their SQL on the smallest tables."""

import pathlib

import pytest
from compare import check, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(SF).exists(), reason="no test tables")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# one or two per area here; tests/compare.py runs all of them
CHOSEN = """cells_from_table mapping_checks event_log_roundtrip publish_version norm_label parse_number fingerprint tenant_scope candidate_edges topk_candidates
    confidence assign_optimal assign_greedy alias_join basename_join fallback_scope nearest_text nearest_title merged_lookup override_upsert scoped_diff learn_mappings
    ambiguity block_review status_rollup usage_cost stale_outputs progress_percent header_row orientation infer_label label_map dense_fill read_contract package_issues
    typed_matrix_issues relevant_sources composite_score table_plans table_blocks stream_usage_hourly stream_job_state stream_audit stream_learn""".split()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    assert check(spark, con, name, QUERIES[name], SQL[name], SF) == ""


def test_flagship_runs(spark):
    cells = entry.entry(spark)
    assert cells.columns == ["target_id", "table_id", "row_ix", "col_ix", "row_label", "col_label", "value"]
    assert cells.where("value is not null").limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
