"""A spread of queries against DuckDB on the smallest tables (all run in the driver's check)."""

import os

import pytest

from checks import catalog
from checks.compare import compare, connection

SF = "/root/testdata/sf0.001"
NAMES = [
    "scan_tsv", "scan_encoded", "records_to_table", "clean_text", "char_wb_ngrams", "tag_by_rules", "prefix_match",
    "override_multi", "distribution", "category_report", "multilabel_metrics_by", "describe_by", "two_band_sample",
    "split_stratified", "tfidf_l2", "hybrid_gated", "tag_restricted_class", "naive_bayes_sql", "grid_sweep", "job_tag_rules",
]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return connection(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    assert compare(spark, con, catalog.QUERIES[name], catalog.ORACLE[name], SF) == ""


def test_every_checked_query_is_registered():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
