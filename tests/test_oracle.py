"""A cross-section of the named queries against SQL (all of them: check_oracle.py)."""

import pytest

from pagebundle.plans.oracle import ORACLE
from pagebundle.plans.queries import QUERIES

from __spark_entry__ import entry, oracle_sql, queries
from check_oracle import compare, connect

from conftest import SF_DIR

NAMES = (
    "scan_pages", "patterns_json", "attachment_by_id", "page_classification",
    "tenant_classification", "ocr_summary", "page_decisions", "split_with_verdicts",
    "review_reasons", "bundle_warnings", "child_rows", "page_range", "pages_move",
    "status_text",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name) is None


def test_registry_is_complete(spark):
    assert set(QUERIES) == set(ORACLE) and set(QUERIES) <= set(queries())
    assert set(ORACLE) <= set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0
