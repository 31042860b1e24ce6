"""The llm queries: oracle SQL where there is some, and their schemas on the smallest tables."""

import os

import pytest

from lumenfold.llm import queries
from tests.oracle import compare, duck

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
COLUMNS = {
    "p2_found": ["asset_id", "captured_from", "make_from"], "p3_found": ["asset_id_a", "asset_id_b"], "p4_found": ["asset_id_a", "asset_id_b"],
    "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id", "kind", "found"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_oracle(spark, name):
    assert compare(spark, duck(FOLDER), FOLDER, queries.QUERIES[name], queries.ORACLE[name]) == ""


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).columns == COLUMNS[name]
