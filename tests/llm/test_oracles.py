"""The queries that SQL can express, against it."""

import pytest

from ledgerlens.llm import queries
from tests.oracle import FOLDER, assert_same, connect


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    assert_same(spark, connect(), queries.queries()[name], queries.oracle_sql()[name])
