import os
import sys

import pytest

import compare

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry_points  # noqa: E402

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@needs_data
@pytest.mark.parametrize("name", list(entry_points.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    query, sql = entry_points.queries()[name], entry_points.oracle_sql()[name]
    assert compare.difference(spark, query, sql, SF) is None


@needs_data
def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
