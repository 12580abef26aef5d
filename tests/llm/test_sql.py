"""Queries against their SQL, as the entry registers them."""

import pytest

from chronofold.llm.queries import QUERIES, SQL
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    d = "/root/testdata/sf0.001"
    compare(QUERIES[name](spark, d), SQL[name], d)
