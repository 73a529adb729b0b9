"""The operators' queries that SQL can express, against DuckDB."""

import pytest
from oracle import same

from timberline.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    same(spark, data, QUERIES[name], ORACLE_SQL[name])
