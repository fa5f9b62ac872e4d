"""Every query of the store and of scenes against its SQL."""

from __future__ import annotations

import pytest

from tarnspark.plans import lane_queries, route_queries, scene_queries
from tarnspark.plans import queries as store_queries

QUERIES = store_queries.QUERIES | scene_queries.QUERIES | lane_queries.QUERIES | route_queries.QUERIES
ORACLE_SQL = store_queries.ORACLE_SQL | scene_queries.ORACLE_SQL | lane_queries.ORACLE_SQL | route_queries.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, matches, spark, sf_dir):
    sql = ORACLE_SQL.get(name)
    if sql is None:
        assert QUERIES[name](spark, sf_dir).collect()
    else:
        matches(QUERIES[name], sql)
