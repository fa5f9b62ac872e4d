"""Every query with SQL against its SQL; those without against brute force in test_brute_force.py."""

from __future__ import annotations

import pytest

from tarnspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(name, matches):
    matches(queries.QUERIES[name], queries.ORACLE_SQL[name])
