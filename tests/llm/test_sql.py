"""The queries that SQL can express, against their SQL in DuckDB."""

import pytest
from conftest import compare

from driftwise.llm import registry

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    assert duck.execute(f"select count(*) from ({ORACLES[name]})").fetchone()[0] > 0
    compare(registry.queries()[name](spark, sf_dir), duck, ORACLES[name])
