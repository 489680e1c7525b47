"""Each query of the catalogue gives the rows of its SQL."""

import pytest
from compare import by_duckdb, by_spark

from quillon import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_same_rows(spark, name):
    got = by_spark(plans.queries()[name](spark, SF))
    assert got == by_duckdb(plans.oracle_sql()[name], SF)
    assert got[1]


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())
