"""Every registered query of the library against its SQL, or for rows where it has none."""

import pytest
from oracle import connect, same

from estima import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, con, name):
    same(QUERIES[name](spark, FOLDER).toPandas(), con.execute(SQL[name]).df())


#: Iterative queries that take long, and those whose tables are too small at this size; test_recovery has their operators.
LONG = {"j7_negative_binomial", "j11_zero_inflated_poisson", "j12_zero_inflated_nb", "i11_quantile_process", "j13_hurdle", "l1_two_way_effects", "m7_two_way_effect", "m8_event_study", "r4_louvain"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - LONG))
def test_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(5).count() > 0
