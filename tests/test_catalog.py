import pytest

from lodemap.plans import catalog
from oracle import connect, same

#: Queries that may find nothing in a small folder.
MAY_BE_EMPTY = {"stitch_configured_prefix", "secret_audit", "prune_missing"}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, data, name):
    n = same(catalog.QUERIES[name](spark, data), connect(data), catalog.ORACLES[name])
    assert n or name in MAY_BE_EMPTY


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
