"""Every query with SQL gives what DuckDB gives; every other one runs."""

import pytest
from compare import actual, duck, expected

from steward.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    got = actual(QUERIES[name](spark, sf_dir))
    if name not in ORACLES:
        assert got[0]
        return
    want = expected(con, ORACLES[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b
