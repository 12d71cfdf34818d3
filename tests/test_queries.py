"""Each registered query of the library proper against its SQL; slow loops run on the smallest tables."""

import pytest
from compare import SF, connected, rows

from auditlake.plans import load_all

QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def con():
    return connected()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = con.execute(ORACLES[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got.columns)
