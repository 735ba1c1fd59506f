"""Every query that SQL can express, against its SQL twin; the others give rows."""

import pytest

from tests.oracle import compare
from unitloom.plans import registry

SF = "/root/testdata/sf0.001"
Q, S = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(Q))
def test_query(spark, name):
    if name in S:
        compare(spark, SF, Q[name], S[name])
    else:
        assert Q[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
