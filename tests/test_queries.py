"""Every registered query of the engine's own operators against its SQL, or at least run."""

import pytest

from loomtext import oracle
from loomtext.queries import queries

SQL = oracle.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(name, spark, sf, duck, same):
    df = queries()[name](spark, sf)
    if name in SQL:
        same(df, duck.sql(SQL[name]))
    else:
        assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
