"""Every registered query of the library itself against its SQL twin."""

import pytest

from platen import catalogue

from .conftest import rows_of

ORACLES = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, duck, name):
    got = catalogue.queries()[name](spark, sf_dir).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
