"""Every core query runs at the smallest size, and equals its SQL where it has one."""

from __future__ import annotations

import pytest

from tessera.plans import catalog
from tests import oracle


@pytest.fixture(scope="module")
def duck(tiny):
    return oracle.connection(tiny)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, tiny, duck, name):
    df = catalog.QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = oracle.rows_of(df, columns)
    if name in catalog.ORACLE:
        assert got == oracle.sql_rows(duck, catalog.ORACLE[name], columns)


def test_entry_names():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
