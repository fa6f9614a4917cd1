"""Every catalog query on the small tables: against its SQL, or for rows."""

from __future__ import annotations

import pytest
from oracle import DATA, connection, differences

from tidemark.plans import catalog

SF = "sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, str(DATA / SF))
    if name in catalog.ORACLE_SQL:
        assert differences(df, catalog.ORACLE_SQL[name], con) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
