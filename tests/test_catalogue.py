"""Every query of the catalogue on the smallest tables, against its SQL where there is one."""

from __future__ import annotations

import pytest

from retrix.plans.catalogue import ORACLE, QUERIES
from tests.oracle import compare, connection


@pytest.fixture(scope="module")
def views(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, data, views, name):
    compare(QUERIES[name](spark, data), views, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_without_sql(spark, data, name):
    """The same rows in every run, as recorded: their number, and a digest of their values."""
    from tests.golden import EXPECTED, digest

    assert digest(QUERIES[name](spark, data)) == EXPECTED[name]


def test_entry_and_oracle_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "hybrid_rrf" in entry.queries()
