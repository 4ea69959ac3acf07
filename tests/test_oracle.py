"""Every query that SQL can express gives the oracle's rows."""

from __future__ import annotations

import pytest

from keyloom.plans import catalog
from tests.compare import assert_same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
#: May be empty on the smallest tables.
SPARSE = {"q2", "q3", "cep_q3"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert assert_same(QUERIES[name](spark, sf_dir), SQL[name], sf_dir) or name in SPARSE


def test_every_oracle_has_its_query():
    assert set(SQL) <= set(QUERIES)
