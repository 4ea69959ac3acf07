"""Operators that SQL can express give the oracle's rows, over whole tables."""

from __future__ import annotations

import pytest

from keyloom.llm import registry
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert assert_same(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name], sf_dir) > 0
