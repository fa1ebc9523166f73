"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from check_oracle import compare, oracle

from sparksymbols.plans import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("SYMBOLS_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, tables):
    assert name in ORACLE_SQL
    result, _ = compare(name, spark, tables, FOLDER)
    assert result.startswith("ok"), result
