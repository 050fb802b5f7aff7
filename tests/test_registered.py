"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from check_oracle import normal

FOLDER = "/root/testdata/sf0.001"
BASE = [name for module in contract.MODULES for name in module.QUERIES]


@pytest.fixture(scope="module")
def tables():
    base = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        base.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return base


def test_every_query_has_its_sql():
    assert set(BASE) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 50


@pytest.mark.parametrize("name", BASE)
def test_query(spark, tables, name):
    frame = contract.queries()[name](spark, FOLDER)
    result = tables.execute(contract.oracle_sql()[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert normal(frame.columns, [tuple(row) for row in frame.collect()]) == normal(names, result.fetchall())
