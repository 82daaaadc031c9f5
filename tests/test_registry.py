"""Registered queries equal their SQL on the small tables; all have a reason when they lack one."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences
from checks.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    mine = entry.queries()[name](spark, SF).toPandas()
    assert differences(mine, connect(SF).execute(entry.oracle_sql()[name]).df()) is None


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() == 5334 and rows.columns == ["cell", "time", "hotspot", "dhw"]
