"""Every registered query against its oracle on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    status, rows, _, _, _, detail = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert status in ("ok", "rows-only"), detail


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_unique():
    from importlib import import_module

    names = [n for m in entry._modules() for n in m.QUERIES]
    assert len(names) == len(set(names)) and set(entry.oracle_sql()) <= set(names)
    assert import_module("offerloom.plans.guards").ORACLE.keys() == import_module("offerloom.plans.guards").QUERIES.keys()
