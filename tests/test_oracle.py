"""Registered queries against their SQL on the smallest tables, and the driver contract."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect

FOLDER = os.environ.get("PAIRLAB_TABLES", "/root/testdata/sf0.001")
# Fits need more than the handful of pairs of the smallest tables.
LARGER = os.environ.get("PAIRLAB_LARGER_TABLES", "/root/testdata/sf0.01")
FITS = ("M", "C8", "Q7", "Q11_age_test", "T4_chi_square_p")
NAMES = [n for n in contract.oracle_sql() if not n.startswith(FITS)]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables not present")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    verdict = compare(spark, connection, name, FOLDER)
    assert verdict.startswith("ok"), verdict


@pytest.fixture(scope="module")
def larger():
    return connect(LARGER)


@pytest.mark.parametrize("name", [n for n in contract.oracle_sql() if n.startswith(FITS)])
def test_fit(spark, larger, name):
    verdict = compare(spark, larger, name, LARGER)
    assert verdict.startswith("ok"), verdict


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
