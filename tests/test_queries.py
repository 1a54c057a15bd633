"""Every registered query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from check_queries import compare

FOLDER = "/root/testdata/sf0.001"
ORACLES = contract.oracle_sql()


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, name):
    good, note = compare(spark, FOLDER, name, contract.queries()[name], ORACLES.get(name))
    assert good, note
