"""The registered queries against their SQL, at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from tablecite.plans import oracle
from tablecite.plans import queries as catalog
from tests.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.registry()))
def test_query_equals_its_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note


def test_every_query_has_sql():
    assert oracle.statements().keys() == catalog.registry().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


def test_entry_answers_every_question(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 48 and all(r["answer"] for r in rows)
