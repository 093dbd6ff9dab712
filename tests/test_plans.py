"""No registered query plans a cross join or row-at-a-time Python."""

from __future__ import annotations

import pytest

from tablecite.plans import queries as catalog
from tests.plans import plan_of

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "FlatMapGroupsInPandas")


@pytest.mark.parametrize("name", sorted(catalog.registry()))
def test_plan(spark, name):
    plan = plan_of(catalog.registry()[name](spark, SF))
    assert not [word for word in FORBIDDEN if word in plan]
    assert plan.count("ArrowEvalPython") <= 2
