"""Operators that are to run without Python on their main path."""

import pytest

from levelwise.llm import queries
from levelwise.plans.inspect import operators

NATIVE = ["op2_quality_rules", "op4_decontamination", "op5_personal_data", "op6_sharding"]


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_cross_join(spark, name):
    names = operators(queries.queries()[name](spark, "/root/testdata/sf0.001"))
    banned = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups", "Cartesian")
    assert not [n for n in names if n.startswith(banned) or "NestedLoopJoin" in n]
