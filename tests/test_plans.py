"""Plan-shape guard: no registered query plans a cartesian product, a nested-loop join or
a Python UDF (checked on the physical plan at the smallest scale factor)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInArrow", "MapInPandas")


@pytest.mark.parametrize("name", [n for n in E.queries() if n not in E.LLM])
def test_no_cross_products_or_python_udfs(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not [f for f in FORBIDDEN if f in plan]
