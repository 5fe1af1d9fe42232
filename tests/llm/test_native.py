"""The native operators plan no Python, and no operator plans a cross product."""

import pytest

from piste.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op4_quotation_links", "op10_order_minhash"])
def test_native_plans_hold_no_python(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExternalRDD", "CartesianProduct", "NestedLoop"))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n != "pipeline"])
def test_no_cross_products(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
