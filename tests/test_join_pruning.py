"""Facts are built for the columns that a question needs: no join that none of them uses."""

import re

import pytest

from piste.plans import catalog
from piste.plans import views as V
from piste.plans.semantic import query
from tests.conftest import SF_SMALL


def scans(df, table):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(rf"{table}\.parquet|Relation \[[^\]]*{dict(customer='c_custkey', part='p_partkey')[table]}", plan))


@pytest.fixture
def star(spark):
    return catalog.star_for(spark, SF_SMALL)


def test_a_fact_without_customer_columns_reads_no_customer(spark):
    assert scans(catalog.REGISTRY["n10_hourly_profile"](spark, SF_SMALL), "customer") == 0


def test_attributes_come_from_the_join_that_builds_the_key(spark):
    flagship = catalog.REGISTRY["sem_revenue_by_season_segment"](spark, SF_SMALL)
    assert scans(flagship, "customer") == 3 and scans(flagship, "part") == 0  # once per fact


def test_narrow_columns_equal_those_of_the_whole_fact(star):
    for name in ("fact_lift_scans", "fact_pass_usage", "fact_ticket_sales", "fact_rentals", "fact_food_beverage"):
        whole = star[name]
        for c in whole.columns:
            got, want = star.narrow(name, [c]), whole.select(c)
            assert got.columns == [c]
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty(), (name, c)


def test_carried_attributes_equal_a_join_on_the_key(star):
    metrics, dims = ["TICKET_REVENUE", "RENTAL_REVENUE", "FNB_REVENUE"], ["CUSTOMER_SEGMENT", "SKI_SEASON"]
    plain = {n: star[n] for n in star}
    a, b = query(V.REVENUE, star, metrics, dims), query(V.REVENUE, plain, metrics, dims)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
