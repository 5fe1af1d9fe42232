import pytest
from pyspark.sql import functions as F

from piste.plans import views as V
from piste.plans.catalog import star_for
from piste.plans.semantic import flat, query
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def star(spark):
    return star_for(spark, SF_SMALL)


def test_unreachable_dimension_is_rejected(star):
    with pytest.raises(ValueError):
        query(V.REVENUE, star, ["RENTAL_REVENUE"], ["TICKET_CATEGORY"])


def test_synonym_resolution(star):
    a = query(V.CUSTOMER_BEHAVIOR, star, ["TOTAL_VISITS"], ["season"]).collect()
    b = query(V.CUSTOMER_BEHAVIOR, star, ["TOTAL_VISITS"], ["SKI_SEASON"]).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def test_drill_across_equals_single_fact_queries(star):
    both = query(V.REVENUE, star, ["TICKET_REVENUE", "FNB_REVENUE"], ["CUSTOMER_SEGMENT"])
    t = query(V.REVENUE, star, ["TICKET_REVENUE"], ["CUSTOMER_SEGMENT"])
    f = query(V.REVENUE, star, ["FNB_REVENUE"], ["CUSTOMER_SEGMENT"])
    got = {r.CUSTOMER_SEGMENT: (r.TICKET_REVENUE, r.FNB_REVENUE) for r in both.collect()}
    assert got == {r.CUSTOMER_SEGMENT: (r.TICKET_REVENUE, {x.CUSTOMER_SEGMENT: x.FNB_REVENUE for x in f.collect()}
                                        .get(r.CUSTOMER_SEGMENT)) for r in t.collect()} | {
        k: (None, v) for k, v in {x.CUSTOMER_SEGMENT: x.FNB_REVENUE for x in f.collect()}.items()
        if k not in {r.CUSTOMER_SEGMENT for r in t.collect()}}


def test_unused_dimension_does_not_change_totals_and_is_not_joined(star):
    total = query(V.REVENUE, star, ["TICKETS_SOLD"], []).first().TICKETS_SOLD
    by_type = query(V.REVENUE, star, ["TICKETS_SOLD"], ["LOCATION_TYPE"])
    assert sum(r.TICKETS_SOLD for r in by_type.collect()) == total
    plan = query(V.REVENUE, star, ["TICKETS_SOLD"], ["LOCATION_TYPE"])._jdf.queryExecution().optimizedPlan().toString()
    assert "ticket_category" not in plan and "customer_segment" not in plan


def test_empty_group_ratio_is_null(star):
    r = query(V.CUSTOMER_BEHAVIOR, star, ["VISITS_PER_CUSTOMER"], [],
              filters=[lambda r: r("DIM_CUSTOMER", "customer_segment") == F.lit("nobody")]).first()
    assert r.VISITS_PER_CUSTOMER is None


def test_flat_row_access(star):
    rows = flat(V.OPERATIONS, star, "FACT_LIFT_SCANS", ["LIFT_NAME", "WAIT_TIME_MINUTES"]).limit(3).collect()
    assert len(rows) == 3 and rows[0].LIFT_NAME is not None


def test_sql_over_a_registered_view(spark, star):
    from piste.plans.semantic import register_sql_view

    register_sql_view(V.CUSTOMER_BEHAVIOR, star, "FACT_PASS_USAGE")
    got = {r[0]: r[1] for r in spark.sql(
        "SELECT customer_segment, COUNT(*) FROM sem_customer_behavior GROUP BY 1").collect()}
    exp = {r.CUSTOMER_SEGMENT: r.TOTAL_VISITS for r in query(
        V.CUSTOMER_BEHAVIOR, star, ["TOTAL_VISITS"], ["CUSTOMER_SEGMENT"]).collect()}
    assert got == exp


def test_percentiles_are_not_kept_for_every_distinct_value(star):
    asked = ["UNIQUE_RIDERS", "TOTAL_SCANS", "P95_WAIT_MINUTES", "P95_WAIT_MINUTES_APPROX"]
    both = query(V.OPERATIONS, star, asked, ["LIFT_TYPE"])
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    for line in (x for x in plan.splitlines() if "Aggregate [" in x and "percentile(" in x):
        keys = line.split("Aggregate [")[1].split("]")[0]
        assert "FLS__customer_key" not in keys and "customer_key" not in keys and "count(" not in line
    alone = {r.LIFT_TYPE: r for r in query(V.OPERATIONS, star, asked[2:], ["LIFT_TYPE"]).collect()}
    counts = {r.LIFT_TYPE: r for r in query(V.OPERATIONS, star, asked[:2], ["LIFT_TYPE"]).collect()}
    got = {r.LIFT_TYPE: tuple(r)[1:] for r in both.collect()}
    assert got == {k: tuple(counts[k])[1:] + tuple(alone[k])[1:] for k in alone}
