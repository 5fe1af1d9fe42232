"""Whole facts of loads and checks: lines joined and written once, shuffled before anything is derived."""

import re
import time

import pytest
from pyspark.sql import functions as F

from piste.operators import quality as Q
from piste.plans import catalog
from piste.plans import marts as MT
from piste.plans.declared_tests import declared
from piste.plans.star import Star
from piste.session import SHUFFLE_CLEANUP, shuffles_removed, staged

LINE = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"
ROWS = {
    "region": ("r_regionkey int, r_name string", [(0, "ASIA")]),
    "nation": ("n_nationkey int, n_name string, n_regionkey int", [(1, "JAPAN", 0)]),
    "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                 [(1, "a", 1, 1.0, "X"), (2, "b", 1, 6000.0, "Y"), (2, "b", 1, 6000.0, "Z"), (None, "c", 1, 2.0, "X")]),
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
             [(10, "p", "B1", "T1", 1, 5.0), (11, "q", None, "T2", 1, None), (11, "q", "B2", "T2", 1, 7.0), (None, "r", "B3", "T3", 1, 8.0)]),
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string",
               [(100, 1, "F", 10.0, "1997-01-31 00:00:00", "1-URGENT"), (101, 2, "O", 20.0, "1997-02-01 12:00:00", "5-LOW"), (102, 9, "P", None, "1997-02-01 00:00:00", None),
                (103, None, "F", 30.0, None, "5-LOW"), (100, 1, "F", 10.0, "1997-01-31 00:00:00", "1-URGENT"), (None, 1, "F", 1.0, "1997-01-31 00:00:00", "5-LOW")]),
    "lineitem": (LINE, [(100, 10, 3, 1, 2.0, 10.0, 0.1, 0.05, "R", "F", "1997-01-31 00:00:00"), (100, 11, 3, 2, 1.0, 10.0, 0.0, 0.0, "N", "O", "1997-01-31 20:00:00"),
                        (101, 11, 4, 1, 4.0, 12.5, 0.0, 0.02, "R", "F", "1997-02-28 23:00:00"), (101, 12, None, None, 4.0, 12.5, 0.0, 0.02, "R", None, "1997-03-01 00:00:00"),
                        (102, None, 4, 3, 1.0, None, None, None, None, "F", None), (103, 10, 4, 1, 1.0, 3.0, 0.5, 0.0, "R", "F", "1997-03-01 00:00:00"),
                        (999, 10, 4, 1, 1.0, 3.0, 0.5, 0.0, "R", "F", "1997-03-01 00:00:00"), (None, 10, 4, 1, 1.0, 3.0, 0.5, 0.0, "R", "F", "1997-03-01 00:00:00")]),
    "supplier": ("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", [(3, "s", 1, 1.0), (4, "t", 1, -1.0)]),
    "events": ("event_id bigint, ts string, user_id bigint, event_type string, value double", [(1, "1997-01-05 10:00:00", 1, "error", 2.0), (2, "1997-01-06 10:00:00", 9, "purchase", 3.0)]),
}


@pytest.fixture()
def star(spark, scratch):
    for name, (schema, rows) in ROWS.items():
        df = spark.createDataFrame(rows, schema)
        for c in {"o_orderdate", "l_shipdate", "ts"} & set(df.columns):
            df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
        df.write.parquet(f"{scratch}/in/{name}.parquet")
    return Star(spark, f"{scratch}/in")


def rows(df):
    return df.columns, sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_written_facts_are_those_of_the_star(spark, star, scratch):
    from piste.plans.loads import MartLoads

    facts = list(MartLoads.in_ranges)
    MT.materialize(MartLoads(star), f"{scratch}/marts", facts)
    written = MT.Marts(spark, f"{scratch}/marts", facts)
    for name in facts:
        assert rows(written[name]) == rows(star[name]), name
    assert star["fact_food_beverage"].count() == 2 + 2 * 2 + 4 + 2 + 1 + 1  # twice order 100, customer 2 and part 11
    months = [r[0] for r in spark.read.parquet(f"{scratch}/marts/fact_food_beverage").select("__month").distinct().orderBy("__month").collect()]
    assert months == [0, 199701, 199702, 199703]


def test_facts_are_shuffled_before_they_are_derived_and_lines_are_joined_once(star):
    from piste.plans.loads import MartLoads

    loads = MartLoads(star)
    for name in loads.in_ranges:
        found = plan(loads[name]).split("\n")
        at = next(i for i, line in enumerate(found) if "RepartitionByExpression" in line)
        depth = [re.search("[A-Z]", line + "Z").start() for line in found]
        below = [line for i, line in enumerate(found[at:], at) if i == at or all(d > depth[at] for d in depth[at + 1:i + 1])]
        assert "md5(" in "".join(found) and "md5(" not in "".join(below), name
    assert not re.search("l_orderkey#.* = o_orderkey#", plan(loads["fact_rentals"]) + plan(loads["fact_food_beverage"]))


def test_checks_of_written_lines_find_what_checks_of_the_star_find(star):
    from piste.plans.loads import CheckedLoads

    checks = [c for c in declared() if c.table.endswith(("_lift_scans", "_rentals", "_food_beverage"))]
    assert len(checks) == 25 and {c.kind for c in checks} == {"unique", "not_null", "relationships"}
    assert rows(Q.failing_rows(CheckedLoads(star, checks), checks)) == rows(Q.failing_rows(star, checks))


@pytest.mark.parametrize("query", ["q06_declared_tests", "q06_declared_mart_tests"])
def test_declared_checks_join_lines_with_orders_once(spark, query):
    from tests.conftest import SF_SMALL

    assert not re.search("l_orderkey#.* = o_orderkey#", plan(catalog.REGISTRY[query](spark, SF_SMALL)))


def test_a_check_of_a_column_that_was_not_written_fails(star):
    from piste.plans.loads import CheckedLoads

    checks = [Q.Check("n", "not_null", "fact_lift_scans", "wait_time_minutes")]
    with pytest.raises(Exception, match="wait_time_minutes"):
        Q.run_suite(CheckedLoads(star, checks), checks).collect()


def test_a_write_removes_its_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}

    setting, before = spark.conf.get(SHUFFLE_CLEANUP, None), files()
    with shuffles_removed(spark):
        kept = staged(spark.range(1000).repartition(7), "test")
    for _ in range(50):  # they are removed in the background
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and kept.count() == 1000
    with pytest.raises(ValueError), shuffles_removed(spark):
        raise ValueError
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting
