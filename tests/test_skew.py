"""Hot keys: one customer owns a third of the fact rows, one term is in every document.
Results must stay whole and exact (no dropped or capped rows)."""

from pyspark.sql import functions as F

from piste.operators import text as TX
from piste.plans import views as V
from piste.plans.semantic import query


def test_semantic_query_with_a_hot_customer(spark):
    n = 3000
    rows = [(f"u{i}", "hot" if i % 3 == 0 else f"c{i % 50}", 20250101, float(i % 7)) for i in range(n)]
    fact = spark.createDataFrame(rows, "usage_key string, customer_key string, date_key int, hours_on_mountain double")
    fact = fact.withColumn("total_lift_rides", F.lit(1).cast("bigint"))
    cust = spark.createDataFrame([("hot", "big", True)] + [(f"c{i}", f"s{i % 3}", False) for i in range(50)],
                                 "customer_key string, customer_segment string, is_pass_holder boolean")
    dates = spark.createDataFrame([(20250101, "2024-2025", False)], "date_key int, ski_season string, is_weekend boolean")
    tables = {"fact_pass_usage": fact, "dim_customer": cust, "dim_date": dates}
    got = {r.CUSTOMER_SEGMENT: (r.TOTAL_VISITS, r.UNIQUE_CUSTOMERS, r.PASS_HOURS_TOTAL)
           for r in query(V.CUSTOMER_BEHAVIOR, tables, ["TOTAL_VISITS", "UNIQUE_CUSTOMERS", "PASS_HOURS_TOTAL"],
                          ["CUSTOMER_SEGMENT"]).collect()}
    exp: dict = {}
    for i in range(n):
        c = "hot" if i % 3 == 0 else f"c{i % 50}"
        seg = "big" if c == "hot" else f"s{int(c[1:]) % 3}"
        v, cs, h = exp.get(seg, (0, set(), 0.0))
        exp[seg] = (v + 1, cs | {c}, h + float(i % 7))
    assert got == {k: (v, len(cs), h) for k, (v, cs, h) in exp.items()}
    assert sum(v[0] for v in got.values()) == n


def test_keyword_search_with_a_term_in_every_document(spark):
    docs = spark.createDataFrame([(i, "the " + ("powder " if i % 10 == 0 else "rain ") + f"doc{i}") for i in range(500)],
                                 "doc_id long, text string")
    q = spark.createDataFrame([(1, "the powder"), (2, "the")], "query_id long, text string")
    res = TX.keyword_search(docs, q, k=1000, match="all").collect()
    assert sorted(r.doc_id for r in res if r.query_id == 1) == list(range(0, 500, 10))
    assert len([r for r in res if r.query_id == 2]) == 500          # every match kept, none capped
    best = TX.keyword_search(docs, q, k=1000).collect()
    assert len(best) == 1000 and {r.doc_id for r in best if r.query_id == 1 and r.rank <= 50} == set(range(0, 500, 10))
