import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["SKI_SEASON", "CUSTOMER_SEGMENT", "TICKET_REVENUE", "RENTAL_REVENUE", "FNB_REVENUE",
                          "TOTAL_REVENUE"]
    assert df.count() > 0


def test_every_query_has_oracle_or_is_declared_rows_only():
    rows_only = {"p14_gbt_forecast_metrics", "p14_refit_on_all_rows", "p17_gbt_feature_importance", "p23_forecast_next_two_weeks",
                 "p23_daily_forecast_bands", "src09_order_sample"}
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(q) - set(o) - set(E.LLM) == rows_only
