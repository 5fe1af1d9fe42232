"""Property checks: dialect helpers and rounding agree with DuckDB on random inputs.

One Spark job per property (all generated examples in one DataFrame), so the check is
cheap while still covering many values.
"""

import datetime as dt

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from piste.functions.core import date_key, dow0, fround, year_boundary_diff

dates = st.dates(min_value=dt.date(1900, 1, 1), max_value=dt.date(2100, 12, 31))
doubles = st.one_of(
    st.floats(min_value=-1e9, max_value=1e9, allow_nan=False, allow_infinity=False),
    st.integers(min_value=-10**9, max_value=10**9).map(lambda i: i / 8.0),       # exact ties
    st.integers(min_value=-10**7, max_value=10**7).map(lambda i: i / 100000.0),
)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(dates, dates), min_size=50, max_size=200))
def test_date_helpers_match_duckdb(spark, pairs):
    df = spark.createDataFrame(pairs, "a date, b date")
    got = [(r.k, r.w, r.y) for r in df.select(date_key("a").alias("k"), dow0("a").alias("w"),
                                              year_boundary_diff("a", "b").alias("y")).collect()]
    con = duckdb.connect()
    exp = [con.execute("SELECT CAST(strftime(?::DATE, '%Y%m%d') AS INTEGER), CAST(dayofweek(?::DATE) AS INTEGER), "
                       "year(?::DATE) - year(?::DATE)", [a, a, b, a]).fetchone() for a, b in pairs]
    assert got == [tuple(e) for e in exp]


@settings(max_examples=5, deadline=None)
@given(st.lists(doubles, min_size=50, max_size=300), st.sampled_from([0, 1, 2, 4, 6]))
def test_fround_matches_duckdb_round(spark, values, scale):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [r.r for r in df.select(fround("x", scale).alias("r")).collect()]
    con = duckdb.connect()
    exp = [con.execute(f"SELECT round(?::DOUBLE, {scale})", [float(v)]).fetchone()[0] for v in values]
    assert got == exp
