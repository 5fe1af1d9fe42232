"""Materialized marts: write the star once, query it many times (the reference's model).

``materialize`` writes dimensions as plain parquet and facts range-clustered on their date
key and partitioned by month, so semantic queries read narrow, pruned files instead of
re-deriving facts from the raw tables.  ``Marts`` is a mapping of the written tables that
the semantic layer accepts wherever it accepts a :class:`~piste.plans.star.Star`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from piste.operators.incremental import CODEC, _write
from piste.session import shuffles_removed

# The date key each fact is clustered on.
FACT_DATE_KEYS = {
    "fact_lift_scans": "date_key", "fact_pass_usage": "date_key", "fact_ticket_sales": "purchase_date_key",
    "fact_rentals": "rental_date_key", "fact_food_beverage": "transaction_date_key", "fact_weather": "date_key",
    "fact_staffing": "date_key", "fact_marketing": "send_date_key", "lift_wait_sketches": "date_key",
}


def _month(key: Column) -> Column:
    return F.coalesce((key / 100).cast("int"), F.lit(0))


def ranged(df: DataFrame, key: Column) -> DataFrame:
    """Rows in ranges of the month and ``key`` that their fact will be clustered on.  A fact derived
    from them needs no other shuffle, and its keys, texts and copies of columns are never shuffled."""
    return df.repartitionByRange(_month(key), key)


def materialize(tables: Mapping[str, DataFrame], root: str, names: list[str]) -> None:
    """Write ``names`` from ``tables`` under ``root`` (full refresh of each table).  Facts that the
    tables name in ``in_ranges`` come in ranges of their date key already."""
    for name in names:
        df = tables[name]
        key = FACT_DATE_KEYS.get(name)
        with shuffles_removed(df.sparkSession):
            if key:
                _write(df.select("*", _month(F.col(key)).alias("__month")), f"{root}/{name}", "__month", key, "overwrite", ranged=name in getattr(tables, "in_ranges", ()))
            else:
                df.write.mode("overwrite").option("compression", CODEC).parquet(f"{root}/{name}")


class Marts(Mapping):
    """Read-side mapping over materialized tables (partition column dropped)."""

    def __init__(self, spark: SparkSession, root: str, names: list[str]):
        self._dfs = {n: spark.read.parquet(f"{root}/{n}") for n in names}
        self._dfs = {n: (d.drop("__month") if "__month" in d.columns else d) for n, d in self._dfs.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._dfs[name]

    def __iter__(self):
        return iter(self._dfs)

    def __len__(self):
        return len(self._dfs)
