"""Star schema over the driver tables: adapters -> staging -> dimensions -> facts.

``Star`` builds each table lazily on first access and memoizes the DataFrame (not the
data), so a query that touches one fact plans only that fact's lineage.  Use
:meth:`Star.tables` to hand the whole star to the semantic layer; only the tables a
request touches are ever planned.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piste.operators import dims as D
from piste.operators import facts as FT
from piste.operators import staging as ST
from piste.sources import adapters as A
from piste.sources.driver import DriverTables

# Least span of the calendar; it grows to every date that a fact carries (Star.span).
DRIVER_SPINE_START = "1994-11-01"
DRIVER_SPINE_DAYS = 11000
DATED = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
AHEAD_DAYS = 60             # days after the last fact: future frames and return dates
AS_OF = A.AS_OF_DATE
LOAD_TS = f"{AS_OF} 00:00:00"


def take(tables: Mapping[str, DataFrame], name: str, *columns: str) -> DataFrame:
    """Some columns of a table; a star then leaves out joins that they do not need."""
    return tables.narrow(name, columns) if hasattr(tables, "narrow") else tables[name].select(*columns)


class Star(Mapping):
    def __init__(self, spark: SparkSession, sf_dir: str, as_of: str = AS_OF,
                 spine_start: str = DRIVER_SPINE_START, spine_days: int = DRIVER_SPINE_DAYS):
        self.spark = spark
        self.t = DriverTables(spark, sf_dir)
        self.as_of = as_of
        self.spine_start = spine_start
        self.spine_days = spine_days
        self._memo: dict[str, DataFrame] = {}

    # -- Mapping protocol (lazy) ------------------------------------------------------
    _BUILDERS = (
        "dim_date dim_customer dim_lift dim_location dim_product dim_ticket_type "
        "stg_customers stg_lift_scans stg_pass_usage stg_ticket_sales stg_rentals stg_food_beverage "
        "fact_lift_scans fact_pass_usage fact_ticket_sales fact_rentals fact_food_beverage "
        "stg_weather_conditions stg_staffing_schedule stg_customer_feedback stg_incidents stg_ski_lessons "
        "stg_instructors fact_weather fact_staffing fact_feedback fact_incidents fact_lessons "
        "stg_marketing_touches stg_marketing_campaigns stg_campaign_touches stg_season_pass_sales "
        "fact_marketing fact_season_pass_sales "
        "stg_parking_lots stg_parking_occupancy stg_grooming_logs stg_employees fact_parking"
    ).split()

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._BUILDERS:
            raise KeyError(name)
        if name not in self._memo:
            self._memo[name] = getattr(self, f"_build_{name}")()
        return self._memo[name]

    def carries(self, name: str) -> dict[str, str]:
        """Dimensions whose columns the fact can bring along, with the fact's key of each."""
        return FT.CARRIES.get(name, {})

    def narrow(self, name: str, columns, carry: FT.Carry = None) -> DataFrame:
        """The named columns of a table.  A fact is built for just these columns: dimensions that
        none of them needs are not joined, and ``carry`` ({dimension: {column: alias}}) takes further
        columns from the joins that are made."""
        if name in FT.CARRIES:
            return getattr(self, f"_build_{name}")(set(columns), carry)
        return self[name].select(*columns)

    def __iter__(self):
        return iter(self._BUILDERS)

    def __len__(self):
        return len(self._BUILDERS)

    def tables(self) -> "Star":
        return self

    # -- dimensions ---------------------------------------------------------------
    def span(self) -> tuple[str, int, str]:
        """First day and number of days of the calendar (the configured span, widened to the least
        and greatest date of the raw tables), and the last day that facts need, however late it is.
        Three scalars, read once per star."""
        days = [self.t[table].select(F.col(c).cast("date").alias("day")) for table, c in DATED.items()]
        first, least = F.min("day"), F.lit(self.spine_start).cast("date")
        last, most = F.date_add(F.max("day"), AHEAD_DAYS), F.date_add(least, self.spine_days - 1)
        found = reduce(DataFrame.union, days).agg(
            F.least(first, least).cast("string").alias("start"),
            (F.datediff(F.greatest(last, most), F.least(first, least)) + 1).alias("days"), last.cast("string").alias("until")).first()
        return found["start"], found["days"], found["until"]

    def _build_dim_date(self):
        start, days, until = self.span()
        return D.dim_date(self.spark, start, days, self.as_of, until)

    def _build_dim_customer(self):
        return D.dim_customer(A.customers(self.t), self.as_of)

    def _build_dim_lift(self):
        return D.dim_lift(ST.stg_lifts(A.lifts(self.t)))

    def _build_dim_location(self):
        return D.dim_location(ST.stg_locations(A.locations(self.t)))

    def _build_dim_product(self):
        return D.dim_product(ST.stg_products(A.products(self.t)))

    def _build_dim_ticket_type(self):
        return D.dim_ticket_type(ST.stg_ticket_types(A.ticket_types(self.t)))

    # -- staging ------------------------------------------------------------------
    def _build_stg_customers(self):
        return ST.stg_customers(A.customers(self.t), self.as_of)

    def _build_stg_lift_scans(self):
        return ST.stg_lift_scans(A.lift_scans(self.t))

    def _build_stg_pass_usage(self):
        return ST.stg_pass_usage(A.pass_usage(self.t))

    def _build_stg_ticket_sales(self):
        return ST.stg_ticket_sales(A.ticket_sales(self.t))

    def _build_stg_rentals(self):
        return ST.stg_rentals(A.rentals(self.t))

    def _build_stg_food_beverage(self):
        return ST.stg_food_beverage(A.food_beverage(self.t))

    # -- facts --------------------------------------------------------------------
    def _build_fact_lift_scans(self, need: FT.Need = None, carry: FT.Carry = None):
        return FT.fact_lift_scans(self["stg_lift_scans"], self["dim_customer"], LOAD_TS, need, carry)

    def _build_fact_pass_usage(self, need: FT.Need = None, carry: FT.Carry = None):
        return FT.fact_pass_usage(self["stg_pass_usage"], self["dim_customer"], LOAD_TS, need, carry)

    def _build_fact_ticket_sales(self, need: FT.Need = None, carry: FT.Carry = None):
        return FT.fact_ticket_sales(self["stg_ticket_sales"], self["dim_customer"], self["dim_ticket_type"], need, carry)

    def _build_fact_rentals(self, need: FT.Need = None, carry: FT.Carry = None):
        return FT.fact_rentals(self["stg_rentals"], self["dim_customer"], self["dim_product"], need, carry)

    def _build_fact_food_beverage(self, need: FT.Need = None, carry: FT.Carry = None):
        return FT.fact_food_beverage(self["stg_food_beverage"], self["dim_customer"], self["dim_product"], need, carry)

    # -- operations facts derived from the driver data ------------------------------
    def _build_stg_weather_conditions(self):
        return ST.stg_weather_conditions(A.weather_conditions(self.t))

    def _build_stg_staffing_schedule(self):
        return ST.stg_staffing_schedule(A.staffing_schedule(self.t))

    def _build_stg_customer_feedback(self):
        return ST.stg_customer_feedback(A.customer_feedback(self.t))

    def _build_stg_incidents(self):
        return ST.stg_incidents(A.incidents(self.t))

    def _build_stg_ski_lessons(self):
        return ST.stg_ski_lessons(A.ski_lessons(self.t))

    def _build_stg_instructors(self):
        return ST.stg_instructors(A.instructors(self.t))

    def _build_fact_weather(self):
        return FT.fact_weather(self["stg_weather_conditions"], self["dim_date"])

    def _build_fact_staffing(self):
        return FT.fact_staffing(self["stg_staffing_schedule"], self["dim_date"], self["dim_location"])

    def _build_fact_feedback(self):
        return FT.fact_feedback(self["stg_customer_feedback"], self["stg_customers"])

    def _build_fact_incidents(self):
        return FT.fact_incidents(self["stg_incidents"], self["stg_customers"])

    def _build_fact_lessons(self):
        return FT.fact_lessons(self["stg_ski_lessons"], self["stg_customers"], self["stg_instructors"])

    # -- marketing and season passes ------------------------------------------------
    def _build_stg_marketing_touches(self):
        return ST.stg_marketing_touches(A.marketing_touches(self.t))

    def _build_stg_marketing_campaigns(self):
        return ST.stg_marketing_campaigns(A.marketing_campaigns(self.t))

    def _build_stg_campaign_touches(self):
        return ST.stg_campaign_touches(A.campaign_touches(self.t))

    def _build_stg_season_pass_sales(self):
        return ST.stg_season_pass_sales(A.season_pass_sales(self.t))

    def _build_fact_marketing(self):
        return FT.fact_marketing(self["stg_marketing_touches"], self["dim_date"])

    def _build_fact_season_pass_sales(self):
        return FT.fact_season_pass_sales(self["stg_season_pass_sales"], self["stg_customers"],
                                         self["stg_marketing_campaigns"])

    # -- parking, grooming, employees ---------------------------------------------------
    def _build_stg_parking_lots(self):
        return ST.stg_parking_lots(A.parking_lots(self.t))

    def _build_stg_parking_occupancy(self):
        return ST.stg_parking_occupancy(A.parking_occupancy(self.t))

    def _build_stg_grooming_logs(self):
        return ST.stg_grooming_logs(A.grooming_logs(self.t))

    def _build_stg_employees(self):
        return ST.stg_employees(A.employees(self.t))

    def _build_fact_parking(self):
        return FT.fact_parking(self["stg_parking_occupancy"], self["stg_parking_lots"])
