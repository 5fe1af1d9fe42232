"""Dimensions D01-D07: date spine, conformed dimensions with SCD-2 columns, SCD-2 merge.

Dimensions are small next to the facts, but none is assumed small: joins against them are
plain, and the planner broadcasts a side whose bytes are below its threshold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from piste.functions.core import date_key, dow0, surrogate_key, ts_text, year_boundary_diff
from piste.operators.staging import age_group

# SCD-2 defaults.
OPEN_END = "9999-12-31 00:00:00"
CATALOG_VALID_FROM = "2020-11-01 00:00:00"   # products / ticket types version start
SPINE_START = "2020-11-01"
SPINE_DAYS = 3650


def _ts(s: str) -> Column:
    return F.lit(s).cast("timestamp_ntz")


def ski_season(d: Column) -> Column:
    y, m = F.year(d), F.month(d)
    return (
        F.when(m >= 11, F.concat(y.cast("string"), F.lit("-"), (y + 1).cast("string")))
        .when(m <= 4, F.concat((y - 1).cast("string"), F.lit("-"), y.cast("string")))
    )


def dim_date(spark: SparkSession, start: str = SPINE_START, days: int = SPINE_DAYS,
             as_of: str = "2025-01-01", until: str | None = None) -> DataFrame:
    """Calendar spine of ``days`` rows from ``start``, in-season rows only, up to two years after
    ``as_of`` or to ``until``, whichever is later.

    Built from ``spark.range`` (a bounded generator, no shuffle); the row count is the
    ``days`` argument, so broadcasting it is always safe.
    """
    d = F.col("full_date")
    y, m, dom, wd = F.year(d), F.month(d), F.dayofmonth(d), dow0(d)
    season_start = F.when(m >= 11, F.make_date(y, F.lit(11), F.lit(1))).when(
        m <= 4, F.make_date(y - 1, F.lit(11), F.lit(1)))
    # Holiday windows -- Dec 20-31, Jan 1-5, MLK and Presidents' Mondays
    # (third week of Jan / Feb), Mar 10-24.
    is_holiday = (
        ((m == 12) & dom.between(20, 31))
        | ((m == 1) & dom.between(1, 5))
        | ((m == 1) & (wd == 1) & dom.between(15, 21))
        | ((m == 2) & (wd == 1) & dom.between(15, 21))
        | ((m == 3) & dom.between(10, 24))
    )
    # Holiday names and the month -> snow condition table.
    holiday_name = (
        F.when((m == 12) & (dom == 25), "Christmas")
        .when((m == 1) & (dom == 1), "New Years Day")
        .when((m == 7) & (dom == 4), "Independence Day")
        .when((m == 11) & (wd == 4) & dom.between(22, 28), "Thanksgiving")
    )
    snow = (
        F.when(m.isin(1, 2), "Excellent").when(m.isin(12, 3), "Good")
        .when(m.isin(11, 4), "Fair").otherwise("Closed")
    )
    spine = spark.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("full_date"))
    out = spine.select(
        date_key(d).alias("date_key"),
        d,
        F.date_format(d, "EEE").alias("day_name"),
        wd.alias("day_of_week"),
        dom.alias("day_of_month"),
        F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"),
        m.alias("month_num"),
        F.date_format(d, "MMM").alias("month_name"),
        F.trunc(d, "month").alias("month_start_date"),
        F.quarter(d).alias("quarter_num"),
        F.trunc(d, "quarter").alias("quarter_start_date"),
        y.alias("calendar_year"),
        ski_season(d).alias("ski_season"),
        F.when(m >= 11, m - 10).when(m <= 4, m + 2).alias("season_month"),
        (F.floor(F.datediff(d, season_start) / 7) + 1).cast("int").alias("week_of_season"),
        wd.isin(0, 6).alias("is_weekend"),
        (wd == 0).alias("is_sunday"),
        (wd == 6).alias("is_saturday"),
        is_holiday.alias("is_holiday"),
        holiday_name.alias("holiday_name"),
        snow.alias("snow_condition"),
        (~m.between(5, 10)).alias("is_operating"),
        _ts(f"{as_of} 00:00:00").alias("created_at"),
    )
    cutoff = F.greatest(F.add_months(F.lit(as_of).cast("date"), 24), F.lit(until).cast("date"))
    return out.filter((d <= cutoff) & F.col("ski_season").isNotNull())


def dim_customer(raw: DataFrame, as_of: str) -> DataFrame:
    """One current version per raw customer row; key = (customer_id, valid_from)."""
    age = year_boundary_diff(F.col("birth_date"), F.lit(as_of).cast("date"))
    keep = [c for c in ("customer_id", "customer_name", "email", "phone", "birth_date") if c in raw.columns]
    rest = [c for c in ("customer_segment", "is_pass_holder", "pass_type", "first_visit_date", "home_zip_code",
                        "state") if c in raw.columns]
    return raw.select(
        surrogate_key(F.col("customer_id"), ts_text("created_at")).alias("customer_key"),
        *keep,
        age.alias("age"),
        age_group(age).alias("age_group"),
        *rest,
        F.col("created_at").alias("valid_from"),
        _ts(OPEN_END).alias("valid_to"),
        F.lit(True).alias("is_current"),
    )


def dim_lift(raw: DataFrame) -> DataFrame:
    """D03."""
    return raw.select(surrogate_key(F.col("lift_id")).alias("lift_key"), *raw.columns)


def dim_location(raw: DataFrame) -> DataFrame:
    """D04."""
    return raw.select(surrogate_key(F.col("location_id")).alias("location_key"), *raw.columns)


def _catalog_scd(raw: DataFrame, id_col: str, key_name: str, valid_from: str) -> DataFrame:
    vf = _ts(valid_from)
    return raw.select(
        surrogate_key(F.col(id_col), ts_text(vf)).alias(key_name),
        *raw.columns,
        vf.alias("valid_from"),
        _ts(OPEN_END).alias("valid_to"),
        F.lit(True).alias("is_current"),
    )


def dim_product(raw: DataFrame, valid_from: str = CATALOG_VALID_FROM) -> DataFrame:
    """D05."""
    return _catalog_scd(raw, "product_id", "product_key", valid_from)


def dim_ticket_type(raw: DataFrame, valid_from: str = CATALOG_VALID_FROM) -> DataFrame:
    """D06."""
    return _catalog_scd(raw, "ticket_type_id", "ticket_type_key", valid_from)


def scd2_merge(current: DataFrame, incoming: DataFrame, key: str, tracked: list[str], ts: str,
               key_name: str | None = None) -> DataFrame:
    """Type-2 merge of a snapshot taken at ``ts`` into a versioned dimension.

    A snapshot speaks about the version that holds at ``ts``, which need not be the open one:
    snapshots may arrive out of order.  For a key that is in both,

    * nothing changes if no tracked column differs (NULL-safe) from that version;
    * else the version ends at ``ts`` and a new one takes over its remaining time, open if it was
      open; a version that began at ``ts`` itself is replaced;
    * a snapshot older than the first version adds one before it, or, if nothing differs, lets the
      first one begin at ``ts``.

    New keys open a first version; keys absent from the snapshot and all other versions pass
    through.  Of columns that the snapshot lacks, a new version keeps the values of the version it
    takes over.  One join on ``key``; every joined row turns into its one or two versions in place.
    """
    now = _ts(ts)
    columns = [c for c in current.columns if c != key_name]
    attrs = [c for c in columns if c not in (key, "valid_from", "valid_to", "is_current")]
    given = set(incoming.columns) - {key}
    first = F.min("valid_from").over(Window.partitionBy(key))
    versions = current.select(*columns).withColumn("__first", first).withColumn("__old", F.lit(True))
    snapshot = incoming.select(key, *[F.col(c).alias(f"__new_{c}") for c in sorted(given)], F.lit(True).alias("__in"))
    j = versions.join(snapshot, key, "full_outer")

    old, new = F.col("__old").isNotNull(), F.col("__in").isNotNull()
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"__new_{c}")) for c in tracked])
    start, end = F.col("valid_from"), F.col("valid_to")
    holds, oldest = (start <= now) & (now < end), (start == F.col("__first")) & (now < start)

    def version(fresh: bool, valid_from: Column, valid_to: Column, open_: Column) -> Column:
        values = [F.col(f"__new_{c}") if fresh and c in given else F.col(c) for c in attrs]
        return F.struct(F.col(key).alias(key), *[v.cast(current.schema[c].dataType).alias(c) for v, c in zip(values, attrs)],
                        valid_from.alias("valid_from"), valid_to.alias("valid_to"), open_.alias("is_current"))

    keep = version(False, start, end, F.col("is_current"))
    taken_over = version(True, now, end, F.col("is_current"))
    closed = version(False, start, now, F.lit(False))
    made = (F.when(~old, F.array(version(True, now, _ts(OPEN_END), F.lit(True))))
            .when(~new, F.array(keep))
            .when(holds & differs & (start == now), F.array(taken_over))
            .when(holds & differs, F.array(closed, taken_over))
            .when(oldest & differs, F.array(version(True, now, start, F.lit(False)), keep))
            .when(oldest, F.array(version(False, now, end, F.col("is_current"))))
            .otherwise(F.array(keep)))
    out = j.select(F.explode(made).alias("v")).select("v.*").select(*columns)
    if key_name:
        out = out.select(surrogate_key(F.col(key), ts_text("valid_from")).alias(key_name), *columns)
    return out
