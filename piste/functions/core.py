"""Column helpers that reproduce the warehouse dialect exactly.

All helpers return ``Column`` expressions built from ``pyspark.sql.functions`` so they
stay inside whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

# Fixed value: the placeholder the surrogate-key macro substitutes for NULL inputs.
NULL_KEY_TOKEN = "_dbt_utils_surrogate_key_null_"

# Fixed value: timestamp text format used before hashing, so keys agree across engines.
TS_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_text(c) -> Column:
    return F.date_format(_col(c), TS_TEXT_FORMAT)


def surrogate_key(*cols, df: DataFrame | None = None) -> Column:
    """md5 of the '-'-joined text of the inputs, NULLs replaced by a fixed token.

    Timestamps are rendered with an explicit format (pass ``df`` so the helper can see
    column types; or wrap timestamp inputs in :func:`ts_text` yourself).
    """
    parts = []
    types = dict((f.name, f.dataType) for f in df.schema.fields) if df is not None else {}
    for c in cols:
        col = _col(c)
        if isinstance(c, str) and isinstance(types.get(c), (TimestampType, TimestampNTZType)):
            text = ts_text(col)
        elif isinstance(c, str) and isinstance(types.get(c), DateType):
            text = F.date_format(col, "yyyy-MM-dd")
        else:
            text = col.cast("string")
        parts.append(F.coalesce(text, F.lit(NULL_KEY_TOKEN)))
    return F.md5(F.concat_ws("-", *parts))


def packed(c) -> Column:
    """Text as bytes that take half the room when it is lower-case hex (surrogate keys are): what rows
    carry through a shuffle.  Equal bytes are equal texts; :func:`unpacked` gives the text back, whatever
    it holds."""
    raw = F.unhex(_col(c))
    return F.when(F.lower(F.hex(raw)) == _col(c), F.concat(F.lit(b"\x01"), raw)).otherwise(F.concat(F.lit(b"\x00"), _col(c).cast("binary")))


def unpacked(c) -> Column:
    rest = F.substring(_col(c), 2, 2**31 - 1)
    return F.when(F.substring(_col(c), 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def date_key(c) -> Column:
    """Integer YYYYMMDD; arithmetic instead of format+parse keeps it in codegen."""
    d = F.to_date(_col(c))
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def dow0(c) -> Column:
    """Day of week with 0 = Sunday ... 6 = Saturday (Spark's dayofweek is 1-based)."""
    return (F.dayofweek(_col(c)) - 1).cast("int")


def year_boundary_diff(start, end) -> Column:
    """Year-boundary count (not full years): 2000-12-31 -> 2001-01-01 is 1."""
    return (F.year(_col(end)) - F.year(_col(start))).cast("int")


def hour_boundary_diff(start, end) -> Column:
    """Hour-boundary count: 08:50 -> 17:10 is 9."""
    s = F.date_trunc("hour", _col(start))
    e = F.date_trunc("hour", _col(end))
    return F.timestamp_diff("HOUR", s, e).cast("int")


def safe_div(num, den) -> Column:
    """DIV0(x, NULLIF(y, 0)): NULL when the denominator is 0 or NULL (never raises).

    Operands are taken as double so the quotient is the same IEEE value in any engine.
    """
    return F.try_divide(_col(num).cast("double"), _col(den).cast("double"))


def fround(c, scale: int) -> Column:
    """Round a double to ``scale`` places as round-half-away-from-zero of ``x * 10^scale``.

    Spark's ``round`` on doubles rounds the shortest decimal text of the value, which
    differs from rounding the binary value at exact-looking ties (183112.82875 -> ...8288
    vs ...8287).  Scaling first, rounding to an integer and scaling back gives the same
    IEEE result in Spark and in other engines, so results compare exactly.
    """
    m = float(10 ** scale)
    return F.round(_col(c).cast("double") * F.lit(m), 0) / F.lit(m)


def round_doubles(df: DataFrame, scale: int = 4) -> DataFrame:
    """Round every double/float/decimal column (decimals become double) to ``scale`` places (stable result comparison)."""
    from pyspark.sql.types import DecimalType, DoubleType, FloatType

    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType, DecimalType)):
            cols.append(fround(F.col(f.name), scale).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
