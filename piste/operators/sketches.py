"""Mergeable quantile sketches (R14): percentiles of any slice from sketches written once a day and key.

A KLL sketch of a day's values takes a few kilobytes whatever their number, so no group ever holds
its values; a question merges the sketches of its slice.  ``rank_bound(k)`` is the normalised rank
error that a sketch of size ``k`` keeps to, merged or not, in all but a vanishing share of cases
(twice the error that 99 per cent of sketches stay below).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piste.functions.core import packed, unpacked

SIZE = 1024


def rank_bound(k: int = SIZE) -> float:
    # Coefficients of the sketch's published error for single ranks.
    return round(2 * 2.296 / k**0.9021, 3)


def sketched(facts: DataFrame, keys: list[str], value: str, k: int = SIZE) -> DataFrame:
    """(keys, values, sketch): number of values and their sketch, null values left out; partial sketches
    are merged before and after the shuffle, which carries text keys packed."""
    v, text = F.col(value).cast("double"), {c for c, t in facts.dtypes if t == "string"}
    found = facts.where(v.isNotNull()).groupBy(*[packed(c).alias(c) if c in text else c for c in keys]).agg(
        F.count(F.lit(1)).alias("values"), F.kll_sketch_agg_double(v, k).alias("sketch"))
    return found.select(*[unpacked(c).alias(c) if c in text else c for c in keys], "values", "sketch")


def merged(sketches: DataFrame, *by: Column | str) -> DataFrame:
    """The sketches of every slice as one."""
    return sketches.groupBy(*by).agg(F.sum("values").alias("values"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(sketch: Column | str, share: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(float(share)))


def within_bound(facts: DataFrame, by: list[str], value: str, estimates: DataFrame, estimate: str, share: float, bound: float) -> DataFrame:
    """(by, within): whether the estimate's true rank among a slice's values lies within ``bound`` of
    ``share``; one pass that compares, and holds no values."""
    v = F.col(value).cast("double")
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by]
    met = facts.where(v.isNotNull()).alias("f").join(estimates.alias("e"), same).select(
        *[F.col(f"f.{c}").alias(c) for c in by], (v < F.col(f"e.{estimate}")).cast("long").alias("below"), (v <= F.col(f"e.{estimate}")).cast("long").alias("upto"))
    n = met.groupBy(*by).agg(F.sum("below").alias("below"), F.sum("upto").alias("upto"), F.count(F.lit(1)).alias("n"))
    return n.select(*by, ((F.col("below") / F.col("n") <= share + bound) & (F.col("upto") / F.col("n") >= share - bound)).alias("within"))
