"""Data-quality checks Q01-Q07 (the declared schema tests), as DataFrame jobs.

Each check returns the *failing rows* (empty = pass), like a stored test failure table.
``run_suite`` evaluates many checks and returns one row per check, ``failing_rows`` what fails;
both expand every table once for all of its checks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piste.functions.core import packed, unpacked


def unique(df: DataFrame, *cols: str) -> DataFrame:
    """Q01: key values that occur more than once (NULL keys are not tested)."""
    keyed = df.select(*cols).dropna(subset=list(cols))
    return keyed.groupBy(*cols).agg(F.count(F.lit(1)).alias("n_records")).filter(F.col("n_records") > 1)


def not_null(df: DataFrame, col: str) -> DataFrame:
    """Q02: rows where ``col`` is NULL."""
    return df.filter(F.col(col).isNull())


def relationships(child: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Q03: child rows whose non-NULL foreign key has no parent (anti join)."""
    c = child.filter(F.col(col).isNotNull())
    p = parent.select(F.col(parent_col).alias("__pk")).distinct()
    return c.join(p, c[col] == p["__pk"], "left_anti")


def accepted_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Q04: rows whose non-NULL value is outside the accepted set."""
    return df.filter(F.col(col).isNotNull() & ~F.col(col).isin(list(values)))


def store_failures(failures: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Q05: persist failing rows as a table (parquet) for inspection."""
    failures.write.mode(mode).parquet(path)


@dataclass
class Check:
    name: str
    kind: str                       # unique | not_null | relationships | accepted_values
    table: str
    column: str | tuple[str, ...]
    parent: str | None = None
    parent_column: str | None = None
    values: tuple = field(default_factory=tuple)


def _columns(check: Check) -> list[str]:
    return [check.column] if isinstance(check.column, str) else list(check.column)


def observations(tables, checks: Sequence[Check]) -> DataFrame:
    """(check, key, rows, parents): what all checks need to know, from one pass over each table.

    Every table is read once and expanded to a row per check and key: the key of a unique check, the
    foreign key of a relationship on the child's side and the key it refers to on the parent's, the
    value of a row that a not-null or accepted-values check rejects (nothing for rows that pass).
    One shuffle on (check, key) counts them; equal keys of a task are counted before it, so a
    hot foreign key or a column that is null throughout is a row per task.  Keys are shuffled packed.
    """
    wanted: dict[str, list] = {}

    def expect(table: str, i: int, use, key, rows: int, parents: int) -> None:
        entry = F.struct(F.lit(i).alias("check"), key.alias("key"), F.lit(rows).cast("bigint").alias("rows"), F.lit(parents).cast("bigint").alias("parents"))
        wanted.setdefault(table, []).append(F.when(use, entry))

    for i, c in enumerate(checks):
        cols = _columns(c)
        key, known = F.concat_ws(",", *[F.col(x).cast("string") for x in cols]), reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in cols])
        if c.kind == "not_null":
            expect(c.table, i, ~known, F.lit(""), 1, 0)
        elif c.kind == "accepted_values":
            expect(c.table, i, known & ~F.col(c.column).isin(list(c.values)), key, 1, 0)
        else:
            expect(c.table, i, known, key, 1, 0)
        if c.kind == "relationships":
            expect(c.parent, i, F.col(c.parent_column).isNotNull(), F.col(c.parent_column).cast("string"), 0, 1)
    parts = [tables[t].select(F.explode(F.array(*entries)).alias("e")).where("e is not null").select("e.check", packed("e.key").alias("key"), "e.rows", "e.parents")
             for t, entries in wanted.items()]
    seen = reduce(DataFrame.unionByName, parts)
    counted = seen.groupBy("check", "key").agg(F.sum("rows").alias("rows"), F.sum("parents").alias("parents"))
    return counted.withColumn("key", unpacked("key"))


def _failing(tables, checks: Sequence[Check]) -> DataFrame:
    """(check, key, rows): the keys or values that fail, with the number of rows that have them."""
    of = lambda kind: F.col("check").isin([i for i, c in enumerate(checks) if c.kind == kind])
    bad = F.when(of("unique"), F.col("rows") > 1).when(of("relationships"), (F.col("rows") > 0) & (F.col("parents") == 0)).otherwise(F.col("rows") > 0)
    return observations(tables, checks).where(bad).drop("parents")


def failing_rows(tables, checks: Sequence[Check]) -> DataFrame:
    """Q05: (check_name, table_name, column_name, value, n_records): what fails, by value, for
    storing.  Rows that break one check with the same value are counted, never listed one by one."""
    meta = _meta(tables, checks)
    return _failing(tables, checks).join(meta, "check").select("check_name", "table_name", "column_name", F.col("key").alias("value"), F.col("rows").alias("n_records"))


def _meta(tables, checks: Sequence[Check]) -> DataFrame:
    spark = tables[checks[0].table].sparkSession
    return spark.createDataFrame([(i, c.name, c.kind, c.table, ",".join(_columns(c))) for i, c in enumerate(checks)],
                                 "check int, check_name string, kind string, table_name string, column_name string")


def run_suite(tables, checks: Sequence[Check]) -> DataFrame:
    """Q06: one row per check -> (check_name, kind, table_name, column_name, failures, status).

    A unique check counts the keys that repeat, any other check the rows that fail.  All checks
    share one pass over each table and one shuffle (``observations``).
    """
    unique_ids = [i for i, c in enumerate(checks) if c.kind == "unique"]
    counted = _failing(tables, checks).groupBy("check").agg(
        F.sum(F.when(F.col("check").isin(unique_ids), F.lit(1)).otherwise(F.col("rows"))).alias("failures"))
    return _meta(tables, checks).join(counted, "check", "left").select(
        "check_name", "kind", "table_name", "column_name", F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"),
        F.when(F.coalesce("failures", F.lit(0)) == 0, "pass").otherwise("fail").alias("status"))


def overlap_profile(left: DataFrame, left_date: str, right: DataFrame, right_date: str) -> DataFrame:
    """Q07: date coverage of two join inputs (min, max, distinct days) and their overlap.

    One union + one aggregation by day; no join between the two inputs.
    """
    days = (left.select(F.col(left_date).alias("d"), F.lit(True).alias("l"), F.lit(False).alias("r"))
            .unionByName(right.select(F.col(right_date).alias("d"), F.lit(False).alias("l"), F.lit(True).alias("r")))
            .filter(F.col("d").isNotNull())
            .groupBy("d").agg(F.max("l").alias("l"), F.max("r").alias("r")))
    d = F.col("d")
    return days.agg(
        F.min(F.when(F.col("l"), d)).alias("left_min"), F.max(F.when(F.col("l"), d)).alias("left_max"),
        F.count(F.when(F.col("l"), 1)).alias("left_days"),
        F.min(F.when(F.col("r"), d)).alias("right_min"), F.max(F.when(F.col("r"), d)).alias("right_max"),
        F.count(F.when(F.col("r"), 1)).alias("right_days"),
        F.count(F.when(F.col("l") & F.col("r"), 1)).alias("overlap_days"))
