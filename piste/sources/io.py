"""Sources and sinks SRC02-SRC09, SNK01-SNK04."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType



def read_csv_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """SRC02: header, quoted fields, '' -> NULL, explicit columns; any bad row aborts."""
    return (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
            .option("nullValue", "").option("emptyValue", None).option("mode", "FAILFAST").csv(path))


def read_csv_tolerant(spark: SparkSession, path: str, schema: StructType, reject_path: str | None = None
                      ) -> DataFrame:
    """SRC03: gzip or plain CSV; malformed rows are skipped from the result and, when
    ``reject_path`` is given, written there (JSON lines) with their raw text."""
    corrupt = "_rejected_record"
    full = StructType(list(schema.fields) + [StructField(corrupt, StringType(), True)])
    df = (spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", corrupt).csv(path))
    if reject_path:
        # rejected rows keep their raw text next to whatever fields did parse (a query may
        # not read the corrupt-record column alone from a raw CSV scan)
        df.filter(F.col(corrupt).isNotNull()).write.mode("append").json(reject_path)
    return df.filter(F.col(corrupt).isNull()).drop(corrupt)


def read_seed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """SRC04: small reference CSV; joins broadcast it if its bytes are below the threshold."""
    return read_csv_strict(spark, path, schema)


def load_documents_json(spark: SparkSession, path: str, target: str, schema: StructType | None = None,
                        multi_line: bool = True) -> None:
    """SRC05: JSON documents (multi-line files, or one document a line) -> truncate and load."""
    r = spark.read.option("multiLine", multi_line)
    if schema is not None:
        r = r.schema(schema)
    r.json(path).write.mode("overwrite").parquet(target)


def append_day(df: DataFrame, target: str, date_col: str) -> None:
    """SNK01: append a day's rows, partitioned by day."""
    df.withColumn("__day", F.date_format(F.col(date_col), "yyyy-MM-dd")).write.mode("append").partitionBy(
        "__day").parquet(target)


def overwrite(df: DataFrame, target: str) -> None:
    """SNK02: truncate + bulk load."""
    df.write.mode("overwrite").parquet(target)


def export_csv_gz(df: DataFrame, target: str) -> None:
    """SNK03: gzip CSV export with header."""
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(target)


def export_csv(df: DataFrame, target: str) -> None:
    """SNK04: a result set as CSV (parallel part files; no driver collect)."""
    df.write.mode("overwrite").option("header", True).csv(target)


def new_dates_only(incoming: DataFrame, date_col: str, loaded: list[DataFrame], loaded_cols: list[str],
                   force: bool = False) -> DataFrame:
    """SRC06: drop incoming rows whose date is already loaded in any of the targets."""
    if force:
        return incoming
    seen = None
    for df, c in zip(loaded, loaded_cols):
        d = df.select(F.to_date(F.col(c)).alias("__d")).distinct()
        seen = d if seen is None else seen.unionByName(d)
    seen = seen.distinct()
    return incoming.join(seen, F.to_date(F.col(date_col)) == F.col("__d"), "left_anti")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """SRC07: one row per table with its count (union of one-row aggregates)."""
    out = None
    for name, df in tables.items():
        c = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = c if out is None else out.unionByName(c)
    return out


def freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """SRC08: latest business date per table."""
    out = None
    for name, (df, col) in tables.items():
        c = df.agg(F.max(F.to_date(F.col(col))).alias("latest_date")).select(F.lit(name).alias("table_name"),
                                                                            "latest_date")
        out = c if out is None else out.unionByName(c)
    return out


def sample_rows(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """SRC09: Bernoulli row sample (distributed; no ordering of the whole table)."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)
