"""Readers for the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The columns of the given tables, with the kind of value that each must hold.
SCHEMAS = {
    "region": "r_regionkey whole, r_name text",
    "nation": "n_nationkey whole, n_name text, n_regionkey whole",
    "customer": "c_custkey whole, c_name text, c_nationkey whole, c_acctbal number, c_mktsegment text",
    "supplier": "s_suppkey whole, s_name text, s_nationkey whole, s_acctbal number",
    "part": "p_partkey whole, p_name text, p_brand text, p_type text, p_size whole, p_retailprice number",
    "orders": "o_orderkey whole, o_custkey whole, o_orderstatus text, o_totalprice number, o_orderdate time, o_orderpriority text",
    "lineitem": "l_orderkey whole, l_partkey whole, l_suppkey whole, l_linenumber whole, l_quantity number, l_extendedprice number, l_discount number, "
                "l_tax number, l_returnflag text, l_linestatus text, l_shipdate time",
    "events": "event_id whole, ts time, user_id whole, event_type text, value number",
    "documents": "doc_id whole, text text, lang text, source text, n_chars whole",
    "embeddings": "vec_id whole, embedding numbers, label whole",
    "pages": "page_id whole, url text, html text",
    "benchmark": "item_id whole, text text",
    "labels": "doc_id whole, quality whole, toxic whole",
    "conversations": "conv_id whole, turn whole, role text, text text",
}
DRIVER_TABLES = tuple(SCHEMAS)
KINDS = {"whole": ("tinyint", "smallint", "int", "bigint"), "text": ("string",), "time": ("date", "timestamp", "timestamp_ntz"),
         "numbers": ("array<float>", "array<double>")}
KINDS["number"] = (*KINDS["whole"], "float", "double", "decimal")


def checked(df: DataFrame, name: str) -> DataFrame:
    """The table, if it has every declared column in a type of its kind; an error names what is wrong,
    so that a missing column is never taken for one without values.  Further columns are allowed."""
    types, wrong = dict(df.dtypes), []
    for column, kind in (c.split() for c in SCHEMAS[name].split(", ")):
        if column not in types:
            wrong.append(f"{column} is missing")
        elif types[column].split("(")[0] not in KINDS[kind]:
            wrong.append(f"{column} is {types[column]}, not a {kind}")
    if wrong:
        raise ValueError(f"table {name}: {'; '.join(wrong)}")
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table against its declared columns; scan parallelism is the reader's own (file
    splits)."""
    return checked(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"), name)


class DriverTables:
    """Lazy accessor: ``t.orders`` reads ``<sf_dir>/orders.parquet`` once per instance."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in DRIVER_TABLES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.sf_dir, name)
        return self._cache[name]

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)
