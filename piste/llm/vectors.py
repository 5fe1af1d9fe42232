"""Vectors in Spark tables: usable rows, matrices of Arrow batches, rows streamed block by block.

A vector takes part if it is not null, not empty and holds no null or non-finite entry.  Vectors can
only be compared at equal length: of a table with several lengths, the most frequent one among such
vectors (ties: the longer) takes part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(emb: DataFrame, vec: str = "embedding", largest: float = float("inf")) -> DataFrame:
    """The rows whose vector takes part and has no entry of ``largest`` or more in magnitude."""
    x = F.col(vec)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) >= largest))
    rows = emb.where(F.coalesce(F.size(x) > 0, F.lit(False))).where(~bad)
    length = rows.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size(x) == length["n"]) if length else rows


def matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind) if len(column) else np.zeros((0, 0), kind)


def in_blocks(df: DataFrame, keys: list[str], then: list[str]) -> DataFrame:
    """Rows of equal ``keys`` in one partition, one key after another, each ordered by ``then``."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *then)


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of the batches inside which every column of ``keys`` (integers) is constant."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            yield tuple(int(c[a]) for c in columns), batch.slice(int(a), int(b - a))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
