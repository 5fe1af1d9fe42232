"""Connected components by alternating large-star and small-star rounds.

Every round is a partial aggregation and a many-to-one join on a vertex.  The least neighbours of
vertices with very many edges, ``HOT`` of them at most, are broadcast, so the edges of one vertex
never meet in one task; the others are joined by shuffle.  Edges are staged between rounds.  Nothing
reaches the driver but a row count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from piste.llm.common import discard, staged


HOT = 100_000  # vertices whose least neighbour is broadcast: 24 bytes each
FEW = 1024  # edges that always may meet in one task


def _star(directed: DataFrame, edges: int, keep, own: bool = False) -> DataFrame:
    """``directed`` has (u, v), ``edges`` rows or fewer; every v that ``keep`` accepts is moved to u's
    least neighbour.  With ``own`` each u also keeps an edge to its least neighbour."""
    least = staged(directed.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).withColumn("low", F.least("low", "u")), "least")
    many = F.col("n") > max(FEW, edges // HOT)  # fewer than HOT vertices have that many
    hot = F.broadcast(least.where(many).select("u", F.col("low").alias("hot")))
    met = directed.join(hot, "u", "left")
    near = met.where("hot is not null").select("u", "v", F.col("hot").alias("low"))
    far = met.where("hot is null").drop("hot").join(least.where(~many).select("u", "low"), "u")
    moved = near.unionByName(far).where(keep)
    moved = moved.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
    if own:
        moved = moved.unionByName(least.select("u", F.col("low").alias("v")))
    made = staged(moved.distinct(), "edges")
    discard(least)
    return made


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (id, root): every vertex with an edge to another one, and the least
    vertex of its component.  Self-loops and nulls add nothing."""
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where("a <> b").distinct(), "edges")
    seen = None
    while True:
        check = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if check["n"] == 0 or check == seen:
            break
        seen = check
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, 2 * check["n"], F.col("v") > F.col("u"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        before, now = now, _star(down, 2 * check["n"], F.lit(True), own=True)
        discard(before, large)
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
