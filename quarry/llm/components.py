"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import delete, fresh_path, salted_join, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return salted_join(both.where("v > u"), least, "u", "v", salts=8).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them (edges go from larger u to smaller v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = salted_join(edges, least, "u", "v", salts=8)
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the least node of its component.

    Self loops and edges with a null end are left out. Each round writes its edges to the shared folder and deletes the last ones;
    a node with very many edges is dealt over several tasks.
    """
    start = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    spark, path = edges.sparkSession, fresh_path(edges.sparkSession, "edges")
    now = written(start.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges", path=f"{path}/0")
    seen = None
    for i in range(1, max_rounds + 1):
        now = written(_small_star(_large_star(now)).where("u <> v").distinct(), "edges", path=f"{path}/{i}")
        delete(spark, f"{path}/{i - 1}")
        # sums over hashes: equal edge sets give equal sums, whatever the order
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
    raise RuntimeError(f"no fixed point within {max_rounds} rounds")
