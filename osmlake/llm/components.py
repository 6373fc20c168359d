"""Connected components of an edge table, by alternating star contractions.

Nothing is collected: each round is two joins on the edge table and ends in a
table in the shared folder, so lost executors only repeat part of one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from osmlake.llm.runtime import materialise, shared_dir


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node on an edge; component is the least node reachable.

    ``edges``: two long columns (u, v).  Self-loops, repeats and null ends are
    ignored.  An empty table gives an empty result.
    """
    spark = edges.sparkSession
    base = shared_dir(spark)
    pairs = edges.toDF("u", "v").where("u is not null and v is not null and u <> v")
    now = materialise(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{base}/0")
    state, k = _state(now), 0
    while state[0]:
        k += 1
        large = _large_star(now).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        now = materialise(_small_star(large).where("u <> v").distinct(), f"{base}/{k}")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
