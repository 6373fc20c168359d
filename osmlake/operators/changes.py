"""Operators on change records: deduplication, slices, classification of nodes, carried changesets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from osmlake.operators.nodes import no_changesets, own_changesets


def dedup(changes: DataFrame) -> DataFrame:
    """The latest version of each (id, type) with the changesets of the others.

    One aggregation and no self-join: the winner is the maximum of
    (version, timestamp, changeset, op); the others' distinct changesets
    become ``additional_changesets``.  Null changesets count as 0.
    """
    rows = changes.withColumn("changeset", F.coalesce("changeset", F.lit(0).cast("bigint"))).withColumn("_order", F.struct("version", "timestamp", "changeset", "op"))
    kept = ["op", "version", "timestamp", "uid", "user", "changeset", "tags", "lat", "lon", "refs", "members"]
    grouped = rows.groupBy("id", "type").agg(F.max_by(F.struct(*kept), "_order").alias("w"), F.sort_array(F.collect_list("_order"), asc=False).alias("all"))
    losers = F.when(F.size("all") > 1, F.array_distinct(F.transform(F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(1))), lambda x: x["changeset"]))).otherwise(no_changesets())
    ts = F.col("w.timestamp").cast("timestamp")
    return grouped.select(
        "id", "type", "w.op", "w.version", ts.alias("timestamp"), "w.uid", "w.user", "w.changeset", "w.tags", "w.lat", "w.lon", "w.refs", "w.members",
        ts.alias("latest_ts"), losers.alias("additional_changesets"),
    )


def upserts(latest: DataFrame, kind: str) -> DataFrame:
    return latest.where((F.col("type") == kind) & F.col("op").isin("create", "modify"))


def deletes(latest: DataFrame, kind: str) -> DataFrame:
    """Ids of deleted elements."""
    return latest.where((F.col("type") == kind) & (F.col("op") == "delete")).select("id")


def classify_nodes(node_upserts: DataFrame, base_nodes: DataFrame) -> DataFrame:
    """Node upserts with ``moved``: new, or other coordinates than the stored row (null equals null)."""
    base = base_nodes.select("id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.lit(True).alias("_old"))
    joined = node_upserts.join(base, "id", "left")
    same = F.col("lat").eqNullSafe(F.col("_lat")) & F.col("lon").eqNullSafe(F.col("_lon"))
    return joined.withColumn("moved", F.col("_old").isNull() | ~same).drop("_lat", "_lon", "_old")


def carry_changesets(updates: DataFrame, base: DataFrame) -> DataFrame:
    """Updates whose changesets also have those stored for the same id."""
    stored = base.select("id", F.col("additional_changesets").alias("_stored"))
    joined = updates.join(stored, "id", "left")
    both = F.array_distinct(F.array_union(own_changesets(updates), F.coalesce("_stored", no_changesets())))
    return joined.withColumn("additional_changesets", both).drop("_stored")
