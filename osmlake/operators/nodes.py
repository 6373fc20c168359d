"""Node geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from osmlake.functions.geometry import geo
from osmlake.functions.native import snapped


def no_changesets() -> Column:
    return F.array().cast("array<bigint>")


def own_changesets(df: DataFrame) -> Column:
    """The column of accumulated changesets; empty where the input lacks it or has null."""
    return F.coalesce(F.col("additional_changesets"), no_changesets()) if "additional_changesets" in df.columns else no_changesets()


def typed_metadata(df: DataFrame) -> list[Column]:
    """The metadata columns in their final types."""
    casts = {"version": "bigint", "timestamp": "timestamp", "changeset": "bigint", "uid": "bigint"}
    return [F.col("id"), *(F.col(c).cast(t).alias(c) for c, t in casts.items()), F.col("user"), F.col("tags")]


def build_node_geometry(nodes: DataFrame) -> DataFrame:
    """Nodes with coordinates as points at seven decimals; rows without a coordinate are dropped.

    ``latest_ts`` is the node's own timestamp.  ``x`` and ``y`` are the snapped
    coordinates as columns.
    """
    return nodes.where("lat is not null and lon is not null").select(
        *typed_metadata(nodes),
        "lat",
        "lon",
        F.col("timestamp").cast("timestamp").alias("latest_ts"),
        own_changesets(nodes).alias("additional_changesets"),
        snapped(F.col("lon")).alias("x"),
        snapped(F.col("lat")).alias("y"),
        geo("point", F.col("lon").cast("double"), F.col("lat").cast("double")).alias("geom"),
    )
