"""The last step before a table: one row for each id, cleaned geometry, bounding box, the table's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from osmlake.functions.geometry import geo
from osmlake.functions.native import BBOX
from osmlake.operators.nodes import no_changesets
from osmlake.schemas import KINDS


def unique_by_id(df: DataFrame) -> DataFrame:
    """The row of the highest version, then newest ``latest_ts``, then (for a fixed result) highest changeset."""
    order = [F.col("version").desc_nulls_last(), F.col("latest_ts").desc_nulls_last(), F.col("changeset").desc_nulls_last()]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def chosen(df: DataFrame, kind: str) -> DataFrame:
    """The rows that a node, way or relation table gets from a view with ``geom``: one for each id; nodes and ways without geometry are dropped."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; expected node, way or relation")
    return unique_by_id(df if kind == "relation" else df.where("geom is not null"))


def shaped(rows: DataFrame, kind: str) -> DataFrame:
    """Those rows in the table's columns: cleaned geometry, and the bounding box (ways, relations) of the geometry before cleaning.

    Row by row, so it can follow whatever deals the rows out.
    """
    box = F.col("_box")
    rows = rows.withColumn("_box", geo("envelope", "geom"))
    bbox = F.when(box.isNotNull(), F.struct(*(F.get(box, F.lit(k)).cast("float").alias(n) for k, n in enumerate(("xmin", "xmax", "ymin", "ymax"))))).cast(BBOX)
    own = {"node": ["lat", "lon"], "way": ["refs"], "relation": ["members"]}[kind]
    out = rows.select(
        "id",
        *(F.col(c).cast(t).alias(c) for c, t in (("version", "bigint"), ("timestamp", "timestamp"), ("changeset", "bigint"), ("uid", "bigint"))),
        "user",
        "tags",
        *own,
        F.col("latest_ts").cast("timestamp").alias("latest_ts"),
        F.coalesce("additional_changesets", no_changesets()).alias("additional_changesets"),
        geo("clean_relation" if kind == "relation" else "clean", "geom").alias("geometry"),
        bbox.alias("bbox"),
    )
    return out.drop("bbox") if kind == "node" else out


def finalize(df: DataFrame, kind: str) -> DataFrame:
    """Rows of a node, way or relation table from a view with ``geom``; relations without geometry keep null."""
    return shaped(chosen(df, kind), kind)
