"""Looking into a database: sample features as GeoJSON, differences between snapshots."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from osmlake.functions.geometry import geo, register


def sample_rows(features: DataFrame, geom_type: str = "Polygon", limit: int = 10) -> DataFrame:
    """The newest features whose geometry type contains ``geom_type`` (so Polygon finds MultiPolygon), ties by id."""
    typed = features.where("geometry is not null").withColumn("geometry_type", geo("type", "geometry"))
    return typed.where(F.col("geometry_type").contains(geom_type)).orderBy(F.desc("timestamp"), "id").limit(limit)


def sample_geojson(features: DataFrame, path: str, osm_type: str, geom_type: str = "Polygon", limit: int = 10) -> str:
    """Write a FeatureCollection of at most ``limit`` features to a file; its path."""
    register(features.sparkSession)
    rows = sample_rows(features, geom_type, limit).select(
        "id", "tags", F.col("timestamp").cast("string").alias("timestamp"), "version", "geometry_type", geo("as_geojson", "geometry").alias("shape"), geo("num_parts", "geometry").alias("parts"), geo("num_holes", "geometry").alias("holes")
    )
    found = [
        {
            "type": "Feature",
            "id": f"{osm_type}/{r.id}",
            "geometry": json.loads(r.shape),
            "properties": {**(r.tags or {}), "@type": osm_type, "@id": r.id, "@timestamp": r.timestamp, "@version": r.version, "@geometry_type": r.geometry_type, "@parts": r.parts, "@holes": r.holes},
        }
        for r in rows.collect()
    ]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"type": "FeatureCollection", "features": found}, f, ensure_ascii=False)
    return path


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change, geometry_before, geometry_after): rows created, deleted or modified between two snapshots."""
    old = before.select("id", F.col("version").alias("v0"), F.col("geometry").alias("geometry_before"), F.xxhash64("latest_ts", "changeset", F.col("geometry")).alias("h0"))
    new = after.select("id", F.col("version").alias("v1"), F.col("geometry").alias("geometry_after"), F.xxhash64("latest_ts", "changeset", F.col("geometry")).alias("h1"))
    both = old.join(new, "id", "full_outer")
    change = F.when(F.col("h0").isNull(), "created").when(F.col("h1").isNull(), "deleted").when((F.col("h0") != F.col("h1")) | ~F.col("v0").eqNullSafe(F.col("v1")), "modified")
    return both.withColumn("change", change).where("change is not null").select("id", "change", "geometry_before", "geometry_after")
